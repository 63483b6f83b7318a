"""Turning agent runs into chat bubbles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.display import DIRECT_NAME, agent_avatar, agent_name, mention_name
from ledgerleaf.functions.text import derive_title, strip
from ledgerleaf.operators.ordering import next_in_group

# Internal step types that are not shown.
HIDDEN_STEPS = ("revise", "route", "rag")


def build_transcript(steps: DataFrame, runs: DataFrame, direct: str = DIRECT_NAME) -> DataFrame:
    """Bubbles ``(run_id, section, seq, role, agent, avatar, type, content, mention)``.

    ``steps(run_id, seq, agent, type, content)`` and ``runs(run_id, reply,
    compliance_notes, risk_flags)``. Sorted by ``section, seq`` a run reads: shown
    steps, notes, risk flags, final reply. A shown step mentions whoever follows.
    """
    notes = F.filter(F.coalesce("compliance_notes", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    flags = F.filter(F.coalesce("risk_flags", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0

    def bubble(section: int, seq: Column, role: str, agent: Column, kind: Column, text: Column, mention: Column):
        said = strip(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n@"), mention)) if role == "agent" else text
        return [
            F.col("run_id"), F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), F.lit(role).alias("role"),
            agent.alias("agent"), agent_avatar(agent, direct).alias("avatar"), kind.alias("type"),
            said.alias("content"), mention.alias("mention"),
        ]

    shown = steps.filter(~F.coalesce(F.col("type"), F.lit("")).isin(*HIDDEN_STEPS))
    ahead = next_in_group(shown, ["run_id"], "seq", "agent", "_ahead")
    after = F.when(has("compliance_notes"), F.lit("review")).when(has("risk_flags"), F.lit("risk")).otherwise(
        F.lit("Coordinator")
    )
    outcome = runs.select("run_id", after.alias("_after"))
    # The last shown step points at what comes after; one without an agent name, too.
    following = F.coalesce("_ahead", "_after")
    speaker = F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("Coordinator"))
    talk = ahead.join(outcome, "run_id").select(
        *bubble(0, F.col("seq"), "agent", speaker, F.coalesce("type", F.lit("")), F.col("content"), mention_name(following, direct))
    )

    def advice(section: int, items: Column, agent: str, kind: str, to: str) -> DataFrame:
        rows = runs.select("run_id", F.posexplode(items).alias("seq", "text"))
        return rows.select(
            *bubble(section, F.col("seq"), "agent", F.lit(agent), F.lit(kind), F.col("text"), agent_name(F.lit(to), direct))
        )

    last = steps.groupBy("run_id").agg(
        F.max_by(
            F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("Coordinator")),
            F.when(F.col("type") == "revise", F.col("seq")),
        ).alias("_reviser")
    )
    final = runs.join(last.withColumn("_traced", F.lit(True)), "run_id", "left")
    author = F.coalesce("_reviser", F.when(F.col("_traced"), F.lit("Coordinator")).otherwise(F.lit("Direct")))
    reply = final.select(
        *bubble(3, F.lit(0), "assistant", author, F.lit("final"), F.coalesce("reply", F.lit("")), F.lit(None).cast("string"))
    )
    return (
        talk.unionByName(advice(1, notes, "ComplianceReviewer", "review", "risk"))
        .unionByName(advice(2, flags, "RiskController", "risk", "Coordinator"))
        .unionByName(reply)
    )


def participants(steps: Column, default: str = DIRECT_NAME) -> Column:
    """Distinct agents of a step array in order of appearance."""
    names = F.array_distinct(F.filter(F.transform(steps, lambda s: s["agent"]), lambda a: F.length(a) > 0))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def latest_assistant_reply(messages: DataFrame) -> DataFrame:
    """``(conv_id, content)`` of each conversation's last assistant message."""
    said = messages.filter(F.col("role") == "assistant")
    return said.groupBy("conv_id").agg(F.max_by("content", "idx").alias("content"))


def derive_titles(messages: DataFrame, limit: int = 20, default: str = "新对话") -> DataFrame:
    """``(conv_id, title)`` from each conversation's first user message."""
    user = F.col("role") == "user"
    first = F.min_by(F.when(user, F.col("content")), F.when(user, F.col("idx")))
    return messages.groupBy("conv_id").agg(derive_title(first, limit, default).alias("title"))
