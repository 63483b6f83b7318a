"""Secret scanning with a ledger of blobs.

Every version of a file is a blob, addressed by the SHA-256 of its content. A
ledger keeps, for each blob and version of a rule, that it was scanned, and what
was found. A scan takes each distinct blob once, leaves out the pairs of blob
and rule version that the ledger holds, and adds the rest. Findings return to
all paths by a join on the blob, so copies and old versions cost nothing twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.llm.common import bind, stored


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: Characters that the group, 0 for the whole match, must have at least.
    group: int = 0
    least: int = 1


# The patterns of the base rules, and formats of common credentials.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points; those too short are dropped.

    Positions follow from the lengths of the pieces between the matches.
    """

    def spans(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            step = lambda state, x: F.struct(
                (state["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("at"),
                F.concat(state["ends"], F.array((state["at"] + F.length(x["piece"]) + F.length(x["match"])).cast("long"))).alias("ends"),
            )
            pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
            return F.aggregate(pairs, F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<bigint>").alias("ends")), step, lambda s: s["ends"])

        ends = walk(F.split(text, rule.pattern, -1))
        value = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
        all_spans = F.transform(
            F.arrays_zip(found.alias("match"), ends.alias("end")),
            lambda x: F.struct(
                (x["end"] - F.length(x["match"])).cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                x["end"].alias("end"), F.length(value(x["match"])).alias("size"),
            ),
        )
        long = F.filter(all_spans, lambda s: s["size"] >= rule.least)
        return F.transform(long, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))

    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(bind(found, spans).cast(SPANS))


def rule_names(rules) -> list[str]:
    return [f"{rule.kind}@{rule.version}" for rule in rules]


def blob_of(content: Column) -> Column:
    """A content's address; null counts as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def scan_unseen(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(content, ...) -> new ledger rows: blob, rule ("kind@version"), spans (whole, base order).

    One row for each distinct blob and each rule version that ``ledger`` (blob,
    rule, spans) does not hold; a blob of which all are held is not read again.
    """
    # One copy a task before the shuffle, one overall after it.
    blobs = versions.select(blob_of(F.col("content")).alias("blob"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["blob"])
    names = rule_names(rules)
    if ledger is not None:
        wanted = ledger.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("held"))
        blobs = blobs.join(wanted, "blob", "left").where(F.coalesce(F.size("held"), F.lit(0)) < len(names))
        unseen = lambda name: ~F.coalesce(F.array_contains("held", name), F.lit(False))
    else:
        unseen = lambda name: F.lit(True)
    scanned = [
        F.when(unseen(name), F.struct(F.lit(name).alias("rule"), matches(F.col("content"), rule, rank).alias("spans")))
        for rank, (name, rule) in enumerate(zip(names, rules))
    ]
    # One pass over the text for all rules; the text goes no further.
    found = blobs.select("blob", F.array_compact(F.array(*scanned)).alias("found"))
    return found.select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``versions`` without content, plus ``blob`` and ``spans``: all findings, ordered by start, then rule.

    Columns of ``versions`` with one of these names are replaced.
    """
    found = (
        ledger.where(F.col("rule").isin(rule_names(rules)) & (F.size("spans") > 0))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    paths = versions.withColumn("blob", blob_of(F.col("content"))).drop("content", "spans")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> one row per row with counts and spans, and the ledger with what this scan adds.

    A null text is the empty blob and has no finding; null and repeated ids are
    rows as any other; an empty table gives an empty result.
    """
    versions = docs.select("doc_id", F.col("text").alias("content"))
    new = stored(scan_unseen(versions, RULES, ledger), "ledger")
    ledger = new if ledger is None else ledger.select(*new.columns).union(new)
    found = findings_by_path(versions, ledger)
    base = [rule.kind for rule in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    report = found.select(
        "doc_id", *(count(kind) for kind in base),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
    return report, ledger
