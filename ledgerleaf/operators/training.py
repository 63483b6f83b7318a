"""Chat records to training tables, rubric rewards and metric series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.structured import split_think

# Role names, which of them are the human's and the assistant's.
ROLE_MAP = {
    "HUMAN": "user", "human": "user", "USER": "user",
    "ASSISTANT": "assistant", "assistant": "assistant", "GPT": "assistant",
}
HUMAN_ROLES = ("HUMAN", "human", "USER")
ASSISTANT_ROLES = ("ASSISTANT", "assistant", "GPT")
# Rubric key, weight, what is judged.
RUBRIC = (
    ("correctness", 0.40, "结论是否与参考答案一致（仅对比答案，不看推理）"),
    ("reasoning", 0.30, "推理链是否完整、逻辑自洽、与标准思维链对标（仅对比思维链，不看答案）"),
    ("compliance_risk", 0.15, "是否体现风险/合规意识"),
    ("clarity_format", 0.15, "表达是否清晰、结构规范"),
)
# Names of the step field, and per chart the metric names tried in order.
STEP_KEYS = ("step", "training_step", "global_step", "_step")
RL_METRICS = {
    "reward_mean": (
        "critic/score/mean", "reward/mean", "reward/score/mean", "val/reward_mean", "reward_mean", "critic/rewards/mean",
    ),
    "actor_loss": ("actor/loss", "actor/ppo_loss", "actor/pg_loss", "actor/policy_loss"),
    "kl": ("actor/kl", "kl/mean", "actor/kl_loss", "kl_loss", "kl"),
    "response_length": (
        "response_length/mean", "response_length_mean", "gen_response_length/mean", "responses/mean_length",
    ),
}
DISTILL_METRICS = {
    "actor_loss": ("actor/loss", "actor/ppo_loss", "actor/pg_loss", "actor/policy_loss"),
    "distill_loss": (
        "actor/distillation/loss", "distillation/loss", "actor/distillation_loss", "distillation_loss",
    ),
    "overlap_ratio": ("actor/distillation/overlap_ratio", "distillation/overlap_ratio"),
    "response_length": (
        "response_length/mean", "response_length_mean", "gen_response_length/mean", "responses/mean_length",
    ),
}


def map_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_MAP.items() for x in pair])
    return F.coalesce(names[role], role)


def _mapped(messages: Column) -> Column:
    return F.transform(
        messages, lambda m: F.struct(map_role(m["role"]).alias("role"), m["content"].alias("content"))
    )


def prepare_sft(records: DataFrame) -> DataFrame:
    """``messages`` with unified roles, order kept."""
    return records.select(_mapped(F.col("messages")).alias("messages"))


def _first_content(messages: Column, roles: Sequence[str]) -> Column:
    found = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.coalesce(F.try_element_at(found, F.lit(1))["content"], F.lit(""))


def prepare_dapo(records: DataFrame, human_roles: Sequence[str] = HUMAN_ROLES) -> DataFrame:
    """``messages`` of the human, and ``extra_info`` JSON with the question and the gold answer."""
    gold = split_think(_first_content(F.col("messages"), ASSISTANT_ROLES))
    prompts = _mapped(F.filter("messages", lambda m: m["role"].isin(*human_roles)))
    extra = F.struct(
        _first_content(F.col("messages"), human_roles).alias("question"),
        gold["thinking"].alias("gold_thinking"), gold["output"].alias("gold_output"),
    )
    return records.select(prompts.alias("messages"), F.to_json(extra).alias("extra_info"))


def prepare_opd(records: DataFrame, data_source: str, human_roles: Sequence[str] = HUMAN_ROLES) -> DataFrame:
    """``messages`` of the human, and a constant ``data_source``."""
    prompts = _mapped(F.filter("messages", lambda m: m["role"].isin(*human_roles)))
    return records.select(prompts.alias("messages"), F.lit(data_source).alias("data_source"))


def sft_message_rows(messages: DataFrame) -> DataFrame:
    """``prepare_sft`` for a message table ``(conv_id, idx, role, content)``: rows stay rows."""
    return messages.select("conv_id", "idx", map_role(F.col("role")).alias("role"), "content")


def prompt_rows(messages: DataFrame, human_roles: Sequence[str] = HUMAN_ROLES) -> DataFrame:
    """The human's messages of a message table, with unified roles."""
    return sft_message_rows(messages.filter(F.col("role").isin(*human_roles)))


def dapo_extra_info(messages: DataFrame, human_roles: Sequence[str] = HUMAN_ROLES) -> DataFrame:
    """Question and gold answer per conversation of a message table.

    First messages come from ``min_by``, which combines on the map side, so a
    conversation is never gathered.
    """
    first = lambda roles: F.coalesce(
        F.min_by(F.when(F.col("role").isin(*roles), F.col("content")), F.when(F.col("role").isin(*roles), F.col("idx"))),
        F.lit(""),
    )
    firsts = messages.groupBy("conv_id").agg(first(human_roles).alias("question"), first(ASSISTANT_ROLES).alias("_gold"))
    gold = split_think(F.col("_gold"))
    return firsts.select(
        "conv_id", "question", gold["thinking"].alias("gold_thinking"), gold["output"].alias("gold_output")
    )


# ---------------------------------------------------------------- rewards
def format_gate(response: Column) -> Column:
    return F.contains(response, F.lit("<think>")) & F.contains(response, F.lit("</think>"))


def judge_prompt(question: Column, gold_thinking: Column, gold_output: Column, response: Column) -> Column:
    """The text shown to a judge: question, both reasonings, both outputs, rubric."""
    text = lambda c: F.coalesce(c, F.lit(""))
    own = split_think(response)
    rubric = "\n".join(f"- {key}（{weight:.2f}）: {what}" for key, weight, what in RUBRIC)
    return F.concat_ws(
        "\n\n",
        F.when(text(question) != "", F.concat(F.lit("[Question]\n"), question)),
        F.concat(
            F.lit("[Reasoning — score 'reasoning' only]\nGold thinking:\n"), text(gold_thinking),
            F.lit("\n\nModel thinking:\n"), own["thinking"],
        ),
        F.concat(
            F.lit("[Output — score 'correctness', 'compliance_risk', 'clarity_format']\nGold output:\n"),
            text(gold_output), F.lit("\n\nModel output:\n"), own["output"],
        ),
        F.lit(
            "Rubric (score each dimension 0-10):\n" + rubric
            + '\n\nReturn ONLY JSON: {"dimensions": {"correctness": x, ...}, "rationale": "..."}'
        ),
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_scores(reply: Column) -> Column:
    """``map<key, score>`` of the known dimensions; empty when anything is unreadable."""
    strict = {"allowSingleQuotes": "false"}
    given = F.from_json(F.from_json(reply, F.lit("map<string,string>"), strict)["dimensions"], F.lit("map<string,string>"), strict)
    known = F.map_filter(given, lambda key, _v: key.isin(*[key for key, _w, _d in RUBRIC]))
    scores = F.transform_values(known, lambda _k, v: strip_number(v))
    empty = F.create_map().cast("map<string,double>")
    unreadable = lambda s: s.isNull() | F.exists(F.map_values(s), lambda v: v.isNull())
    return _once(scores, lambda s: F.when(~unreadable(s), s).otherwise(empty))


def strip_number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def rubric_reward(scores: Column) -> Column:
    """Weighted mean of the dimensions on 0..1; missing ones count 0, others are cut to 0..10."""
    total = F.lit(0.0)
    for key, weight, _what in RUBRIC:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(scores[key], F.lit(0.0))))
        total = total + F.lit(weight) * clamped / 10
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def compute_reward(response: Column, judge_reply: Column) -> Column:
    """0 without both think tags, else the reward of the judge's reply."""
    return F.when(format_gate(response), _once(parse_scores(judge_reply), rubric_reward)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- metric series
def parse_metric_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, line)`` -> ``(file, line_no, metric, step, value)``, one row per number.

    Lines that are no JSON object or name no step are skipped, and so are values
    that are no numbers (true and false are none).
    """
    text = F.trim("line")
    # Variant values, so that 1 and "1" and true stay different after one parse.
    typed = F.from_json(
        F.when(text.startswith("{"), text), F.lit("map<string,variant>"), {"allowSingleQuotes": "false"}
    )
    rows = lines.select("file", "line_no", typed.alias("typed"))
    key = F.coalesce(*[F.when(F.map_contains_key("typed", F.lit(k)), F.lit(k)) for k in STEP_KEYS])
    rows = rows.withColumn("_key", key)
    given = F.col("typed")[F.col("_key")]
    digits = F.try_variant_get(given, "$", "string")
    # A number is cut to its integer part, a text must be an integer.
    fraction_as_text = (F.schema_of_variant(given) == "STRING") & ~digits.rlike(r"^\s*[+-]?\d+\s*$")
    rows = rows.withColumn("step", F.when(~fraction_as_text, whole_number(digits)))
    # The map is emptied, not the row filtered: a filter would parse the line again.
    numeric = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"
    numbers = F.map_filter("typed", lambda k, v: F.col("step").isNotNull() & (k != F.col("_key")) & F.schema_of_variant(v).rlike(numeric))
    rows = rows.select("file", "line_no", "step", F.explode(numbers).alias("metric", "raw"))
    return rows.select("file", "line_no", "metric", "step", F.try_variant_get("raw", "$", "double").alias("value"))


def whole_number(text: Column) -> Column:
    """Integer part of a number or of a digit text, else null."""
    return F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).otherwise(text.try_cast("double").try_cast("bigint"))


def metric_series(points: DataFrame) -> DataFrame:
    """Last value per metric and step, in the order of file and line."""
    return points.groupBy("metric", "step").agg(F.max_by("value", F.struct("file", "line_no")).alias("value"))


def resolve_metric_groups(series: DataFrame, groups: Mapping[str, Sequence[str]] = RL_METRICS) -> DataFrame:
    """``(chart, metric)``: per chart the first candidate that occurs, else null."""
    rows = [(chart, place, name) for chart, names in groups.items() for place, name in enumerate(names)]
    known = series.sparkSession.createDataFrame(rows, "chart string, place int, metric string")
    present = series.select("metric").filter(F.col("metric").isin(*{r[2] for r in rows})).distinct().withColumn("_in", F.lit(True))
    joined = known.join(present, "metric", "left")
    return joined.groupBy("chart").agg(
        F.min_by(F.when(F.col("_in"), F.col("metric")), F.when(F.col("_in"), F.col("place"))).alias("metric")
    )
