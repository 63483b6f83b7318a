"""Keyword routing of questions to business scenes, and advisory notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ledgerleaf.functions.text import strip

# Scenes in their order, and the words that hint at each of them.
SCENE_HINTS: Mapping[str, Sequence[str]] = {
    "Banking": ("存款", "贷款", "银行", "理财", "活期", "定期", "储蓄", "利率", "利息", "lpr"),
    "Securities": ("股票", "证券", "A股", "港股", "打新", "ETF", "开户"),
    "Insurance": ("保险", "保单", "理赔", "寿险", "重疾", "年金"),
    "Trust": ("信托", "家族信托", "受托", "受益人"),
    "MutualFunds": ("基金", "公募", "私募", "净值", "申购", "赎回"),
}
# Promises an answer must not make, the two notes, the expert limit.
FORBIDDEN_PROMISES = ("保本", "稳赚", "无风险", " guaranteed", "保证收益")
PROMISE_NOTE = "⚠️ 不得承诺保本 / 无风险收益，请修正表述。"
STANDARD_NOTE = "已包含必要风险提示，表述无明显误导。"
MAX_EXPERTS = 3


def _has_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def match_scenes(text: Column, hints: Mapping[str, Sequence[str]] = SCENE_HINTS) -> Column:
    """Scenes, in order, with at least one hint word in the text (case-sensitive)."""
    text = F.coalesce(text, F.lit(""))
    hits = [F.when(_has_any(text, words), F.lit(scene)) for scene, words in hints.items()]
    return F.array_compact(F.array(*hits))


def resolve_scene(raw_route: Column, text: Column, hints: Mapping[str, Sequence[str]] = SCENE_HINTS) -> Column:
    """Final scene of a question: the proposed route, corrected by keyword hits."""
    route = strip(F.rtrim(strip(raw_route), F.lit(".,;!，。；！")))
    accepted = F.when(route.isin("Multi", *hints), route).otherwise(F.lit("Direct"))
    matched = match_scenes(text, hints)
    corrected = (
        F.when(F.size(matched) == 1, matched[0]).when(F.size(matched) > 1, F.lit("Multi")).otherwise(F.lit("Direct"))
    )
    return F.when(accepted == "Direct", corrected).otherwise(accepted)


def consulted_experts(text: Column, hints: Mapping[str, Sequence[str]] = SCENE_HINTS) -> Column:
    """Experts of a round table: the matched scenes, or all of them, at most three."""
    matched = match_scenes(text, hints)
    everyone = F.array(*[F.lit(scene) for scene in hints])
    return F.slice(F.when(F.size(matched) > 0, matched).otherwise(everyone), 1, MAX_EXPERTS)


def parse_scene(text: Column, candidates: Sequence[str] = tuple(SCENE_HINTS)) -> Column:
    """``Multi``, or the first candidate named anywhere in the text, else null."""
    lowered = F.lower(strip(text))
    scene = F.when(lowered == "multi", F.lit("Multi"))
    for name in candidates:
        scene = scene.when(F.contains(lowered, F.lit(name.lower())), F.lit(name))
    return scene


def compliance_notes(answer: Column, terms: Sequence[str] = FORBIDDEN_PROMISES) -> Column:
    return F.concat_ws("\n", F.when(_has_any(answer, terms), F.lit(PROMISE_NOTE)), F.lit(STANDARD_NOTE))
