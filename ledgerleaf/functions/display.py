"""Names and avatars of agents, and entity summaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Agent key -> (avatar, display name). The name of the direct
# channel is a product setting, so it is a parameter with a neutral default.
AGENTS = {
    "Coordinator": ("🤖", "协调者"),
    "rag": ("🔍", "资料检索"),
    "RAGRetriever": ("🔍", "资料检索"),
    "Banking": ("🏦", "银行专家"),
    "BankingExpert": ("🏦", "银行专家"),
    "Securities": ("📈", "证券专家"),
    "SecuritiesExpert": ("📈", "证券专家"),
    "Insurance": ("🛡️", "保险专家"),
    "InsuranceExpert": ("🛡️", "保险专家"),
    "Trust": ("🏛️", "信托专家"),
    "TrustExpert": ("🏛️", "信托专家"),
    "MutualFunds": ("🧺", "基金专家"),
    "MutualFundsExpert": ("🧺", "基金专家"),
    "review": ("✅", "合规审核"),
    "ComplianceReviewer": ("✅", "合规审核"),
    "risk": ("⚠️", "风控"),
    "RiskController": ("⚠️", "风控"),
    "user": ("👤", "用户"),
}
DEFAULT_AVATAR = "🤖"
DIRECT_NAME = "Assistant"
# Entity types that a graph view treats as core, in lower case.
CORE_TYPES = (
    "person", "people", "organization", "org", "institution", "company", "product", "fund", "bank", "enterprise",
)


def _lookup(key: Column, part: int, default: Column, direct: str) -> Column:
    table = {**AGENTS, "Direct": (DEFAULT_AVATAR, direct)}
    names = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[part])])
    return F.coalesce(names[key], default)


def agent_avatar(key: Column, direct: str = DIRECT_NAME) -> Column:
    return _lookup(key, 0, F.lit(DEFAULT_AVATAR), direct)


def agent_name(key: Column, direct: str = DIRECT_NAME) -> Column:
    return _lookup(key, 1, key, direct)


def mention_name(key: Column, direct: str = DIRECT_NAME) -> Column:
    return F.when(key.isNull(), F.lit("用户")).otherwise(agent_name(key, direct))


def agent_display(key: Column, role: Column, direct: str = DIRECT_NAME) -> Column:
    """``struct<key, name, avatar>``; an empty key falls back to the role's agent."""
    shown = F.when(F.coalesce(key, F.lit("")) != "", key).when(role == "agent", F.lit("Coordinator")).otherwise(
        F.lit("Direct")
    )
    return F.struct(
        shown.alias("key"), agent_name(shown, direct).alias("name"), agent_avatar(shown, direct).alias("avatar")
    )


def is_core_type(kind: Column) -> Column:
    return F.lower(kind).isin(*CORE_TYPES)


def entity_summary(label: Column, kind: Column, source_name: Column, properties: Column) -> Column:
    """Label, source document and one line per property."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("【实体】"), label, F.lit("（类型："), kind, F.lit("）")),
        F.when(F.length(source_name) > 0, F.concat(F.lit("来源文档："), source_name)),
        F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit("："), e["value"])),
    )
