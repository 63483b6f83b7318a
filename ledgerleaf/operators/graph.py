"""Entity graphs of documents: extraction, model output, scoped reads.

Extraction works inside the document's row: every rule is matched against every
paragraph by built-in functions, and the first sighting of a label decides. Edges
are rows: the entities of a paragraph meet in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.structured import outer_object
from ledgerleaf.functions.text import entity_key, strip
from ledgerleaf.operators.ordering import rank_in_group
from ledgerleaf.schemas import GRAPH_REPLY
from ledgerleaf.session import cut_lineage

# Limits per document, node types, edge labels.
NODE_TYPES = (
    "Document", "Org", "Product", "Clause", "Metric", "Person", "Education", "Company", "Skill", "Concept",
)
MENTION, RELATED = "提及", "相关"
TILE = 64  # entities of a paragraph in one tile
# Fixed values: (type, pattern) in order; a capture group, if any, is the label.
ENTITY_RULES: tuple[tuple[str, str], ...] = (
    ("Person", r"[\u4e00-\u9fa5]{2,4}(?:先生|女士|经理|总监|董事长|基金经理)"),
    ("Person", r"(?<=我叫)[\u4e00-\u9fa5]{2,4}"),
    ("Person", r"(?<=姓名)[：:是为\s]*([\u4e00-\u9fa5]{2,4})"),
    (
        "Education",
        r"(?:目前是|就读于|毕业于|来自|在|本科于|硕士于|博士于)([\u4e00-\u9fa5]{2,20}(?:大学|学院|学校|研究院))",
    ),
    ("Company", r"[\u4e00-\u9fa5A-Za-z0-9]{2,20}(?:公司|集团)(?:[^\u4e00-\u9fa5]|$)"),
    (
        "Skill",
        r"\b(?:Python|C\+\+|PyTorch|TensorFlow|Transformers?|LoRA|QLoRA|Qwen|GPT|LLM|大模型|机器学习|深度学习|数据分析|算法|NLP|CV)\b",
    ),
    (
        "Org",
        r"[\u4e00-\u9fa5A-Za-z]{2,12}?(?:银行|证券|保险|基金管理|信托|交易所|证监会|银保监会|金融监管总局|人民银行|资产管理|资管|券商)(?:股份有限公司|有限公司)?",
    ),
    (
        "Product",
        r"[\u4e00-\u9fa5A-Za-z0-9]{2,14}?(?:理财产品|信托计划|资管计划|年金险|重疾险|寿险|指数基金|货币基金|债券基金|ETF|结构性存款|定期存款|保单)",
    ),
    ("Clause", r"第[一二三四五六七八九十百千零〇\d]{1,6}条"),
    (
        "Metric",
        r"(?:年化收益率|七日年化|净值|风险等级|管理费率|托管费率|申购费|赎回费|最大回撤|夏普比率|保额|保费)(?:[:：]?\s*[\dA-Za-z.%万亿]+)?",
    ),
)


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n+"), strip), lambda p: p != "")


def _sightings(paragraphs: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``array<struct<para, type, label, key>>`` in order of paragraph, rule, position."""

    def by_rule(para: Column, no: Column, kind: str, pattern: str) -> Column:
        # (?U): words and digits of all scripts; (?d): "$" before \n only.
        labels = F.regexp_extract_all(para, F.lit("(?Ud)" + pattern), F.lit(min(_groups(pattern), 1)))
        return F.transform(
            labels, lambda label: F.struct(no.alias("para"), F.lit(kind).alias("type"), strip(label).alias("label"))
        )

    def in_paragraph(para: Column, no: Column) -> Column:
        return F.concat(*[by_rule(para, no, kind, pattern) for kind, pattern in rules])

    found = F.flatten(F.transform(paragraphs, in_paragraph))
    kept = F.filter(found, lambda s: F.length(s["label"]) >= 2)
    return F.transform(
        kept,
        lambda s: F.struct(s["para"].alias("para"), s["type"].alias("type"), s["label"].alias("label"), entity_key(s["label"]).alias("key")),
    )


def extract_entities(
    docs: DataFrame, rules: Sequence[tuple[str, str]] = ENTITY_RULES, max_nodes: int | None = None
) -> DataFrame:
    """``docs(doc_id, filename, text, ...)`` -> adds ``entities`` and ``hits``.

    ``entities``: the distinct labels (with a limit, the first ``max_nodes - 1``),
    each with its number from 1, type and label; ``cut_entities``: how many the
    limit left out. ``hits``: per paragraph the numbers of those it names.
    """
    seen = docs.withColumn("_seen", _sightings(_paragraphs(F.col("text")), rules))
    seen = seen.withColumn("_every", F.array_distinct(F.transform("_seen", lambda s: s["key"])))
    kept = F.col("_every") if max_nodes is None else F.slice("_every", 1, max_nodes - 1)
    seen = seen.withColumn("_keys", kept).withColumn("cut_entities", F.size("_every") - F.size("_keys")).drop("_every")
    numbered = seen.withColumn(
        "_known",
        F.filter(
            F.transform(
                "_seen",
                lambda s: F.struct(F.array_position("_keys", s["key"]).cast("int").alias("no"), s["para"].alias("para"), s["type"].alias("type"), s["label"].alias("label")),
            ),
            lambda s: s["no"] > 0,
        ),
    ).withColumn("_order", F.transform("_known", lambda s: s["no"]))
    entities = F.transform(
        "_keys",
        lambda _key, i: F.get(
            F.transform(
                F.slice("_known", F.array_position("_order", (i + 1).cast("int")).cast("int"), F.lit(1)),
                lambda s: F.struct(s["no"].alias("no"), s["type"].alias("type"), s["label"].alias("label")),
            ),
            F.lit(0),
        ),
    )
    paras = F.array_distinct(F.transform("_known", lambda s: s["para"]))
    hits = F.transform(
        paras,
        lambda p: F.array_distinct(F.transform(F.filter("_known", lambda s: s["para"] == p), lambda s: s["no"])),
    )
    return numbered.withColumn("entities", entities).withColumn("hits", hits).drop("_seen", "_keys", "_known", "_order")


def _node_id(doc: Column, no: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(":n"), no.cast("string"))


def graph_nodes(extracted: DataFrame) -> DataFrame:
    """Node rows: the document's root, then its entities."""
    doc = F.col("doc_id").cast("string")
    empty = F.create_map().cast("map<string,string>")
    root = F.struct(
        F.concat(doc, F.lit(":root")).alias("id"), F.col("filename").alias("label"), F.lit("Document").alias("type"),
        F.create_map(F.lit("chars"), F.length("text").cast("string")).alias("properties"),
    )
    others = F.transform(
        "entities",
        lambda e: F.struct(
            _node_id(doc, e["no"]).alias("id"), e["label"].alias("label"), e["type"].alias("type"), empty.alias("properties")
        ),
    )
    keep = [c for c in ("user_id",) if c in extracted.columns]
    rows = extracted.select(F.col("doc_id"), *keep, F.explode(F.concat(F.array(root), others)).alias("n"))
    return rows.select("n.id", "doc_id", *keep, "n.label", "n.type", F.col("doc_id").alias("source_doc_id"), "n.properties")


def _tile_pairs(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, a, b, place: pairs of entities of different types in one paragraph, a before b.

    The entities of a paragraph are cut into tiles; every pair of tiles is a row
    of its own and bounded, so a paragraph of any size is spread over tasks.
    ``place`` orders pairs by paragraph, then by a, then by b.
    """
    paras = extracted.select("doc_id", *keep, "entities", F.posexplode("hits").alias("para", "hit")).where(F.size("hit") > 1)
    count = F.ceil(F.size("hit") / TILE).cast("int")
    tiles = F.flatten(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.transform(F.sequence(i, count - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    typed = F.transform("hit", lambda no: F.struct(no.alias("no"), F.element_at("entities", no)["type"].alias("kind")))
    tiled = paras.select("doc_id", *keep, "para", typed.alias("typed"), F.explode(tiles).alias("t"))
    side = lambda which: F.slice("typed", F.col(f"t.{which}") * TILE + 1, F.lit(TILE))
    dealt = tiled.select("doc_id", *keep, "para", "t", side("i").alias("left"), side("j").alias("right")).repartition("doc_id", "para", "t")

    def met(a: Column, x: Column) -> Column:
        i = F.col("t.i") * TILE + x
        others = F.transform("right", lambda b, y: F.struct(b["no"].alias("b"), b["kind"].alias("kind"), (F.col("t.j") * TILE + y).alias("j")))
        place = lambda j: F.shiftleft(F.col("para").cast("long"), 40) + F.shiftleft(i.cast("long"), 20) + j
        return F.transform(
            F.filter(others, lambda o: (o["j"] > i) & (o["kind"] != a["kind"])),
            lambda o: F.struct(a["no"].alias("a"), o["b"].alias("b"), place(o["j"]).alias("place")),
        )

    # The outer form: for the plain one, the optimizer would compute all pairs twice.
    pairs = dealt.select("doc_id", *keep, F.explode_outer(F.flatten(F.transform("left", met))).alias("p"))
    return pairs.where("p IS NOT NULL").select("doc_id", *keep, "p.a", "p.b", "p.place")


def graph_edges(extracted: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Edge rows: one mention per entity, then entities of different types that share a paragraph.

    A pair counts once per document, its ends ordered by node id as text. Edges
    are numbered from 0: mentions by entity, pairs by where they occur first.
    """
    doc = F.col("doc_id").cast("string")
    keep = [c for c in ("user_id",) if c in extracted.columns]
    # Entities are found once, although three parts of the plan read them.
    extracted = cut_lineage(extracted.select("doc_id", *keep, "entities", "hits"))
    mentions = extracted.select("doc_id", *keep, F.explode("entities").alias("e")).select(
        "doc_id", *keep, (F.col("e.no") - 1).cast("long").alias("no"), F.concat(doc, F.lit(":root")).alias("source"),
        _node_id(doc, F.col("e.no")).alias("target"), F.lit(MENTION).alias("label"),
    )
    ends = _node_id(doc, F.col("a")), _node_id(doc, F.col("b"))
    related = _tile_pairs(extracted, keep).groupBy("doc_id", *keep, F.least(*ends).alias("source"), F.greatest(*ends).alias("target")).agg(F.min("place").alias("place"))
    sizes = extracted.select(F.col("doc_id").alias("_doc"), F.size("entities").alias("_n"))
    placed = rank_in_group(related, ["doc_id"], "place", "target", "_rank", span=1 << 26).join(sizes, F.col("doc_id").eqNullSafe(F.col("_doc")))
    pairs = placed.select("doc_id", *keep, (F.col("_n") + F.col("_rank") - 1).alias("no"), "source", "target", F.lit(RELATED).alias("label"))
    rows = mentions.unionByName(pairs)
    if max_edges is not None:
        rows = rows.where(F.col("no") < max_edges)
    return rows.select(
        F.concat(doc, F.lit(":e"), F.col("no").cast("string")).alias("id"), "doc_id", *keep,
        "source", "target", "label", F.col("doc_id").alias("source_doc_id"),
    )


# ---------------------------------------------------------------- graphs proposed by a model
def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def validate_model_graph(
    docs: DataFrame, max_nodes: int | None = None, max_edges: int | None = None, label_chars: int = 20
) -> DataFrame:
    """``docs(doc_id, filename, text, raw)`` -> adds ``nodes``, ``edges`` (null: use the rules).

    ``raw`` is the model's answer. Labels that the text does not hold are dropped,
    repeated ones too; unknown types become ``Concept``; edges need two known ends.
    """
    doc = F.col("doc_id").cast("string")
    reply = F.from_json(outer_object(F.coalesce("raw", F.lit(""))), GRAPH_REPLY, {"allowSingleQuotes": "false"})
    parsed = docs.withColumn("_reply", reply)
    proposed = F.transform(
        _first(F.coalesce("_reply.nodes", F.array().cast(GRAPH_REPLY["nodes"].dataType)), max_nodes),
        lambda n: F.struct(
            strip(F.coalesce(n["label"], F.lit(""))).alias("label"),
            F.when(n["type"].isin(*NODE_TYPES), n["type"]).otherwise(F.lit("Concept")).alias("type"),
        ),
    )
    real = F.filter(proposed, lambda n: (n["label"] != "") & F.contains("text", n["label"]))
    parsed = parsed.withColumn("_real", real).withColumn("_all", F.transform("_real", lambda n: entity_key(n["label"])))
    parsed = parsed.withColumn("_keys", F.array_distinct("_all"))
    nodes = F.transform(
        "_keys",
        lambda key, i: F.struct(
            _node_id(doc, i + 1).alias("id"),
            F.element_at("_real", F.array_position("_all", key).cast("int"))["label"].alias("label"),
            F.element_at("_real", F.array_position("_all", key).cast("int"))["type"].alias("type"),
        ),
    )
    mention = F.transform(
        nodes,
        lambda n: F.struct(
            F.concat(doc, F.lit(":root")).alias("source"), n["id"].alias("target"), F.lit(MENTION).alias("label")
        ),
    )
    number = lambda label: F.array_position("_keys", entity_key(F.coalesce(label, F.lit(""))))
    links = F.filter(
        F.coalesce("_reply.edges", F.array().cast(GRAPH_REPLY["edges"].dataType)),
        lambda e: (number(e["source"]) > 0) & (number(e["target"]) > 0) & (number(e["source"]) != number(e["target"])),
    )
    related = F.transform(
        links,
        lambda e: F.struct(
            _node_id(doc, number(e["source"])).alias("source"), _node_id(doc, number(e["target"])).alias("target"),
            F.substring(F.coalesce(F.nullif(e["label"], F.lit("")), F.lit(RELATED)), 1, label_chars).alias("label"),
        ),
    )
    usable = F.size("_keys") > 0
    return (
        parsed.withColumn("nodes", F.when(usable, nodes))
        .withColumn("edges", F.when(usable, _first(F.concat(mention, related), max_edges)))
        .drop("_reply", "_real", "_all", "_keys")
    )


def extract_graph(
    docs: DataFrame, rules: Sequence[tuple[str, str]] = ENTITY_RULES, max_nodes: int | None = None, max_edges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents: from ``raw`` model output where usable, else by the rules.

    Nothing is left out unless a document's limits are given.
    """
    if "raw" not in docs.columns:
        extracted = extract_entities(docs, rules, max_nodes)
        return graph_nodes(extracted), graph_edges(extracted, max_edges)
    # No filters here: each would have the model's answer checked once more. A row
    # whose array is null yields nothing, and rules are matched only where text is left.
    by_model = validate_model_graph(docs, max_nodes, max_edges)
    unanswered = by_model.withColumn("text", F.when(F.col("nodes").isNull(), F.col("text"))).drop("nodes", "edges")
    by_rules = extract_entities(unanswered, rules, max_nodes)
    keep = [c for c in ("user_id",) if c in docs.columns]
    empty = F.create_map().cast("map<string,string>")
    root = F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit(":root")).alias("id"), F.col("filename").alias("label"),
        F.lit("Document").alias("type"),
    )
    node = by_model.select("doc_id", *keep, F.explode(F.concat(F.array(root), "nodes")).alias("n"))
    node = node.select(
        "n.id", "doc_id", *keep, "n.label", "n.type", F.col("doc_id").alias("source_doc_id"), empty.alias("properties")
    )
    edge = by_model.select("doc_id", *keep, F.posexplode("edges").alias("no", "e")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":e"), F.col("no").cast("string")).alias("id"), "doc_id", *keep,
        "e.source", "e.target", "e.label", F.col("doc_id").alias("source_doc_id"),
    )
    return graph_nodes(by_rules).unionByName(node), graph_edges(by_rules, max_edges).unionByName(edge)


# ---------------------------------------------------------------- reads
def user_graph(nodes: DataFrame, edges: DataFrame, docs: DataFrame, user_id: object) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one user's finished documents."""
    done = docs.filter((F.col("status") == "done") & (F.col("user_id") == user_id)).select(F.col("id").alias("doc_id"))
    own = lambda df: df.filter(F.col("user_id") == user_id).join(done, "doc_id", "left_semi")
    return own(nodes), own(edges)


def filter_graph(
    nodes: DataFrame, edges: DataFrame, types: Sequence[str] = (), doc_id: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given types and document (empty / ``all``: any), and edges between them."""
    if types:
        nodes = nodes.filter(F.col("type").isin(*types))
    if doc_id != "all":
        nodes = nodes.filter(F.col("source_doc_id") == doc_id)
    # Stored: three parts of the plan read them, and each would extract the entities of all documents.
    nodes = cut_lineage(nodes)
    ids = nodes.select("id")
    visible = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return nodes, visible


def adjacency(edges: DataFrame) -> DataFrame:
    """``(node, neighbor)``, undirected and without repeats; one row per pair, not one set per node."""
    both = F.explode(
        F.array(
            F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")),
            F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor")),
        )
    )
    return edges.select(both.alias("p")).select("p.node", "p.neighbor").distinct()


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    touching = edges.filter((F.col("source") == node) | (F.col("target") == node))
    return adjacency(touching).filter(F.col("node") == node).select("neighbor")


def distinct_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct()
