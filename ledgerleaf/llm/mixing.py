"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Inside a source, a document's expected
number of copies grows with a size measure, up to a limit; its whole part is
certain, its fraction is an inclusion probability. Documents are ranked by
random odds over inclusion odds, u/(1-u) : f/(1-f), and taken in that order
until the target in words is met (a sample of fixed size, measured in words).
One last document whose size fits the remaining gap best closes it.

The random number is a digest of the document, so reruns and lost executors
give the same sample. Only tables with a row per source, per source and size
class, or per source and rank bucket are put in order; of a hot source, only
the rows of the one bucket in which its target falls meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.llm.common import free_name, stored, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANK_BUCKETS = 16_384
SEED = "mix-1"


def document_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Digest that decides a document's luck: of its id, its text and the seed."""
    null = F.lit("")
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), null), F.lit(":"), F.md5(F.coalesce(text, null)), F.lit(":" + seed)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, size) -> one row per source: source_size, target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    all words. A target stops at ``max_copies`` times its source's size; the
    excess is shared by weight among the rest until none is above.
    """
    listed = ", ".join(str(w) for w in weights)
    return sizes.sparkSession.sql(
        f"""
        WITH totals AS (SELECT source, sum(size) AS source_size FROM {{sizes}} GROUP BY source),
        weighed AS (
            SELECT *, element_at(array({listed}),
                CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS int)) AS weight
            FROM totals),
        room AS (SELECT *, {max_copies} * source_size / weight AS room FROM weighed),
        levels AS (
            -- level: words per unit of weight if exactly the sources with less room are at their limit
            SELECT *, (sum(source_size) OVER () - {max_copies} * coalesce(sum(source_size) OVER less, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER less, 0)) AS level
            FROM room
            WINDOW less AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT source, source_size,
            least(CAST({max_copies} * source_size AS double),
                min_by(level, CASE WHEN room >= level THEN room END) OVER () * weight) AS target
        FROM levels
        """,
        sizes=sizes,
    )


def _class_rates(sizes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Expected copies (``rate``) for each source and size class, with target and certain words."""
    return sizes.sparkSession.sql(
        f"""
        WITH classes AS (SELECT source, class, sum(size) AS words FROM {{sizes}} GROUP BY source, class),
        aimed AS (SELECT c.*, t.source_size, t.target FROM classes c JOIN {{targets}} t ON c.source <=> t.source),
        levels AS (
            SELECT *, (target - {max_copies} * coalesce(sum(words) OVER larger, 0))
                / nullif(sum(words * class) OVER rest, 0) AS level
            FROM aimed
            WINDOW larger AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        rated AS (
            SELECT *, least(CAST({max_copies} AS double), coalesce(
                max_by(level, CASE WHEN level * class <= {max_copies} THEN class END) OVER (PARTITION BY source) * class,
                CAST({max_copies} AS double))) AS rate
            FROM levels)
        SELECT source, class, source_size, target, rate,
            target - sum(words * floor(rate)) OVER (PARTITION BY source) AS open_words
        FROM rated
        """,
        sizes=sizes,
        targets=targets,
    )


# A document's class is the bit length of its size; the size measure grows with it.
_CLASS = "length(bin(size))"
# u in (0, 1) from 52 bits of the key; odds: u/(1-u) over f/(1-f); place: the same, mapped to (0, 1).
_U = "((CAST(conv(substr(key, 1, 13), 16, 10) AS bigint) + 0.5D) / 4503599627370496D)"
_F = "(rate - floor(rate))"
_ODDS = f"CASE WHEN {_F} > 0 THEN ({_U} / (1 - {_U})) * ((1 - {_F}) / {_F}) END"


def _ranked(docs: DataFrame, rates: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(
        f"""
        SELECT *, CAST(floor(odds / (1 + odds) * {RANK_BUCKETS}) AS int) AS bucket
        FROM (SELECT d.*, r.source_size, r.target, r.rate, r.open_words, {_ODDS} AS odds
              FROM {{docs}} d JOIN {{rates}} r ON d.source <=> r.source AND d.class = r.class)
        """,
        docs=docs,
        rates=rates,
    )


def mixing_plan(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, size, key) -> what decides every document's copies; a row per source and size class.

    ``rate``; ``cut_bucket``, ``cut_odds``, ``cut_key``: the end of the ranked
    sample; ``close_key``: the closing document's key (null: none).
    """
    spark = sizes.sparkSession
    sizes = sizes.selectExpr("*", f"{_CLASS} AS class")
    targets = source_targets(sizes, weights, max_copies)
    rates = stored(_class_rates(sizes, targets, max_copies), "mix-rates")
    ranked = _ranked(sizes, rates)
    # The bucket in which the sum of sizes, in rank order, passes the open words.
    cuts = spark.sql(
        """
        WITH buckets AS (SELECT source, bucket, sum(size) AS words, max(open_words) AS open_words
                         FROM {ranked} WHERE odds IS NOT NULL GROUP BY source, bucket),
        running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM buckets)
        SELECT source, min(bucket) AS cut_bucket, min_by(upto - words, bucket) AS before
        FROM running WHERE upto > open_words GROUP BY source
        """,
        ranked=ranked,
    )
    cuts = stored(cuts, "mix-cuts")
    # Inside that bucket, the last document that still fits.
    ends = spark.sql(
        """
        WITH inside AS (SELECT r.source, r.odds, r.key, sum(r.size) AS words, max(r.open_words - c.before) AS room
                        FROM {ranked} r JOIN {cuts} c ON r.source <=> c.source AND r.bucket = c.cut_bucket
                        GROUP BY r.source, r.odds, r.key),
        running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY odds, key) AS upto FROM inside)
        SELECT source, max(struct(odds, key)) AS last, max(upto) AS inside
        FROM running WHERE upto <= room GROUP BY source
        """,
        ranked=ranked,
        cuts=cuts,
    )
    ends = stored(
        spark.sql(
            """
            SELECT c.source, c.cut_bucket, e.last.odds AS cut_odds, e.last.key AS cut_key, c.before + coalesce(e.inside, 0) AS taken
            FROM {cuts} c LEFT JOIN {ends} e ON c.source <=> e.source
            """,
            cuts=cuts,
            ends=ends,
        ),
        "mix-ends",
    )
    # Past the cut, the document that comes closest to what is still open, if it improves on it.
    closing = spark.sql(
        """
        WITH past AS (SELECT r.source, r.key, r.odds, r.open_words - e.taken AS gap, r.size
                      FROM {ranked} r JOIN {ends} e ON r.source <=> e.source
                      WHERE r.bucket > e.cut_bucket OR (r.bucket = e.cut_bucket
                          AND (e.cut_odds IS NULL OR struct(r.odds, r.key) > struct(e.cut_odds, e.cut_key))))
        SELECT source, min(struct(abs(gap - size) AS off, odds, key)).key AS close_key
        FROM past WHERE abs(gap - size) < gap GROUP BY source
        """,
        ranked=ranked,
        ends=ends,
    )
    return spark.sql(
        """
        SELECT r.*, e.cut_bucket, e.cut_odds, e.cut_key, c.close_key
        FROM {rates} r LEFT JOIN {ends} e ON r.source <=> e.source LEFT JOIN {closing} c ON r.source <=> c.source
        """,
        rates=rates,
        ends=ends,
        closing=closing,
    )


#: Columns that the mix adds.
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def pareto_mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, sizes: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with ``mix_size``, ``mix_source_size``,
    ``mix_target`` and ``mix_copies`` (0 to ``max_copies``).

    The jobs that settle the plan run at once; the result is a row-local look-up
    in the plan, so texts are not shuffled. ``sizes``: (source, size, key) of
    the same documents, where the caller has them stored.

    A null text has size 0, a null source is a source of its own (the last), a
    null id counts as empty; rows equal in id and text share one fate and are
    counted each; an empty table gives an empty result. Existing columns keep
    their values, but for those with the name of a result, which it replaces.
    """
    if sizes is None:
        sizes = stored(mixing_sizes(docs, seed), "mix-sizes")
    plan = stored(mixing_plan(sizes, weights, max_copies), "mix-plan").alias("p")
    size, key = free_name(docs, "mix_row_size"), free_name(docs, "mix_row_key")
    keyed = docs.withColumns({size: word_count(F.col("text")), key: document_key(F.col("doc_id"), F.col("text"), seed)}).alias("d")
    p, d = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"d.`{c}`"))
    joined = keyed.join(plan, d("source").eqNullSafe(p("source")) & (F.length(F.bin(d(size))) == p("class")))
    u = (F.conv(F.substr(d(key), F.lit(1), F.lit(13)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)
    part = p("rate") - F.floor(p("rate"))
    odds = F.when(part > 0, (u / (1 - u)) * ((1 - part) / part))
    bucket = F.floor(odds / (1 + odds) * RANK_BUCKETS).cast("int")
    drawn = (
        p("cut_bucket").isNull() | (bucket < p("cut_bucket"))
        | ((bucket == p("cut_bucket")) & (F.struct(odds.alias("o"), d(key).alias("k")) <= F.struct(p("cut_odds").alias("o"), p("cut_key").alias("k"))) & p("cut_odds").isNotNull())
        | (d(key) == p("close_key"))
    )
    extra = F.when(odds.isNotNull() & F.coalesce(drawn, F.lit(False)), 1).otherwise(0)
    return joined.select(
        *(d(c) for c in docs.columns if c.lower() not in RESULTS),
        d(size).alias("mix_size"),
        p("source_size").alias("mix_source_size"),
        p("target").alias("mix_target"),
        (F.floor(p("rate")) + extra).cast("int").alias("mix_copies"),
    )


def mixing_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, size, key) of every document: all that the plan needs."""
    return docs.select("source", word_count(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text"), seed).alias("key"))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``, whatever their names.

    Null, empty and repeated rows as in ``pareto_mix``: a text without words is
    in the mix only where its part is taken whole; an empty table gives none.
    """
    # Columns with the name of a result are set aside meanwhile.
    aside = {c: f"kept_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in (*RESULTS, "mix_copy")}
    mixed = pareto_mix(docs.withColumnsRenamed(aside), **options)
    # The copy number stays out of the select, so the array is not built where nothing is taken.
    copies = mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return copies.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
