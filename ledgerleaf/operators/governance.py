"""Label-guided data governance: labels, cleaning, validation, difficulty weights, attribution.

Every operator is a plan over DataFrames: nothing runs before an action, and
groups are reduced by aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerleaf.session import cut_lineage

# The two dimensions of a label.
SCENES = ("Banking", "Securities", "Insurance", "Trusts", "Mutual Funds")
TASKS = ("NER", "Intent Classification", "Slot Filling", "Entity Disambiguation", "Consultation-style QA")

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def label_space(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The valid (scene, task) labels; the space is sparse, so they are listed."""
    return spark.createDataFrame(sorted(set(pairs)), "scene string, task string")


def assign_label(df: DataFrame, space: DataFrame, scene: str = "scene", task: str = "task") -> DataFrame:
    """``df`` with ``label`` ("scene/task"), null where the pair is not in the space."""
    known = space.select(F.col("scene").alias(scene), F.col("task").alias(task), F.concat_ws("/", "scene", "task").alias("label"))
    return df.join(known, [scene, task], "left")


def normalize_text(text: Column) -> Column:
    """One form for texts: narrow characters, lower case, single blanks."""
    text = F.col(text) if isinstance(text, str) else text
    narrow = F.when(text.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(text, WIDE, NARROW)).otherwise(text)
    # Every run of blanks but a lone space.
    return F.btrim(F.regexp_replace(F.lower(narrow), r"[\t\n\x0b\f\r][ \t\n\x0b\f\r]*| [ \t\n\x0b\f\r]+", " "))


def detox_filter(docs: DataFrame, labels: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those labelled toxic and those that hold one of ``terms`` as a word."""
    clean = docs
    if terms:
        pattern = "(^|[^a-z])(" + "|".join(terms) + ")([^a-z]|$)"
        clean = docs.where(~F.coalesce(F.lower(text).rlike(pattern), F.lit(False)))
    return clean.join(labels.where("toxic = 1").select(key), key, "left_anti")


def _letters(text: Column) -> Column:
    """Distinct words of letters of any script, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def toxic_terms(
    docs: DataFrame, labels: DataFrame, least: int = 10, precision: float = 0.99, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(term, toxic, clean): words of labelled documents that mark toxic ones.

    A term stands in ``least`` toxic documents or more, and at least ``precision``
    of the labelled documents with it are toxic. All such terms count.
    """
    judged = docs.join(labels.groupBy(key).agg(F.max("toxic").alias("_toxic")), key)
    words = judged.where(F.col("_toxic").isNotNull()).select("_toxic", F.explode(_letters(F.col(text))).alias("term"))
    counted = words.groupBy("term").agg(F.sum((F.col("_toxic") == 1).cast("long")).alias("toxic"), F.sum((F.col("_toxic") != 1).cast("long")).alias("clean"))
    return counted.where((F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))


def detox_unlabelled(docs: DataFrame, labels: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that have no label and hold a term of ``terms``; labels decide the others."""
    known = labels.where("toxic IS NOT NULL").select(key).distinct()
    unlabelled = docs.select(key, text).join(known, key, "left_anti")
    words = unlabelled.select(key, F.explode_outer(_letters(F.col(text))).alias("term"))
    marked = words.join(terms.select("term"), "term", "left_semi").select(key).distinct()
    return docs.join(marked, key, "left_anti")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of documents equal after normalising, the one with the smallest key; null texts all stay."""
    digest = F.sha2(normalize_text(F.col(text)), 256)
    first = docs.where(F.col(text).isNotNull()).groupBy(digest.alias("_digest")).agg(F.min(key).alias(key)).select(key)
    return docs.join(first.union(docs.where(F.col(text).isNull()).select(key)), key, "left_semi")


def word_windows(words: Column, n: int) -> Column:
    """Distinct digests of the n-word windows of a word array, a shorter one as one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " "))))


def digest_windows(words: Column, n: int) -> Column:
    """Distinct digests of the n-word windows of a word array, from the digests of its words; a shorter one is one window."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
        # Past the end of a short array, ``get`` gives null, which leaves the digest as it is.
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), windows)[0]


#: Bits of the filter of benchmark windows: so many for each window, between these powers of two.
FILTER_BITS, LEAST_POWER, MOST_POWER = 32, 12, 22


def _digest_filter(digests: DataFrame, column: str) -> DataFrame:
    """One row ``(bits array<long>, power)``: a bitmap of the digests of at most 2^MOST_POWER bits (512 KB), whatever their number."""
    n = digests.count()
    power = min(MOST_POWER, max(LEAST_POWER, (n * FILTER_BITS).bit_length()))
    place = F.pmod(F.col(column), F.lit(1 << power))
    cells = digests.select(F.floor(place / 64).cast("int").alias("cell"), (place % 64).cast("int").alias("bit")).groupBy("cell").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    every = digests.sparkSession.range(1 << (power - 6)).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left")
    # The list has 2^(power - 6) entries.
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda c: c["bits"]).alias("_bits")).withColumn("_power", F.lit(1 << power))


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, n: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, overlap): how many of a document's distinct n-word windows the benchmark holds; all documents.

    A document's windows are looked up in a bitmap of the benchmark's inside the
    row; only those it lets through become rows and meet the benchmark's windows.
    """
    words = lambda: F.split(normalize_text(F.col(text)), " ")
    held = cut_lineage(benchmark.where(F.col(text).isNotNull()).select(F.explode_outer(digest_windows(words(), n)).alias("window")).where("window IS NOT NULL").distinct())
    place = lambda w: F.pmod(w, F.col("_power"))
    through = lambda w: F.bit_get(F.get("_bits", F.floor(place(w) / 64).cast("int")), (place(w) % 64).cast("int")) == 1
    # The other side is one row of bounded size.
    probed = docs.where(F.col(text).isNotNull()).select(key, digest_windows(words(), n).alias("windows")).crossJoin(F.broadcast(_digest_filter(held, "window")))
    met = probed.select(key, F.explode_outer(F.filter("windows", through)).alias("window")).where("window IS NOT NULL")
    hits = met.join(held, "window", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("overlap"))
    return docs.select(key).join(hits, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, most: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that share more than ``most`` n-word windows with the benchmark."""
    dirty = benchmark_overlap(docs, benchmark, n, key, text).where(F.col("overlap") > most).select(key)
    return docs.join(dirty, key, "left_anti")


#: Different word sets of one query in a tile.
TILE = 64


def ensemble_consistency(answers: DataFrame, query: str = "query", model: str = "model", answer: str = "answer") -> DataFrame:
    """Answers of several models -> per query: models, similarity (mean Jaccard of word sets over
    pairs of models, null for one), vote (share of the most frequent answer).

    Every row is a model's answer. Equal word sets of a query are one row with a
    weight; different ones are dealt into tiles, and pairs of tiles are compared,
    so a query with very many answers is spread over tasks. Null answers are
    compared with nothing; null queries are one query.
    """
    words = F.array_sort(F.array_distinct(F.split(normalize_text(F.col(answer)), " ")))
    of = F.struct(F.col(query).alias("q"))  # a struct is never null, so null queries meet as well
    sets = answers.where(F.col(answer).isNotNull()).select(of.alias("of"), words.alias("w")).groupBy("of", "w").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.groupBy("of").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("alike"))
    tiles = F.ceil(F.col("different") / TILE).cast("int")
    dealt = cut_lineage(
        sets.join(sizes.where("different > 1").select("of", tiles.alias("tiles")), "of")
        .withColumn("h", F.xxhash64("w")).withColumn("tile", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    )
    first = dealt.select("of", F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"), F.col("w").alias("wa"), F.col("n").alias("na"), F.col("h").alias("ha"))
    second = dealt.select("of", F.explode(F.expr("sequence(0, tile)")).alias("i"), F.col("tile").alias("j"), F.col("w").alias("wb"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    met = first.join(second, ["of", "i", "j"]).where("i < j OR (ha, wa) < (hb, wb)")
    both, either = F.size(F.array_intersect("wa", "wb")), F.size(F.array_union("wa", "wb"))
    different = met.groupBy("of").agg(F.sum(F.col("na") * F.col("nb") * both / either).alias("sum"))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    similar = sizes.join(different, "of", "left").select(
        "of", F.when(pairs > 0, (F.col("alike") + F.coalesce("sum", F.lit(0.0))) / pairs).alias("similarity")
    )
    counted = answers.groupBy(of.alias("of"), F.sha2(normalize_text(F.col(answer)), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    votes = counted.groupBy("of").agg(F.sum("n").alias("models"), (F.max("n") / F.sum("n")).alias("vote"))
    return votes.join(similar, "of", "left").select(F.col("of.q").alias(query), "models", "vote", "similarity")


def stratified_sample(df: DataFrame, label: Sequence[str], n: int, key: str, seed: str = "s") -> DataFrame:
    """``n`` rows of each label, by the digest of key and seed; each task gives at most ``n`` of a label to the shuffle."""
    lot = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*label).orderBy(lot, key))).where(F.col("_place") <= n).drop("_place")


def final_filter(df: DataFrame, verified: str, clean: str, score: str, tau: float) -> DataFrame:
    """Rows that are verified and clean and score above ``tau``; nulls fail."""
    return df.where(F.col(verified) & F.col(clean) & (F.col(score) > tau))


def pass_at_k(attempts: DataFrame, k: int, label: Sequence[str] = ("label",)) -> DataFrame:
    """(label, problem, correct) -> per label: problems, pass_at_k (mean of 1 - C(n-c, k) / C(n, k)).

    A problem with fewer than ``k`` attempts is left out and counted in ``short``.
    """
    problem = attempts.groupBy(*label, "problem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    missed = F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda p, i: p * (1 - F.lit(float(k)) / i))
    one = F.when(F.col("n") < k, None).when(F.col("n") - F.col("c") < k, 1.0).when(F.col("c") == 0, 0.0).otherwise(1 - missed)
    return problem.withColumn("p", one).groupBy(*label).agg(
        F.count("p").alias("problems"), F.sum((F.col("n") < k).cast("long")).alias("short"), F.avg("p").alias("pass_at_k")
    )


def difficulty_weights(
    rates: DataFrame, previous: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.1, smooth: float = 0.5, floor: float = 0.05
) -> DataFrame:
    """(label, p_current, p_reference) -> label, raw, weight, normalized.

    raw = alpha (1 - p_current) + beta max(0, p_reference - p_current) + gamma;
    smoothed with the previous weight, not below ``floor``; normalised to a mean of 1 over the labels.
    """
    gap = F.greatest(F.lit(0.0), F.col("p_reference") - F.col("p_current"))
    raw = rates.withColumn("raw", alpha * (1 - F.col("p_current")) + beta * gap + gamma)
    if previous is None:
        mixed = raw.withColumn("mixed", F.col("raw"))
    else:
        mixed = raw.join(previous.select("label", F.col("weight").alias("before")), "label", "left").withColumn(
            "mixed", F.coalesce(smooth * F.col("before") + (1 - smooth) * F.col("raw"), "raw")
        )
    weighed = mixed.select("label", "raw", F.greatest(F.col("mixed"), F.lit(floor)).alias("weight"))
    mean = weighed.agg(F.avg("weight").alias("mean"))  # one row
    return weighed.join(F.broadcast(mean)).withColumn("normalized", F.col("weight") / F.col("mean")).drop("mean")


def weighted_loss(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(label, log_p) and (label, normalized) -> n, loss = -sum(weight * log p) / n; labels without weight count 1."""
    joined = samples.join(weights.select("label", "normalized"), "label", "left")
    return joined.agg(F.count("log_p").alias("n"), (-F.sum(F.coalesce("normalized", F.lit(1.0)) * F.col("log_p")) / F.count("log_p")).alias("loss"))


def attribution(results: DataFrame, target: float, delta: float, label: Sequence[str] = ("label",)) -> DataFrame:
    """(label, correct, learning_rate, allocated) -> per label: n, accuracy, gap, priority = gap * eta * exp(-delta * allocated)."""
    by_label = results.groupBy(*label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.max("learning_rate").alias("learning_rate"),
        F.max("allocated").alias("allocated"),
    )
    gap = F.greatest(F.lit(0.0), target - F.col("accuracy"))
    return by_label.withColumn("gap", gap).withColumn("priority", gap * F.col("learning_rate") * F.exp(-delta * F.col("allocated")))


def allocate_budget(priorities: DataFrame, budget: float) -> DataFrame:
    """``priorities`` with ``share`` = budget * priority / sum of priorities; 0 where nothing has priority."""
    total = priorities.agg(F.sum("priority").alias("total"))  # one row
    share = F.when(F.col("total") > 0, budget * F.col("priority") / F.col("total")).otherwise(0.0)
    return priorities.join(F.broadcast(total)).withColumn("share", share).drop("total")


def rollback(rounds: DataFrame, patience: int = 3) -> DataFrame:
    """(label, round, metric, allocation) -> the same with ``dropped``, ``effective`` and ``regenerate``.

    A metric below the round before takes that round's allocation back;
    ``patience`` drops in a row ask for new data.
    """
    order = W.partitionBy("label").orderBy("round")
    dropped = F.coalesce(F.col("metric") < F.lag("metric").over(order), F.lit(False))
    marked = rounds.withColumn("dropped", dropped).withColumn("effective", F.when(dropped, F.lag("allocation").over(order)).otherwise(F.col("allocation")))
    row = F.sum(F.col("dropped").cast("int")).over(order.rowsBetween(1 - patience, 0))
    return marked.withColumn("regenerate", row == patience)


def benchmark_scorecard(scores: DataFrame, category: str = "category", task: str = "task", score: str = "score") -> DataFrame:
    """Counts and mean scores by category and task, with subtotals (null task) and the total (both null)."""
    return scores.rollup(category, task).agg(F.count(F.lit(1)).alias("items"), F.avg(score).alias("mean_score"))


def distinct_ratio(text: Column, n: int = 2) -> Column:
    """Distinct n-word windows over all of them; 0 for texts that are too short."""

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    ratio = lambda x: F.size(F.array_distinct(x)) / F.size(x)
    of = lambda w: F.when(F.size(w) < n, 0.0).otherwise(F.transform(F.array(windows(w)), ratio)[0])
    return F.transform(F.array(F.split(normalize_text(text), " ")), of)[0]


def fitness_filter(samples: DataFrame, least: dict[str, float]) -> DataFrame:
    """Samples whose scores (columns) reach all thresholds; nulls fail."""
    for column, threshold in least.items():
        samples = samples.where(F.col(column) >= threshold)
    return samples


def dataset_composition(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and share of each group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))  # one row
    return counts.join(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("total")).drop("total")


def filter_overlong(df: DataFrame, length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at most ``most`` units, and one row (dropped) that counts the others."""
    long = F.coalesce(length > most, F.lit(False))
    return df.where(~long), df.agg(F.coalesce(F.sum(long.cast("long")), F.lit(0)).alias("dropped"))


def truncate_left(units: Column, most: int) -> Column:
    """The last ``most`` units of an array."""
    return F.when(F.size(units) > most, F.slice(units, -most, most)).otherwise(units)
