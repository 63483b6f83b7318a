"""Quality rules as weak supervision.

Every rule votes good (+1) or bad (-1) on a document, or abstains (0). The votes
of a corpus are a small table: pattern -> number of documents. On that table,
expectation-maximisation estimates how each rule votes on good and on bad
documents (its accuracies), and from those the probability that a pattern is
good. A document is kept when that probability reaches a threshold, so one
failed rule does not decide alone and a rule that is often wrong counts little.

All is row-local but for the counts of patterns (at most 3 to the number of
rules) and their way back, a broadcast of the same bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.llm.common import SPACE_CHARS, bind, free_name, stored, word_array

SYMBOLS = "[#*$%&|<>]"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 15
THRESHOLD = 0.5
#: Weight of the prior of a rule's vote rates, as a share of the corpus.
PRIOR_WEIGHT = 0.05
#: Prior share of good documents, and of bad votes on good and on bad documents.
PRIOR_GOOD, BAD_VOTE_ON_GOOD, BAD_VOTE_ON_BAD = 0.85, 0.02, 0.4

#: Name -> (votes bad, votes good), SQL over the features; a rule with neither abstains.
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "letters": ("100 * n_letters < 90 * word_chars", "100 * n_letters >= 94 * word_chars"),
    "exclaims": ("10 * n_exclaims > n_words", "50 * n_exclaims <= n_words"),
    "capitals": ("100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    "word_length": ("2 * word_chars < 5 * n_words OR word_chars > 14 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "lines": ("100 * n_dup_lines > 30 * n_lines", "10 * n_dup_lines <= n_lines"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "10 * n_repeat_words <= n_words"),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_exclaims")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more, each counted once.

    Only rows in which some window repeats are sorted; windows are compared by 64-bit digests.
    """

    def count(windows: Column) -> Column:
        def inside(ordered: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(ordered, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bind(ordered, inside))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 3, 0).otherwise(bind(windows, count))


def features(text: Column) -> Column:
    """All features of a text as one struct of longs; null counts as empty."""

    def of(words: Column) -> Column:
        full = F.coalesce(text, F.lit(""))
        lines = F.filter(F.split(full, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
        count = lambda pattern: F.regexp_count(full, F.lit(pattern))
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": count(SYMBOLS),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines),
            "n_letters": count(r"[\p{L}\p{N}]"),
            "n_capitals": count(r"\p{Lu}"),
            "n_exclaims": count("!"),
        }
        return F.struct(*(values[name].cast("long").alias(name) for name in FEATURES))

    return bind(word_array(text), of)


def base_failed() -> Column:
    """The base rule, over the features."""
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def votes() -> Column:
    """The rules' votes over the features as a string of -, 0 and +."""
    return F.concat(*(F.expr(f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END") for bad, good in RULES.values()))


def label_model(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, n) -> (pattern, quality): the probability that a pattern is good.

    Expectation-maximisation of a two-class model in which rules vote
    independently given the class. ``rate`` of the state holds, for the good and
    then the bad class, the share of the votes -, 0 and + of each rule. The whole
    table has at most 3 ** len(RULES) rows, so it is folded as one array.
    """
    n_rules = len(RULES)
    prior = []
    for bad_votes in (BAD_VOTE_ON_GOOD, BAD_VOTE_ON_BAD):
        prior += [bad_votes, (1 - bad_votes) / 2, (1 - bad_votes) / 2] * n_rules
    place = "CAST(locate(substr(x.pattern, j + 1, 1), '-0+') AS int) - 1"
    score = lambda of, share: f"ln({share}) + aggregate(sequence(0, {n_rules - 1}), 0D, (s, j) -> s + ln(state.rate[{of} + 3 * j + {place}]))"
    good = f"1 / (1 + exp({score(3 * n_rules, '1 - state.share')} - ({score(0, 'state.share')})))"
    scored = f"transform(seen, x -> struct(x.pattern AS pattern, x.n AS n, {good} AS q))"
    # One step: score all patterns, then count votes with the scores as weights, the prior added.
    weight = f"CASE WHEN k < {3 * n_rules} THEN y.n * y.q ELSE y.n * (1 - y.q) END"
    hit = f"CAST(locate(substr(y.pattern, CAST(k % {3 * n_rules} / 3 AS int) + 1, 1), '-0+') AS int) - 1 = k % 3"
    step = f"""
        transform(array({scored}), ys -> named_struct(
            'share', (aggregate(ys, 0D, (s, y) -> s + y.n * y.q) + {PRIOR_WEIGHT * PRIOR_GOOD} * total) / ({1 + PRIOR_WEIGHT} * total),
            'rate', transform(sequence(0, {6 * n_rules - 1}), k ->
                (aggregate(ys, 0D, (s, y) -> s + CASE WHEN {hit} THEN {weight} ELSE 0D END) + {PRIOR_WEIGHT} * total * prior[k])
                / (aggregate(ys, 0D, (s, y) -> s + {weight}) + {PRIOR_WEIGHT} * total))))[0]"""
    listed = ", ".join(f"{p!r}D" for p in prior)
    start = f"named_struct('share', {PRIOR_GOOD}D, 'rate', prior)"
    return patterns.sparkSession.sql(
        f"""
        WITH one AS (SELECT sort_array(collect_list(struct(pattern, n))) AS seen, CAST(sum(n) AS double) AS total, array({listed}) AS prior
                     FROM {{patterns}}),
        fitted AS (SELECT seen, aggregate(sequence(1, {rounds}), {start}, (state, r) -> {step}) AS state FROM one WHERE total > 0)
        SELECT inline(transform({scored}, x -> struct(x.pattern AS pattern, x.q AS quality))) FROM fitted
        """,
        patterns=patterns,
    )


def judge(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows with the features -> the same with ``base_failed``, ``quality`` and ``kept``."""
    pattern = free_name(scored, "vote_pattern")
    voted = scored.withColumn("base_failed", base_failed()).withColumn(pattern, votes())
    model = label_model(voted.groupBy(F.col(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("n")))
    # At most 3 ** len(RULES) rows, whatever the corpus.
    judged = voted.join(F.broadcast(model.withColumnRenamed("pattern", pattern)), pattern)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(pattern)


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, features, base_failed, quality, kept; one row per row.

    A null or empty text has no words, fails the base rule and is not kept; null
    and repeated ids are kept as they are; an empty table gives an empty result.
    """
    slim = docs.select("doc_id", features(F.col("text")).alias("f")).select("doc_id", "f.*")
    return judge(stored(slim, "quality"))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, unchanged, whatever their columns.

    The first pass counts vote patterns; the second looks each document's
    pattern up, so no text is shuffled.
    """
    inner = free_name(docs, "quality_features")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(inner), features(F.col("text")).alias("f"))
    judged = judge(packed.select(inner, "f.*"), threshold)
    return judged.where("kept").select(*(F.col(inner).getField(c).alias(c) for c in docs.columns))
