"""Quality rules with robust multivariate outliers, in DataFrame functions throughout.

Every document gets counts of its words, symbols and repetitions. Simple base rules reject the short and the
repetitive. For the others the counts become a vector of five transformed statistics; for each language and source
the minimum-covariance-determinant estimate of centre and scatter is found by concentration steps: distances by the
current estimate, the nearest share of the rows, their moments, and again. A document too far from its group's centre
by Mahalanobis distance is rejected. The steps start from the medians and go on until no group's determinant falls.

All group figures are sums and percentile sketches, combined before the shuffle, and what a row needs of its group's
comes to the row, so a group may hold any share of the rows. The nearest share is exact: only the rows that a sketch
cannot place are put in order, some six in a thousand. Very long texts are counted whole, in their row. At equal
distance to the nearest share's edge, all rows belong to it. Columns other than doc_id, text, lang and source are
ignored, whatever their names. Null text: no words. Null lang or source: a group of its own. Small groups and constant statistics: the scatter
is drawn towards that of ``prior`` rows of unit spread, and no spread counts as less than the floor of its statistic.
Repeated rows get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmill.llm.common import stored, table
from glossmill.session import computed_once

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GROUP = ["group_lang", "group_source"]
#: Transformed statistics, each with the least spread it is taken to have. Most documents repeat nothing, so the nearest
#: three quarters have no spread there at all and the floor decides: by repetition alone, a document goes from 58 % of
#: its lines, or 38 % of its words, on.
FLOORS = {"log_words": 0.5, "word_length": 0.5, "symbol_share": 0.5, "dup_line_root": 0.12, "repeat_share": 0.06}
#: Fixed values for five statistics and three quarters of the rows: scatter of the nearest rows to scatter of all.
SHARE, CONSISTENCY = 0.75, 1.41
ACCURACY = 1000  # of the sketches: ranks are right to a thousandth of a group's rows
MOST_GROUPS = 20_000  # of which the figures, some 200 bytes each, are broadcast
SALTS = 16


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are sorted by hash with their places; neighbours with equal hashes repeat. Each place in order then covers
    three words less those that the one before it covers.
    """
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    by_hash = F.array_sort(hashed)

    def places(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i).h == F.get(s, j).h, F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(at, lambda i: F.get(s, i).p))

    covered = F.aggregate(
        # A list of one holds the sorted windows, so that they are sorted once.
        F.flatten(F.transform(F.array(by_hash), places)),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a.n)
    return F.when(F.size(words) >= 3, covered).otherwise(0).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source with the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    held = computed_once(docs.select("doc_id", "lang", "source", text.alias("text")), "words", words)
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    return held.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.aggregate(F.array(lines), F.lit(0), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def transformed(counts: DataFrame) -> DataFrame:
    """Base verdict, group and statistics."""
    n = F.greatest("n_words", F.lit(1))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "group_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")),
        "group_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.log1p(1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "dup_line_root": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeat_share": F.col("n_repeat_words") / n,
    })


def with_group(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """rows with the figures of their group, a stored table of one row for each group.

    Few groups are broadcast, so that the rows stay where they are. Many are joined by group and salt, so that a group
    with a large share of the rows is spread.
    """
    if figures.count() <= MOST_GROUPS:
        return rows.join(F.broadcast(figures), GROUP)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*GROUP, "salt"]).drop("salt")


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's centre."""
    solved: list[Column] = []
    for i in range(len(FLOORS)):
        left = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * solved[j]
        solved.append(left / F.col(f"l{i}{i}"))
    return with_group(rows, estimates).withColumn("d2", sum((y * y for y in solved), F.lit(0.0)))


def nearest_moments(near: DataFrame) -> DataFrame:
    """Number, sums and sums of products of the nearest share of each group's rows, exact to the row.

    Sketches bracket the share's edge. Rows below the bracket are summed at once, those inside it by distance, and the
    share ends where their running number does. An edge from a sketch alone would move by its error in each step, and so
    would the determinants of large groups: the steps would go on by chance, the longer the more rows there are.
    """
    p = range(len(FLOORS))
    sums = {"n": F.lit(1), **{f"s{i}": F.col(f"z{i}") for i in p},
            **{f"s{i}{j}": F.col(f"z{i}") * F.col(f"z{j}") for i in p for j in range(i + 1)}}
    off = 3 / ACCURACY
    bracket = stored(near.groupBy(*GROUP).agg(
        F.ceil(SHARE * F.count("*")).alias("wanted"),
        F.percentile_approx("d2", [SHARE - off, SHARE + off], ACCURACY).alias("edges")), "edges")
    below = with_group(near, bracket).filter(F.col("d2") <= F.col("edges")[1])
    by_distance = below.groupBy(*GROUP, "wanted", F.when(F.col("d2") >= F.col("edges")[0], F.col("d2")).alias("at")).agg(
        *(F.sum(x).alias(name) for name, x in sums.items()))
    nearer = F.sum("n").over(Window.partitionBy(*GROUP).orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, -1))
    inside = by_distance.withColumn("nearer", F.coalesce(nearer, F.lit(0))).filter("nearer < wanted")
    return inside.groupBy(*GROUP).agg(*(F.sum(name).alias(name) for name in sums))


def factored(moments: DataFrame, prior: float) -> DataFrame:
    """Means, lower triangular factor of the scatter and half the logarithm of its determinant of each group.

    ``moments`` also has the floor of each statistic in its unit, ``f0`` and so on.
    """
    p = range(len(FLOORS))
    out = moments.select(*GROUP, *(f"f{i}" for i in p), "n", *(F.col(f"s{i}") / F.col("n") for i in p), *(f"s{i}{j}" for i in p for j in range(i + 1)))
    out = out.toDF(*GROUP, *(f"f{i}" for i in p), "n", *(f"m{i}" for i in p), *(f"s{i}{j}" for i in p for j in range(i + 1)))
    for i in p:
        for j in range(i + 1):
            scatter = CONSISTENCY * (F.col(f"s{i}{j}") - F.col("n") * F.col(f"m{i}") * F.col(f"m{j}"))
            value = (scatter + (prior if i == j else 0.0)) / (F.col("n") + prior)
            if i == j:  # no nearest subset may shrink a spread below the floor
                value = F.greatest(value, F.col(f"f{i}") * F.col(f"f{i}"))
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The diagonal cannot fall to zero: correlated statistics keep a tenth of their spread.
            root = F.sqrt(F.greatest(value, 0.01 * F.col(f"f{i}") * F.col(f"f{i}"))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", root)
    half = sum((F.log(f"l{i}{i}") for i in p), F.lit(0.0)).alias("half_log_det")
    return out.select(*GROUP, *(f"m{i}" for i in p), *(f"l{i}{j}" for i in p for j in range(i + 1)), half)


def outlier_rules(docs: DataFrame, steps: int = 100, cutoff: float = 40.0, prior: float = 20.0) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 (null where a base rule failed) and kept.

    ``docs`` has doc_id, text, lang and source. ``cutoff`` is a squared distance; for normal statistics of clean
    documents 40 is exceeded once in several million. ``steps`` only ends what rounding might keep going.
    """
    p = range(len(FLOORS))
    rows = stored(transformed(text_counts(docs)), "counts")
    passed = rows.filter(~F.col("base_failed"))
    # First estimate: medians, and quartiles for the unit of each statistic.
    quartiles = passed.groupBy(*GROUP).agg(*(
        F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i, x in enumerate(FLOORS)))
    unit = quartiles.select(*GROUP, *(F.col(f"q{i}")[1].alias(f"c{i}") for i in p), *(
        F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floor)).alias(f"u{i}")
        for i, floor in enumerate(FLOORS.values())))
    unit = stored(unit, "units")
    scaled = stored(with_group(passed, unit).select(*GROUP, "doc_id", *COUNTS, *(
        ((F.col(x) - F.col(f"c{i}")) / F.col(f"u{i}")).alias(f"z{i}") for i, x in enumerate(FLOORS))), "scaled")
    floors = stored(unit.select(*GROUP, *((F.lit(floor) / F.col(f"u{i}")).alias(f"f{i}") for i, floor in enumerate(FLOORS.values()))), "floors")
    identity = {"half_log_det": F.lit(0.0)} | {f"m{i}": F.lit(0.0) for i in p} | {f"l{i}{j}": F.lit(float(i == j)) for i in p for j in range(i + 1)}
    estimates = unit.select(*GROUP).withColumns(identity)
    for step in range(steps):
        moments = nearest_moments(with_distance(scaled, estimates))
        before, estimates = estimates, stored(factored(with_group(moments, floors), prior), "estimates")
        change = with_group(before.select(*GROUP, F.col("half_log_det").alias("old")), estimates)
        # The first step leaves the unit scatter, so its determinant may also rise.
        if step and not (change.agg(F.max(F.col("old") - F.col("half_log_det"))).first()[0] or 0) > 1e-3:
            break
    judged = with_distance(scaled, estimates).select("doc_id", *COUNTS, F.lit(False).alias("base_failed"), F.col("d2").alias("distance2"))
    failed = rows.filter("base_failed").select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance2"))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff))


def op6_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_rules(table(spark, sf_dir, "documents"))
