"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gets counts, which plain rules judge first. The rest are judged by a vector of four transformed
statistics: logarithm of the mean word length, and the roots of symbols per word, of the share of words in
repeated windows and of the share of repeated lines. The roots even out variances, and a small constant
beside each count lets a rate of nought depend on how much text stands behind it, so that texts without
any hit spread as well. Per language and source the centre and covariance that the bulk of documents has
are estimated by minimum covariance determinant: from medians and absolute deviations on, each
concentration step takes the documents nearest to the centre (three quarters of the group) and computes
both from them. Two steps of reweighting follow, which take all documents within the 97.5 % quantile. In
both a factor on the covariance makes up for the cut. A document is an outlier if its squared Mahalanobis
distance exceeds the 99.9 % quantile of chi-square with four degrees.

The nearest documents are found by counting distances in bins of a 32nd of an octave, so a step is two
aggregations that combine before their shuffle, however large a group is. Where the variance that a statistic has
beside those before it falls below the square of a floor, the floor stands in: such a direction is degenerate, as with
symbols in a group of which no document has any. All other variances and all covariances stay as estimated. Groups of
few documents share one estimate.

Odd cases: a null or empty text has no words and fails the base rules, and so do white space and
texts below 50 words. Null languages and sources are values like any other. Only doc_id, text, lang and source are
read, one output row per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, WORD, let
from tallyframe.session import cut_lineage

#: Least deviations of a statistic beside those before it: the error of a mean of 200 word lengths, three symbols in
#: 300 words, a repeated line of nine words in 100, a repeated line of eight.
FLOORS = (0.03, 0.06, 0.06, 0.1)
STEPS, REWEIGHTED = 3, 2  # of concentration, and of reweighting after them
BULK = 0.75  # of a group's documents that concentration rests on
WITHIN = 11.1433  # chi-square with four degrees, at 0.975
#: By how much the covariance of a normal distribution exceeds that of its nearest BULK, and of its part WITHIN.
CONSISTENT, CONSISTENT_WITHIN = 1.485, 1.0645
LEAST_GROUP = 50  # documents; smaller groups share one estimate
CUTOFF, MEDIAN = 18.4668, 3.3567  # chi-square with four degrees, at 0.999 and 0.5
_D = range(4)
_BINS = 32


def repeated_words(words: Column) -> Column:
    """How many of an array's words lie in windows of three that are found twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
            hits = F.filter(s, lambda x, k: same(x, k + 1) | same(x, F.when(k > 0, k - 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["i"], x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, again))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), covered)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        without(" \t\n\x0b\f\r").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).alias("n_symbols"),
        counts.alias("counts"),
        of_lines.alias("lines"),
    )
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        "lang",
        "source",
        long(F.col("counts.n_words")).alias("n_words"),
        long(F.col("word_chars")).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"),
        long(F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"),
        long(F.col("counts.n_repeat_words")).alias("n_repeat_words"),
        long(F.col("lines.n")).alias("n_lines"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and, where it is false, the vector x0 to x3."""
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    x = (
        F.log(F.col("word_chars") / n),
        F.sqrt((F.col("n_symbols") + 0.375) / (n + 0.75)),
        F.sqrt((F.col("n_repeat_words") + 24) / (n + 48)),  # hits come in lines, not one by one
        F.sqrt((F.col("n_dup_lines") + 1) / (F.col("n_lines") + 2)),
    )
    stats = stats.withColumn("base_failed", failed)
    return stats.withColumns({f"x{i}": F.when(~F.col("base_failed"), v) for i, v in enumerate(x)})


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m under the precision matrix p, of which the upper half is stored."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in _D]
    terms = [(1 if i == j else 2) * F.col(f"p{i}{j}") * d[i] * d[j] for i in _D for j in _D if j >= i]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _precision(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, m0.., c00..) with the covariance c turned into its inverse p, by Cholesky, pivots at least floors."""
    keep = ["grp", *[f"m{i}" for i in _D]]
    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    for j in _D:  # lower triangle l, column by column; each step is a projection, so nothing is computed twice
        known = [F.col(f"l{j}{k}") for k in range(j)]
        own = c(j, j) - sum((k * k for k in known), F.lit(0.0))
        groups = groups.withColumn(f"l{j}{j}", F.sqrt(F.greatest(own, F.lit(FLOORS[j] ** 2))))
        below = {}
        for i in range(j + 1, 4):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}{j}"] = (c(i, j) - inner) / F.col(f"l{j}{j}")
        groups = groups.withColumns(below) if below else groups
    for i in _D:  # u: the inverse of l
        row = {f"u{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"u{k}{j}") for k in range(j, i)), F.lit(0.0))
            row[f"u{i}{j}"] = -inner / F.col(f"l{i}{i}")
        groups = groups.withColumns(row)
    p = {f"p{i}{j}": sum((F.col(f"u{k}{i}") * F.col(f"u{k}{j}") for k in range(j, 4)), F.lit(0.0)) for i in _D for j in _D if j >= i}
    return groups.withColumns(p).select(*keep, *p)


def _nearest(placed: DataFrame, share: float) -> DataFrame:
    """Per group the bin up to which at least ``share`` of the documents lie."""
    bins = placed.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("grp").orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy("grp"))
    reached = bins.withColumn("so_far", so_far).withColumn("every", every).filter(F.col("so_far") >= share * F.col("every"))
    return reached.groupBy("grp").agg(F.min("bin").alias("edge"))


def _placed(points: DataFrame, groups: DataFrame) -> DataFrame:
    bin_of = F.floor(_BINS * F.log2(F.col("d2") + 1e-6)).cast("int")
    return points.join(groups, "grp").withColumn("d2", _distance()).withColumn("bin", bin_of)


def estimates(points: DataFrame) -> DataFrame:
    """Per ``grp`` of ``points`` (grp, x0 to x3): centre m, precision p, and scale, stored."""
    middle = points.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in _D])
    middle = cut_lineage(middle, "middle")
    spread = points.join(middle, "grp").groupBy("grp", *[f"m{i}" for i in _D])
    spread = spread.agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i in _D])
    start = {f"c{i}{j}": (F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)) for i in _D for j in _D if j >= i}
    groups = cut_lineage(_precision(spread.withColumns(start)), "estimates")
    for step in range(STEPS + REWEIGHTED):
        placed = _placed(points, groups)
        edges = cut_lineage(_nearest(placed, BULK), "edges")
        reweighted = step >= STEPS
        near = placed.join(edges, "grp").filter((F.col("bin") <= F.col("edge")) | (F.lit(reweighted) & (F.col("d2") <= WITHIN)))
        d = [F.col(f"x{i}") - F.col(f"m{i}") for i in _D]
        sums = [F.avg(d[i]).alias(f"d{i}") for i in _D] + [F.avg(d[i] * d[j]).alias(f"q{i}{j}") for i in _D for j in _D if j >= i]
        moments = near.groupBy("grp", *[f"m{i}" for i in _D]).agg(*sums)
        factor = F.lit(CONSISTENT_WITHIN if reweighted else CONSISTENT)
        cov = {f"c{i}{j}": factor * (F.col(f"q{i}{j}") - F.col(f"d{i}") * F.col(f"d{j}")) for i in _D for j in _D if j >= i}
        moved = moments.withColumns(cov).withColumns({f"m{i}": F.col(f"m{i}") + F.col(f"d{i}") for i in _D})
        groups = cut_lineage(_precision(moved), "estimates")
    half = _nearest(_placed(points, groups), 0.5)
    scale = F.greatest(F.lit(1.0), F.pow(2.0, (F.col("edge") + 1) / _BINS) / MEDIAN).alias("scale")
    return cut_lineage(groups.join(half, "grp").select(*groups.columns, scale), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, distance (squared, scaled), kept."""
    by_name = F.to_json(F.struct("lang", "source"))
    rows = cut_lineage(vectors(statistics(docs)).withColumn("name", by_name).drop("lang", "source"), "statistics")
    good = rows.filter("not base_failed")
    large = cut_lineage(good.groupBy("name").count().filter(F.col("count") >= LEAST_GROUP).select("name", F.col("name").alias("grp")), "groups")
    grouped = rows.join(large, "name", "left").withColumn("grp", F.coalesce("grp", F.lit("")))
    found = estimates(grouped.filter("not base_failed").select("grp", *[f"x{i}" for i in _D]))
    distance = (_distance() / F.col("scale")).alias("distance")
    return grouped.join(found, "grp", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        distance,
        (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"),
    )
