"""Quality rules with robust multivariate outliers (operator 1); DataFrame functions only.

Five statistics of a text are transformed and rounded to whole steps of 1/``STEPS``. For every language and source the
minimum covariance determinant estimate is found by concentration steps from two fixed starts (medians with absolute
deviations, and means with variances): each step measures all documents' distances, keeps the nearest ``KEEP`` of a group
and re-estimates centre and scatter from them, until no determinant changes by a hundredth or more. The start with the
smaller determinant wins; one reweighting step follows. Documents beyond a chi-square bound of the squared distance are rejected.

Sums are of whole numbers and quantiles come from histograms of distances, so results don't depend on partitioning.
A group's estimate is one row; documents are only summed and never gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

STATS = ("z_length", "z_word", "z_symbols", "z_lines", "z_repeats")
STEPS = 64
#: Least standard deviation of each statistic, so that a statistic that hardly varies rejects nothing by itself.
FLOORS = {"z_length": 0.25, "z_word": 0.08, "z_symbols": 0.08, "z_lines": 0.15, "z_repeats": 0.15}
KEEP = 0.75
LEAST_GROUP = 40
#: Upper tail of the chi-square distribution beyond which a document is rejected.
TAIL = 1e-6
DIST_BINS_PER_OCTAVE = 32
#: Concentration steps end when no group's log determinant changes by more than this.
SETTLED = 1e-2


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution's share below x, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float, k: int) -> float:
    """What the scatter of the nearest ``share`` of a normal sample is multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text, in one pass without a shuffle.

    A null text has no words. Repeats are found within a row: equal 5-word windows meet by sorting the windows' hashes
    with their places, and only in texts that have any.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = common.words_of(F.col("text"))
    base = docs.select("doc_id", "lang", "source", text.alias("text"), words.alias("words"))
    n = F.size("words")
    # 96 bits of each window, with its place
    window = lambda i: F.struct(F.xxhash64(*[F.get("words", i + k) for k in range(5)]).alias("a"), F.hash(*[F.get("words", i + k) for k in range(5)]).alias("b"), i.alias("i"))
    quick = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    counted = base.select(
        "doc_id",
        "lang",
        "source",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", common.WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= 10, quick).alias("quick"),
        F.when((n >= 5) & (n < 10), quick).alias("few"),
    )
    grams = F.coalesce("quick", "few")
    counted = counted.select(
        "doc_id", "lang", "source", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(grams.isNotNull() & (F.size(F.array_distinct(grams)) < F.size(grams)), F.lit(True)).otherwise(F.lit(False)).alias("repeats"),
    )
    placed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 5), window))
    same = lambda x, at: F.coalesce((F.get("placed", at)["a"] == x["a"]) & (F.get("placed", at)["b"] == x["b"]), F.lit(False))
    marked = counted.withColumn("placed", F.when(F.col("repeats"), placed)).drop("words")
    starts = F.filter("placed", lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False)))
    marked = marked.withColumn("starts", F.sort_array(F.transform(starts, lambda x: x["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("int").alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n"), i.cast("int").alias("last")),
        lambda acc: acc["n"],
    )
    return marked.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector(df: DataFrame) -> DataFrame:
    """The transformed statistics as whole steps; a document without words gets zeros."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    z = {
        "z_length": F.log(n),
        "z_word": F.log((F.col("word_chars") + 1) / n),
        "z_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "z_lines": F.sqrt(F.least(F.col("n_dup_lines") / n, F.lit(1.0))),
        "z_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    return df.withColumns({k: F.round(v * STEPS).cast("long") for k, v in z.items()})


def _cholesky(df: DataFrame, cov: dict[tuple[int, int], str], out: str) -> DataFrame:
    """Columns ``out``_i_j of the lower factor, and ``out``_det, the log of the determinant."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(cov[i, j])
            for k in range(j):
                rest = rest - F.col(f"{out}_{i}_{k}") * F.col(f"{out}_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"{out}_{j}_{j}")
            df = df.withColumn(f"{out}_{i}_{j}", value)
    return df.withColumn(f"{out}_det", reduce(lambda a, b: a + b, [2 * F.log(F.col(f"{out}_{i}_{i}")) for i in range(p)]))


def _squared_distance(prefix: str) -> Column:
    """Mahalanobis distance of the whole-step statistics from one estimate's centre, by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"{prefix}_m_{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"{prefix}_{i}_{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in solved])


def _sum_names() -> list[str]:
    p = len(STATS)
    return ["_n", *(f"s_{i}" for i in range(p)), *(f"s_{i}_{j}" for i in range(p) for j in range(i + 1))]


def _sums() -> list[Column]:
    """Exact sums of the statistics and of their products."""
    p = len(STATS)
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return [F.count(F.lit(1)).alias("_n"), *(F.sum(s).alias(f"s_{i}") for i, s in enumerate(STATS)), *products]


def _estimate(g: DataFrame, by: list[str], prefix: str, factor: float) -> DataFrame:
    """Centres and scatter of groups from their sums; the scatter times ``factor`` plus the floors' variances, factored."""
    p, n = len(STATS), F.col("_n").cast("double")
    g = g.withColumns({f"{prefix}_m_{i}": F.col(f"s_{i}") / n for i in range(p)})
    cov = {(i, j): f"c_{i}_{j}" for i in range(p) for j in range(i + 1)}
    floors = [(FLOORS[s] * STEPS) ** 2 for s in STATS]
    g = g.withColumns({c: (F.col(f"s_{i}_{j}") / n - F.col(f"{prefix}_m_{i}") * F.col(f"{prefix}_m_{j}")) * F.lit(float(factor)) + F.lit(floors[i] if i == j else 0.0) for (i, j), c in cov.items()})
    return _cholesky(g, cov, prefix).select(*by, *_names(prefix))


def _names(prefix: str) -> list[str]:
    p = len(STATS)
    return [*(f"{prefix}_m_{i}" for i in range(p)), *(f"{prefix}_{i}_{j}" for i in range(p) for j in range(i + 1)), f"{prefix}_det"]


def _histogram_quantile(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """The first bin at which the running count reaches ``share`` of a group: by, cut."""
    w = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    return upto.filter(F.col("_upto") >= F.col("_all") * share).groupBy(*by).agg(F.min("bin").alias("cut"))


def _median_start(rows: DataFrame, prefix: str) -> DataFrame:
    """Centres at the medians and a diagonal scatter of 1.4826 times the median absolute deviations."""
    p = len(STATS)
    out = None
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).alias("bin")) for i, s in enumerate(STATS)])).alias("x")).select("grp", "x.i", "x.bin")
    counts = long.groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    medians = _histogram_quantile(counts, ["grp", "i"], 0.5)
    far = counts.join(medians, ["grp", "i"]).groupBy("grp", "i", F.abs(F.col("bin") - F.col("cut")).alias("away")).agg(F.sum("n").alias("n"), F.first("cut").alias("mid"))
    spread = _histogram_quantile(far.withColumnRenamed("away", "bin"), ["grp", "i"], 0.5).withColumnRenamed("cut", "mad")
    both = medians.join(spread, ["grp", "i"])
    out = both.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, F.col("cut"))).cast("double").alias(f"{prefix}_m_{i}") for i in range(p)], *[F.max(F.when(F.col("i") == i, F.col("mad"))).cast("double").alias(f"mad_{i}") for i in range(p)])
    for i in range(p):
        out = out.withColumn(f"{prefix}_{i}_{i}", F.sqrt(F.pow(1.4826 * F.col(f"mad_{i}"), 2) + F.lit((FLOORS[STATS[i]] * STEPS) ** 2)))
        for j in range(i):
            out = out.withColumn(f"{prefix}_{i}_{j}", F.lit(0.0))
    return out.withColumn(f"{prefix}_det", F.lit(0.0)).select("grp", *_names(prefix))


def judge(stats: DataFrame, tail: float = TAIL, rounds: int = 7, keep: float = KEEP, least_group: int = LEAST_GROUP) -> DataFrame:
    """``stats`` with base_failed, distance2 and kept.

    Estimates use documents that the base rules pass. A language and source with fewer than ``least_group`` of those is
    judged with the other small ones of its language, and if these are too few with those of all languages; if even
    these are too few, the base rules decide alone. Null languages and sources are groups like any other.
    """
    p = len(STATS)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = common.materialise(_vector(stats.withColumn("base_failed", base)), "quality-stats")
    good = rows.filter(~F.col("base_failed"))
    size = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least_group
    of_lang = Window.partitionBy("lang")
    size = size.withColumn("small_n", F.sum(F.when(small, F.col("n")).otherwise(0)).over(of_lang))
    name = F.concat_ws("|", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    pooled = F.when(F.col("small_n") >= least_group, F.concat(F.lit("pool|"), F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")))).otherwise(F.lit("pool"))
    groups = size.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.when(small, pooled).otherwise(F.concat(F.lit("own|"), name)).alias("grp"))
    rows = rows.join(groups, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left").drop("gl", "gs")
    rows = common.materialise(rows.withColumn("grp", F.coalesce("grp", F.lit("pool"))), "quality-groups")
    good = rows.filter(~F.col("base_failed")).select("grp", *STATS)

    factor = consistency(keep, p)
    estimates = _median_start(good, "a").join(_estimate(good.groupBy("grp").agg(*_sums()), ["grp"], "b", 1.0), "grp")
    estimates = common.materialise(estimates, "quality-start")
    for k in range(rounds):
        both = good.join(estimates, "grp")
        split = both.select("grp", *STATS, F.explode(F.array(*[F.struct(F.lit(s).alias("start"), _squared_distance(s).alias("d2")) for s in ("a", "b")])).alias("x")).select("grp", *STATS, "x.start", "x.d2")
        split = split.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-3) * DIST_BINS_PER_OCTAVE).cast("int"))
        # sums of every distance bin; those of the nearest bins make the next estimate, so a step reads its rows once
        sums = split.groupBy("grp", "start", "bin").agg(*_sums())
        near = Window.partitionBy("grp", "start")
        before = F.coalesce(F.sum("_n").over(near.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nearest = sums.withColumn("_before", before).withColumn("_all", F.sum("_n").over(near)).filter(F.col("_before") < F.col("_all") * keep)
        moments = _estimate(nearest.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in _sum_names()]), ["grp", "start"], "e", factor)
        sides = moments.groupBy("grp").agg(*[F.max(F.when(F.col("start") == s, F.col(c))).alias(s + c[1:]) for s in ("a", "b") for c in _names("e")])
        before, estimates = estimates.select(F.col("grp").alias("g"), F.col("a_det").alias("a"), F.col("b_det").alias("b")), common.materialise(sides, f"quality-step-{k}")
        change = F.max(F.greatest(F.abs(F.col("a_det") - F.col("a")), F.abs(F.col("b_det") - F.col("b"))))
        if k and (estimates.join(before, F.col("grp") == F.col("g")).agg(change).head()[0] or 0.0) < SETTLED:
            break
    first = F.col("a_det") <= F.col("b_det")
    estimates = estimates.select("grp", *[F.when(first, F.col("a" + c[1:])).otherwise(F.col("b" + c[1:])).alias(c) for c in _names("e")])
    near = good.join(estimates, "grp").filter(_squared_distance("e") <= chi2_quantile(0.975, p))
    final = _estimate(near.groupBy("grp").agg(*_sums()), ["grp"], "e", consistency(0.975, p))
    counts = good.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_n")).filter(F.col("grp_n") >= least_group)
    final = common.materialise(final.join(counts, "grp").withColumnRenamed("grp", "fg"), "quality-final")
    judged = rows.join(final, F.col("grp") == F.col("fg"), "left").withColumn("distance2", F.round(_squared_distance("e"), 6))
    far = F.coalesce(F.col("distance2") > chi2_quantile(1 - tail, p), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(*stats.columns, "base_failed", "distance2", "kept")


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, base_failed, distance2 (null without an estimate) and kept of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2. Null and
    empty texts have no words and fail the base rules. Repeated rows are judged one by one. An empty table gives no rows.
    """
    out = judge(text_statistics(docs), **options)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
