"""Quality rules: base statistics and robust multivariate outliers, in DataFrame functions alone.

Base: words are runs without space and \\t..\\r.  n_repeat_words counts the words that lie in a five-word window which occurs twice
or more in the text (windows are compared by a 64-bit hash of hashes).  base_failed: n_words < 10, or over 20 % repeated.

Outliers: of the rows that pass the base rules, each gives a vector of FEATURES transformed statistics.  For each language and source (null is
a value of its own) the minimum-covariance-determinant estimate is sought: of all choices of the SHARE of rows, the mean and covariance of the one
whose covariance has the least determinant.  It starts three times, from medians and median deviations, from the mean and covariance of all
rows, and from those weighted by the inverse squared distance, which far rows hardly move.  Each start repeats C-steps (the SHARE of rows with the
least distances under an estimate give the next one) for as long as a step lowers a determinant; the least one counts.  The covariance gets
the factor that makes it consistent for normal data, and FLOOR squared is added to its diagonal, so statistics that are almost always zero don't
make it singular.  A row is rejected beyond the chi-square quantile TAIL.  Rows of groups with fewer than LEAST such rows are judged by a pooled
estimate found in the same way: their language's, or that of all rows if the language has too few as well.

Scale: texts are read once and give a narrow table; each step aggregates it to one row per group and start.  Order statistics come from counts of
fixed bins, which add up in any order, so no group is ever gathered in one task; the share of a C-step is met to one bin of the distance.

Nulls and edge cases: a null or empty text has no words and fails the base rules.  Rows with a null id, repeated rows and ties are
judged like any other; texts may be of any length.  An empty table gives an empty one.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, materialize

SHARE, TAIL, LEAST, BINS = 0.75, 1 - 1e-7, 30, 64
#: Bins of the logs of distances; a step that lowers no log determinant by over CLOSE is the last, and so is step number STEPS.
FINE, CLOSE, STEPS = 1024, 1e-6, 40
#: The pool of all rows.
ALL = "a"
FLOOR = {"x1": 0.25, "x2": 0.05, "x3": 0.1, "x4": 0.35, "x5": 0.15}
FEATURES = list(FLOOR)
_N = range(len(FEATURES))
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""

    def spans(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(found, lambda x: x["i"]))
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(5), p - a["last"])).alias("total")), lambda a: a["total"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, twice))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(hashes, lambda w: _let(windows(w), spans)))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # the arrays are used more than once below, so Spark keeps this projection apart
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SEPARATORS)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def _transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("x1"),
        F.log((F.col("word_chars") + 50) / (F.col("n_words") + 10)).alias("x2"),  # ten words of five characters steady short texts
        F.sqrt(F.col("n_symbols") / words).alias("x3"),
        F.log1p("n_dup_lines").alias("x4"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x5"),
    ]


def chi_square_cdf(x: float, df: int) -> float:
    a, term, total, k = df / 2, 1.0, 0.0, 0
    term = 1 / a
    while term > 1e-17 * max(total, 1e-300):
        total += term
        k += 1
        term *= (x / 2) / (a + k)
    return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < p else (low, mid)
    return low


#: Makes the covariance of the SHARE innermost rows that of all rows, for normal data.
CONSISTENT = SHARE / chi_square_cdf(chi_square_quantile(SHARE, len(FEATURES)), len(FEATURES) + 2)
CUTOFF = chi_square_quantile(TAIL, len(FEATURES))


def _quantiles(values: DataFrame, keys: list[str], value: Column, share: float, name: str, bins: int = BINS) -> DataFrame:
    """For each key the upper end of the bin in which the given share of the values is reached; bins are 1/bins wide."""
    # grouped as one struct, so that a group's counts are added up bin by bin in many tasks; by the group alone they would all go to the window's task
    counted = values.select(F.struct(*keys, F.floor(value * bins).alias("bin")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).select("k.*", "n")
    upto = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    reached = counted.withColumn("c", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).where(F.col("c") >= F.lit(share) * F.col("all"))
    return reached.groupBy(*keys).agg(((F.min("bin") + 1) / F.lit(float(bins))).alias(name))


def _wide(long: DataFrame, name: str) -> DataFrame:
    """(g, f, value) as one row for each g with columns name0, name1, ..."""
    return long.groupBy("g").agg(*(F.max(F.when(F.col("f") == i, F.col(name))).alias(f"{name}{i}") for i in _N))


def _long(rows: DataFrame, values: list[Column]) -> DataFrame:
    return rows.select("g", F.posexplode(F.array(*values)).alias("f", "v"))


_MEANS, _FACTORS = [f"m{i}" for i in _N], [f"l_{i}_{j}" for i in _N for j in range(i + 1)]


def _log_det() -> Column:
    """Log of the determinant of an estimate's covariance."""
    return 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in _N), F.lit(0.0))


def _cholesky(params: DataFrame, keys: list[str]) -> DataFrame:
    """Columns l_i_j (j <= i) of the Cholesky factor of the matrix in columns c_i_j."""
    for j in _N:
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))))
        below = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, len(FEATURES))}
        params = params.withColumns(below) if below else params
    return params.select(*keys, *_MEANS, *_FACTORS)


def _distance(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their key's parameters; null without any."""
    found = rows.join(params.select(*keys, *_MEANS, *_FACTORS), keys, "left")
    for i in _N:
        found = found.withColumn(f"z{i}", (F.col(FEATURES[i]) - F.col(f"m{i}") - sum((F.col(f"l_{i}_{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return found.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _N), F.lit(0.0))).select(*rows.columns, "d2")


def _estimate(rows: DataFrame, centre: DataFrame, keys: list[str], weight: Column, factor: float) -> DataFrame:
    """Weighted mean and covariance (times factor) of the rows of each key, as parameters; sums are taken around the group's centre."""
    origin = centre.select("g", *(F.col(f"m{i}").alias(f"o{i}") for i in _N))
    weighed = rows.join(origin, "g").withColumn("w", weight)
    dev = [F.col(FEATURES[i]) - F.col(f"o{i}") for i in _N]
    sums = weighed.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        *(F.sum(F.col("w") * dev[i]).alias(f"s{i}") for i in _N),
        *(F.sum(F.col("w") * dev[i] * dev[j]).alias(f"q_{i}_{j}") for i in _N for j in range(i + 1)),
    )
    means = sums.join(origin, "g").withColumns({f"m{i}": F.col(f"o{i}") + F.col(f"s{i}") / F.col("n") for i in _N})
    cov = {
        f"c_{i}_{j}": F.lit(factor) * (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))) + F.lit(FLOOR[FEATURES[i]] ** 2 if i == j else 0.0)
        for i in _N
        for j in range(i + 1)
    }
    return _cholesky(means.withColumns(cov), keys)


def _starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(medians of each group, parameters of its starts)."""
    centre = materialize(_wide(_quantiles(_long(rows, [F.col(x) for x in FEATURES]), ["g", "f"], F.col("v"), 0.5, "m"), "m"), "centre")
    off = rows.join(centre, "g")
    deviation = _wide(_quantiles(_long(off, [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(FEATURES)]), ["g", "f"], F.col("v"), 0.5, "s"), "s")
    plain = centre.join(deviation, "g")
    for i in _N:
        for j in range(i + 1):
            plain = plain.withColumn(f"l_{i}_{j}", F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOOR[FEATURES[i]])) if i == j else F.lit(0.0))
    plain = materialize(plain.select("g", F.lit(0).alias("start"), *_MEANS, *_FACTORS), "start")
    two = _distance(rows, plain, ["g"]).withColumn("start", F.explode(F.array(F.lit(1), F.lit(2))))
    weight = F.when(F.col("start") == 1, F.lit(1.0)).otherwise(1 / (F.col("d2") + 1e-6))
    return centre, materialize(plain.unionByName(_estimate(two, centre, ["g", "start"], weight, 1.0)), "starts")


def _estimates(rows: DataFrame) -> DataFrame:
    """Parameters (g, m*, l_*_*) of the least determinant found for each group of rows (g, x1..)."""
    keys = ["g", "start"]
    centre, params = _starts(rows)
    each = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    best = None
    for _ in range(STEPS):
        log = F.log(F.col("d2") + 1e-9)
        limit = materialize(_quantiles(_distance(each, params, keys), keys, log, SHARE, "most", FINE), "limit")
        inner = _distance(each, params, keys).join(limit, keys).where(log < F.col("most"))
        params = materialize(_estimate(inner, centre, keys, F.lit(1.0), CONSISTENT).withColumn("log_det", _log_det()), "estimate")
        if best is None:
            best = params
            continue
        lower = params.join(best.select(*keys, F.col("log_det").alias("before")), keys).where(F.col("log_det") < F.col("before") - CLOSE)
        if not lower.count():
            break
        # starts that have come to rest are left
        best = materialize(lower.drop("before").unionByName(best.join(lower.select(*keys), keys, "left_anti")), "best")
        params = lower.drop("before")
        each = each.join(params.select(*keys), keys, "left_semi")
    columns = [c for c in best.columns if c not in ("g", "log_det")]
    return best.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("p")).select("g", "p.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and pooled_distance (squared) and kept of each row of docs.

    distance is null where the group is too small for an estimate; pooled_distance is given there instead.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    rows = base_statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    group, pool = F.concat(F.lit("g"), name("lang"), F.lit("\t"), name("source")), F.concat(F.lit("l"), name("lang"))
    rows = materialize(rows.select("doc_id", group.alias("g"), pool.alias("pool"), *STATISTICS, failed.alias("base_failed")), "statistics")
    vectors = rows.select("*", *_transformed())
    # each group is judged by the first of itself, its language and all that has rows enough; estimates are made for those that judge
    sizes = materialize(rows.groupBy("g", "pool").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")), "sizes")
    pools = sizes.groupBy("pool").agg(F.sum("n").alias("m"))
    judge = F.when(F.col("n") >= LEAST, F.col("g")).when(F.col("m") >= LEAST, F.col("pool")).otherwise(ALL)
    judges = materialize(sizes.join(pools, "pool").select("g", judge.alias("judge")), "judges")
    members = F.explode(F.array_distinct(F.array("g", "pool", F.lit(ALL))))
    passing = vectors.where(~F.col("base_failed")).select(members.alias("g"), *FEATURES)
    params = _estimates(passing.join(judges.select(F.col("judge").alias("g")).distinct(), "g", "left_semi"))
    judged = _distance(vectors.join(judges, "g"), params.withColumnRenamed("g", "judge"), ["judge"])
    own = F.col("judge") == F.col("g")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", *STATISTICS, "base_failed", F.when(own, F.col("d2")).alias("distance"), F.when(~own, F.col("d2")).alias("pooled_distance"), kept.alias("kept"))
