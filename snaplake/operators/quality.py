"""Data quality: profiles, rules, anomalies, schema drift, score and history."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for a missing value (fixed values).
PLACEHOLDERS = ("", "n/a", "unknown", "undef", "none", "null", "-", "tbd", "na", "not available")
BUCKETS, TOP = 10, 10
#: Thresholds of anomalies (fixed values).
THRESHOLDS = {"row_count_pct": 30.0, "freshness_hours": 24.0, "size_pct": 50.0, "null_rate_pp": 5.0, "distinct_pct": 50.0, "zero_rate_pp": 5.0, "negative_rate_pp": 5.0, "mean_sigma": 2.0}


def category(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "numeric" if isinstance(t, T.NumericType) else "other"


def quick_profile(df: DataFrame, since: tuple[str, Any] | None = None) -> DataFrame:
    """One row per column: counts, rates, bounds.  All columns are aggregated in one pass, then turned into rows.

    since: (column, value): only rows whose column is greater.
    """
    if since:
        df = df.where(F.col(since[0]) > F.lit(since[1]))
    stats = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), category(f.dataType)
        number = c.cast("double") if kind == "numeric" else F.lit(None).cast("double")
        bounded = kind in ("numeric", "date")
        stats.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(kind).alias("category"),
                F.count("*").alias("total"),
                F.count(c).alias("present"),
                (F.countDistinct(c) if kind != "other" else F.lit(None).cast("long")).alias("distinct_count"),
                (F.min(c).cast("string") if bounded else F.lit(None).cast("string")).alias("min_value"),
                (F.max(c).cast("string") if bounded else F.lit(None).cast("string")).alias("max_value"),
                F.avg(number).alias("avg_value"),
                F.stddev(number).alias("stddev_value"),
                F.count(F.when(number == 0, 1)).alias("zeros"),
                F.count(F.when(number < 0, 1)).alias("negatives"),
            )
        )
    rows = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    rate = lambda n, d: F.when(d > 0, F.round(100.0 * n / d, 2)).otherwise(F.lit(0.0))
    return rows.select(
        "column_name",
        "category",
        "total",
        (F.col("total") - F.col("present")).alias("null_count"),
        rate(F.col("total") - F.col("present"), F.col("total")).alias("null_rate"),
        "distinct_count",
        rate(F.col("distinct_count"), F.col("present")).alias("uniqueness"),
        "min_value",
        "max_value",
        F.round("avg_value", 4).alias("avg_value"),
        F.round("stddev_value", 4).alias("stddev_value"),
        rate(F.col("zeros"), F.col("present")).alias("zero_rate"),
        rate(F.col("negatives"), F.col("present")).alias("negative_rate"),
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, Shannon entropy, share of the values of rank 1..TOP (ties included)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    # one pass over the counts: sums of n and of n log2 n give the entropy, a list of the TOP largest counts and what ties with the last one give the share
    many = F.map_from_entries(F.slice(F.sort_array(F.collect_list(F.struct("n", "k")), False), 1, TOP))
    alike = counts.groupBy("n").agg(F.count("*").alias("k"))  # how many values have each count
    one = alike.agg(F.sum(F.col("n") * F.col("k")).alias("total"), F.sum("k").alias("unique_count"), F.sum(F.col("k") * F.col("n") * F.log2("n")).alias("s"))
    largest = alike.orderBy(F.desc("n")).limit(TOP).agg(many.alias("m"))
    # counts from the largest on are taken until TOP values are in
    taken = F.aggregate(F.sort_array(F.map_keys("m"), False), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("rows")), lambda a, n: F.when(a["seen"] < TOP, F.struct((a["seen"] + F.col("m")[n]).alias("seen"), (a["rows"] + n * F.col("m")[n]).alias("rows"))).otherwise(a))
    return one.crossJoin(F.broadcast(largest)).select("unique_count", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"), F.round(100.0 * taken["rows"] / F.col("total"), 4).alias("top_coverage"))


def top_values(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(TOP)


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Ten buckets of equal counts: their bounds and sizes, as NTILE makes them (ties broken by the value).

    Equal values are counted first and ranked by running sums over their distinct values' counts within range
    partitions, so no task sorts all rows.
    """
    counts = df.where(value.isNotNull()).groupBy(value.cast("double").alias("v")).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    within = ordered.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    per = ordered.groupBy("p").agg(F.sum("n").alias("m"))
    before = per.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    total = counts.agg(F.sum("n").alias("total"))
    ranked = within.join(F.broadcast(before.select("p", "base")), "p").crossJoin(F.broadcast(total)).select("v", (F.col("base") + F.col("upto") - F.col("n")).alias("a"), (F.col("base") + F.col("upto")).alias("b"), "total")
    # NTILE: the first total % 10 buckets have one row more
    size, more = F.floor(F.col("total") / BUCKETS), F.col("total") % BUCKETS
    at = lambda row: F.when(row < more * (size + 1), F.floor(row / (size + 1))).otherwise(more + F.floor((row - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    parts = ranked.select("*", F.explode(F.sequence(at(F.col("a")).cast("int"), at(F.col("b") - 1).cast("int"))).alias("bucket"))
    start = (F.col("bucket") - 1) * size + F.least(F.col("bucket") - 1, more)
    stop = F.col("bucket") * size + F.least(F.col("bucket"), more)
    inside = F.least(F.col("b"), stop) - F.greatest(F.col("a"), start)
    return parts.withColumn("k", inside).groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("k").cast("long").alias("n"))


def deep_numeric(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`").cast("double")
    base = df.agg(
        F.count("*").alias("total"),
        F.round(F.avg(c), 4).alias("avg_value"),
        F.round(F.variance(c), 4).alias("var_value"),
        F.round(F.stddev(c), 4).alias("stddev_value"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        F.round(F.percentile(c, 0.25), 4).alias("p25"),
        F.round(F.percentile(c, 0.5), 4).alias("median_value"),
        F.round(F.percentile(c, 0.75), 4).alias("p75"),
        F.round(100.0 * F.count(F.when(c.isNull() | (c == 0), 1)) / F.count("*"), 4).alias("zero_or_null_rate"),
        F.round(100.0 * F.count(F.when(c < 0, 1)) / F.count("*"), 4).alias("negative_rate"),
    )
    return base.crossJoin(F.broadcast(frequencies(df, column)))


def deep_string(df: DataFrame, column: str) -> DataFrame:
    c, n = F.col(f"`{column}`"), F.length(F.col(f"`{column}`"))
    base = df.agg(
        F.count("*").alias("total"),
        F.round(F.avg(n), 4).alias("avg_length"),
        F.round(F.variance(n), 4).alias("var_length"),
        F.min(n).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"),
        F.percentile(n, 0.5).alias("median_length"),
        F.round(100.0 * F.count(F.when(F.lower(c).isin(*PLACEHOLDERS), 1)) / F.count("*"), 4).alias("placeholder_rate"),
    )
    return base.crossJoin(F.broadcast(frequencies(df, column)))


@dataclass
class Rule:
    """kind: column_min, column_max, null_rate_max, row_count_min, distinct_in, condition."""

    name: str
    kind: str
    column: str | None = None
    value: Any = None
    severity: str = "warning"


def _measure(r: Rule) -> Column:
    c = F.col(f"`{r.column}`") if r.column else None
    if r.kind == "column_min":
        return F.min(c).cast("double")
    if r.kind == "column_max":
        return F.max(c).cast("double")
    if r.kind == "null_rate_max":
        return F.round(100.0 * F.count(F.when(c.isNull(), 1)) / F.greatest(F.count("*"), F.lit(1)), 4)
    if r.kind == "row_count_min":
        return F.count("*").cast("double")
    if r.kind == "distinct_in":
        return F.count(F.when(~c.isin(list(r.value)), 1)).cast("double")
    if r.kind == "condition":
        return F.count(F.when(~F.coalesce(r.value, F.lit(False)), 1)).cast("double")
    raise ValueError(f"rule kind {r.kind!r} isn't known")


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_name, kind, measured, status ("ok" or the rule's severity); one pass for all rules."""
    ok = {
        "column_min": lambda m, v: m >= float(v),
        "column_max": lambda m, v: m <= float(v),
        "null_rate_max": lambda m, v: m <= float(v),
        "row_count_min": lambda m, v: m >= float(v),
        "distinct_in": lambda m, v: m == 0,
        "condition": lambda m, v: m == 0,
    }
    row = df.agg(*(_measure(r).alias(f"m{i}") for i, r in enumerate(rules)))
    out = [
        F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.kind).alias("kind"), F.col(f"m{i}").alias("measured"), F.when(ok[r.kind](F.col(f"m{i}"), r.value), "ok").otherwise(r.severity).alias("status"))
        for i, r in enumerate(rules)
    ]
    return row.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def anomalies(now: DataFrame, before: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Changes between two quick profiles beyond the thresholds: column_name (null: the table), anomaly, change and severity.

    Critical from over twice the threshold on; breaches of the bounds and of the rates of zeros and negatives are warnings.  Bounds of numbers are
    compared as numbers, those of dates as text.
    """
    t = {**THRESHOLDS, **(thresholds or {})}
    j = now.alias("a").join(before.alias("b"), "column_name")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    percent = lambda x, y: F.when(y > 0, 100.0 * F.abs(x - y) / y)
    numeric = a("category") == "numeric"
    less = lambda x, y: F.when(numeric, x.cast("double") < y.cast("double")).otherwise(x < y)
    breaches = F.coalesce(less(a("min_value"), b("min_value")), F.lit(False)).cast("int") + F.coalesce(less(b("max_value"), a("max_value")), F.lit(False)).cast("int")
    graded = [
        ("null_rate", a("null_rate") - b("null_rate"), t["null_rate_pp"]),
        ("mean_shift", F.when(b("stddev_value") > 0, F.abs(a("avg_value") - b("avg_value")) / b("stddev_value")), t["mean_sigma"]),
        ("distinct_count", percent(a("distinct_count"), b("distinct_count")), t["distinct_pct"]),
    ]
    plain = [
        ("zero_rate", F.when(numeric, a("zero_rate") - b("zero_rate")), t["zero_rate_pp"]),
        ("negative_rate", F.when(numeric, a("negative_rate") - b("negative_rate")), t["negative_rate_pp"]),
        ("bounds", breaches.cast("double"), 0.0),
    ]
    found = [F.struct(F.lit(name).alias("anomaly"), F.round(change, 4).alias("change"), F.lit(limit).alias("limit"), F.lit(may).alias("graded")) for group, may in ((graded, True), (plain, False)) for name, change, limit in group]
    rows = j.select("column_name", F.explode(F.array(*found)).alias("x")).select("column_name", "x.*")
    sizes = now.agg(F.max("total").alias("x")).crossJoin(before.agg(F.max("total").alias("y")))
    table = sizes.select(F.lit(None).cast("string").alias("column_name"), F.lit("row_count").alias("anomaly"), F.round(percent(F.col("x"), F.col("y")), 4).alias("change"), F.lit(t["row_count_pct"]).alias("limit"), F.lit(True).alias("graded"))
    over = table.unionByName(rows).where(F.col("change") > F.col("limit"))
    return over.select("column_name", "anomaly", "change", F.when(F.col("graded") & (F.col("change") > 2 * F.col("limit")), "critical").otherwise("warning").alias("severity"))


def table_anomalies(now: dict[str, Any], before: dict[str, Any] | None, thresholds: dict[str, float] | None = None) -> list[dict[str, Any]]:
    """Findings about a table as a whole: not updated for too long, or its bytes changed too much; each has hours (since the last write) and bytes."""
    t, out = {**THRESHOLDS, **(thresholds or {})}, []
    if now["hours"] > t["freshness_hours"]:
        out.append({"column_name": None, "anomaly": "freshness", "change": round(now["hours"], 4), "severity": "warning"})
    if before and before.get("bytes"):
        change = 100.0 * abs(now["bytes"] - before["bytes"]) / before["bytes"]
        if change > t["size_pct"]:
            out.append({"column_name": None, "anomaly": "table_size", "change": round(change, 4), "severity": "critical" if change > 2 * t["size_pct"] else "warning"})
    return out


def schema_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")


def schema_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """column_name, change (added, removed, type_changed), old and new type; inputs are schema_rows()."""
    j = now.select("column_name", F.col("data_type").alias("new_type")).join(before.select("column_name", F.col("data_type").alias("old_type")), "column_name", "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type_changed")
    return j.select("column_name", change.alias("change"), "old_type", "new_type").where("change is not null")


def score(profile: DataFrame, rule_rows: DataFrame | None = None) -> DataFrame:
    """One row: 100, less the missing completeness, 10 for each critical finding and 5 for each warning, within 0..100."""
    full = profile.agg(F.avg(100.0 - F.col("null_rate")).alias("completeness"))
    found = rule_rows.agg(F.count(F.when(F.col("status") == "critical", 1)).alias("critical"), F.count(F.when(F.col("status") == "warning", 1)).alias("warnings")) if rule_rows is not None else profile.sparkSession.range(1).select(F.lit(0).cast("long").alias("critical"), F.lit(0).cast("long").alias("warnings"))
    raw = 100.0 - (100.0 - F.col("completeness")) - 10 * F.col("critical") - 5 * F.col("warnings")
    return full.crossJoin(found).select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 0))).cast("int").alias("quality_score"), F.round("completeness", 4).alias("completeness"), "critical", "warnings")


def may_run(now: float, pending_since: float | None, last_run: float | None, running: bool, cooldown: float = 300.0) -> bool:
    """Whether a check that ingestion asked for shall start: none runs, and the last one is long enough ago."""
    return pending_since is not None and not running and (last_run is None or now - last_run >= cooldown)


def configure_checks(lake, thresholds: dict[str, float], table: str | None = None) -> None:
    """Sets thresholds of anomalies for one table, or for all that have none of their own."""
    if unknown := set(thresholds) - set(THRESHOLDS):
        raise ValueError(f"thresholds {sorted(unknown)} aren't known")
    lake.store.write_json(f"{lake.path}/_quality/{table or '__all__'}.json", thresholds, overwrite=True)


def thresholds_of(lake, table: str) -> dict[str, float]:
    """The fixed values, under those of the lake, under those of the table."""
    out = dict(THRESHOLDS)
    for name in ("__all__", table):
        at = f"{lake.path}/_quality/{name}.json"
        if lake.store.exists(at):
            out |= lake.store.read_json(at)
    return out


_PROFILE = "column_name string, category string, total long, null_count long, null_rate double, distinct_count long, uniqueness double, min_value string, max_value string, avg_value double, stddev_value double, zero_rate double, negative_rate double"
#: Columns of the history (fixed values).
HISTORY = "dq_id string, checked_at timestamp, table_name string, check_type string, quality_score int, status string, row_count long, total_checks int, passed int, warnings int, critical_count int, anomaly_count int, anomalies_json string, column_stats_json string, rule_results_json string, execution_ms long"


def run_check(lake, table: str, rules: list[Rule] | None = None, kind: str = "quick", thresholds: dict[str, float] | None = None) -> DataFrame:
    """Checks a table against its rules and its last check, appends the outcome to `__data_quality__` and returns the row.

    Anomalies and drift of the schema lower the score as findings of rules do, and are kept with it.
    """
    thresholds = {**thresholds_of(lake, table), **(thresholds or {})}
    of = lake.table(table)
    df, snapshot = of.read(), of.folder.snapshot()
    start = datetime.datetime.now(datetime.timezone.utc)
    db = table.rpartition(".")[0]
    history = lake.table(f"{db}.__data_quality__" if db else "__data_quality__")
    last = history.read().where(F.col("table_name") == table).orderBy(F.desc("checked_at")).first() if history.folder.exists() else None
    stats = json.loads(last["column_stats_json"]) if last else None
    profile = quick_profile(df).persist()
    found = check_rules(df, rules).persist() if rules else None
    try:
        whole = {"hours": max(0.0, start.timestamp() * 1000 - snapshot.updated_ms) / 3.6e6, "bytes": sum(r.file_size for r in snapshot.resources), "schema": [(f.name, f.dataType.simpleString()) for f in df.schema.fields]}
        odd = table_anomalies(whole, stats and stats.get("table"), thresholds)
        if stats:
            before = df.sparkSession.createDataFrame([tuple(c.get(n.split(" ")[0]) for n in _PROFILE.split(", ")) for c in stats["columns"]], _PROFILE)
            odd += [r.asDict() for r in anomalies(profile, before, thresholds).orderBy("column_name", "anomaly").collect()]
            old = df.sparkSession.createDataFrame([tuple(x) for x in stats["table"]["schema"]], "column_name string, data_type string")
            if drift := [r.asDict() for r in schema_drift(schema_rows(df), old).orderBy("column_name").collect()]:
                odd.append({"column_name": None, "anomaly": "schema_drift", "change": float(len(drift)), "severity": "warning", "columns": drift})
        findings = df.sparkSession.createDataFrame([(x["severity"],) for x in odd], "status string")
        s = score(profile, findings.unionByName(found.select("status")) if found is not None else findings).first()
        columns = [r.asDict() for r in profile.collect()]
        results = [r.asDict() for r in found.collect()] if found is not None else []
    finally:
        profile.unpersist()
        if found is not None:
            found.unpersist()
    status = "critical" if s["critical"] else "warning" if s["warnings"] else "ok"
    total = columns[0]["total"] if columns else 0
    took = int((datetime.datetime.now(datetime.timezone.utc) - start).total_seconds() * 1000)
    kept = json.dumps({"table": whole, "columns": columns}, default=str)
    row = (uuid.uuid4().hex, start, table, kind, s["quality_score"], status, total, len(results), sum(r["status"] == "ok" for r in results), s["warnings"], s["critical"], len(odd), json.dumps(odd, default=str), kept, json.dumps(results), took)
    out = lake.spark.createDataFrame([row], HISTORY)
    history.append(out)
    return out
