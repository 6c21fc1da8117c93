"""Queries of the table format itself: writes, schema changes, maintenance, roles, quality, audit, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import Table
from ..operators import audit, quality
from ..operators.rbac import Role
from ..streaming.ingest import Pipe, Staging, collected, sessions, tumbling
from .shared import folder, lake_of, new_lake

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        RUNS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _table(spark: SparkSession, *frames: DataFrame) -> Table:
    t = new_lake(spark).table("t")
    for f in frames:
        t.append(f)
    return t


BASE = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"
DELTA = "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0"


def _delta(base: DataFrame) -> DataFrame:
    return base.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.lit("X"))


@register("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def w_append(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir))
    return t.lake.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t GROUP BY o_orderstatus")


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 5 <> 0 UNION ALL {DELTA}")
def w_upsert_single_key(spark, sf_dir):
    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.upsert(_delta(base), ["o_orderkey"])
    return t.read()


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1")
def w_upsert_composite_key(spark, sf_dir):
    base = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = _table(spark, base)
    t.upsert(base.where("l_orderkey % 7 = 0 AND l_linenumber = 1").withColumn("l_quantity", -F.col("l_quantity")), ["l_orderkey", "l_linenumber"])
    return t.read()


@register("SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS k, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT NULL, 'all nulls'")
def w_upsert_null_key(spark, sf_dir):
    base = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), "c_name")
    t = _table(spark, base)
    t.upsert(spark.createDataFrame([(None, "all nulls")], "k long, c_name string"), ["k"])
    return t.read()


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'first' UNION ALL SELECT 3, 'second'")
def w_upsert_duplicates_in_batch(spark, sf_dir):
    t = _table(spark, _read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    t.upsert(spark.createDataFrame([(3, "first"), (3, "second")], "n_nationkey int, n_name string"), ["n_nationkey"])
    return t.read()


@register("SELECT * FROM (" + BASE + ") b WHERE b.o_custkey % 3 <> 0")
def w_delete_by_key(spark, sf_dir):
    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.delete(base.where("o_custkey % 3 = 0").select("o_custkey"), ["o_custkey"])
    return t.read()


@register("SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS left_over, CAST(0 AS BIGINT) AS deleted_again FROM orders")
def w_delete_all_count(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir))
    first = t.delete_all()[3]
    left = t.read().count()
    return spark.createDataFrame([(first, left, t.delete_all()[3])], "deleted long, left_over long, deleted_again long")


@register("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 20 ELSE 10 END AS v, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS tag FROM nation UNION ALL SELECT 1000, 1, 'new'")
def w_newer_than(spark, sf_dir):
    base = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(10).alias("v"), F.lit("old").alias("tag"))
    t = _table(spark, base)
    value = F.when(F.col("k") % 3 == 0, 20).when(F.col("k") % 3 == 1, 10).otherwise(5)  # newer, a tie, older
    batch = base.withColumn("v", value).withColumn("tag", F.lit("new")).unionByName(spark.createDataFrame([(1000, 1, "new")], "k int, v int, tag string"))
    t.upsert(batch, ["k"], newer_than="v")
    return t.read()


@register("SELECT r_regionkey, r_name, NULL::DOUBLE AS extra FROM region UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey * 1.5 FROM region")
def w_schema_add_column(spark, sf_dir):
    base = _read(spark, sf_dir, "region")
    return _table(spark, base, base.select((F.col("r_regionkey") + 100).alias("r_regionkey"), "r_name", (F.col("r_regionkey") * 1.5).cast("double").alias("extra"))).read()


@register("SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region")
def w_schema_drop_column(spark, sf_dir):
    base = _read(spark, sf_dir, "region")
    return _table(spark, base, base.select("r_regionkey")).read()


@register("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, NULL FROM region")
def w_schema_union_mode(spark, sf_dir):
    base = _read(spark, sf_dir, "region")
    return _table(spark, base, base.select("r_regionkey")).read(schema_mode="union")


@register("SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 3000000000 FROM nation")
def w_schema_widen(spark, sf_dir):
    base = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    return _table(spark, base, base.select((F.col("k").cast("long") + 3000000000).alias("k"))).read()


@register("SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation UNION ALL SELECT n_name FROM nation")
def w_schema_incompatible_to_string(spark, sf_dir):
    base = _read(spark, sf_dir, "nation")
    return _table(spark, base.select(F.col("n_nationkey").alias("k")), base.select(F.col("n_name").alias("k"))).read()


@register("SELECT r_name, r_regionkey FROM region UNION ALL SELECT r_name, r_regionkey FROM region")
def w_schema_reordered(spark, sf_dir):
    base = _read(spark, sf_dir, "region")
    return _table(spark, base.select("r_regionkey", "r_name"), base.select("r_name", "r_regionkey")).read()


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 5 <> 0 UNION ALL {DELTA}")
def w_compact_preserves(spark, sf_dir):
    base = _orders(spark, sf_dir)
    t = _table(spark, base.where("o_orderkey % 2 = 0"), base.where("o_orderkey % 2 = 1"))
    t.upsert(_delta(base), ["o_orderkey"])
    done = t.compact()
    assert done["files_after"] <= done["files_before"] and not t.snapshot().deletions
    return t.read()


@register("SELECT * FROM (" + BASE + ") b WHERE b.o_orderkey % 4 <> 0")
def w_export_live(spark, sf_dir):
    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.delete(base.where("o_orderkey % 4 = 0"), ["o_orderkey"])
    target = folder(spark) + "/export"
    t.export(target, files=2)
    return spark.read.parquet(target)


@register(BASE)
def w_time_travel(spark, sf_dir):
    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.delete_all()
    t.compact()
    return t.read(version=0)


@register("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 0), (2, 10), (3, 10)) v(version, deleted_rows)")
def w_history(spark, sf_dir):
    base = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = _table(spark, base.where("n_nationkey < 20"), base.where("n_nationkey >= 20"))
    t.upsert(base.where("n_nationkey < 10"), ["n_nationkey"])
    t.append(base)
    return t.history().select("version", "deleted_rows")


@register("SELECT n_nationkey, n_name FROM nation")
def w_clone_reads_source(spark, sf_dir):
    t = _table(spark, _read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    t.database.clone("copy", ["t"])
    return t.lake.sql("SELECT * FROM copy.t")


@register("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def sc_whole_database(spark, sf_dir):
    lake = new_lake(spark)
    lake.table("customers").append(_read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    lake.table("suppliers").append(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    return lake.whole_database()


@register("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def j_cross_database(spark, sf_dir):
    lake = new_lake(spark)
    lake.table("left_side.nation").append(_read(spark, sf_dir, "nation"))
    lake.table("right_side.region").append(_read(spark, sf_dir, "region"))
    return lake.sql("SELECT n.n_name, right_side.region.r_name FROM left_side.nation n JOIN right_side.region ON n.n_regionkey = right_side.region.r_regionkey")


@register("SELECT lower(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY lower(o_orderpriority)")
def rd_nocase(spark, sf_dir):
    base = _orders(spark, sf_dir).select("o_orderkey").join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    mixed = base.select(F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("p"))
    t = _table(spark, mixed)
    return t.lake.sql("SELECT lower(min(p)) AS p, count(*) AS n FROM t GROUP BY p", collation="nocase").select(F.collate("p", "UTF8_BINARY").alias("p"), "n")


# --- roles -----------------------------------------------------------------------------------------------------------


def _as(spark: SparkSession, sf_dir: str, rule: dict, sql: str) -> DataFrame:
    lake = lake_of(spark, sf_dir, "customer")
    role = lake.roles.save(Role("analyst", "reader", {"customer": rule}))
    return lake.sql(sql, role=role.role_id)


@register("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def rb_row_filter(spark, sf_dir):
    return _as(spark, sf_dir, {"filters": [{"column": "c_nationkey", "operation": "=", "value": 3}]}, "SELECT c_custkey, c_name FROM customer")


@register("SELECT c_custkey, c_mktsegment FROM customer")
def rb_column_filter(spark, sf_dir):
    return _as(spark, sf_dir, {"columns": ["c_custkey", "c_mktsegment"]}, "SELECT * FROM customer")


@register("SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_acctbal < 0) AND NOT c_name LIKE '%7' AND c_acctbal >= -500 AND c_acctbal < 9000")
def rb_nested_filter(spark, sf_dir):
    rule = {
        "columns": ["c_custkey"],
        "filters": [
            {"OR": [{"column": "c_mktsegment", "operation": "IN", "value": ["BUILDING", "FURNITURE"]}, {"column": "c_acctbal", "operation": "<", "value": 0}]},
            {"NOT": {"column": "c_name", "operation": "LIKE", "value": "%7"}},
            {"column": "c_acctbal", "range": [{"operation": ">=", "value": -500}, {"operation": "<", "value": 9000}]},
        ],
    }
    return _as(spark, sf_dir, rule, "SELECT * FROM customer")


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def rb_share_filter(spark, sf_dir):
    t = _table(spark, _read(spark, sf_dir, "supplier"))
    t.set_row_filter({"column": "s_nationkey", "operation": "<", "value": 10})
    return t.lake.sql("SELECT s_suppkey, s_name FROM t")


# --- quality ---------------------------------------------------------------------------------------------------------


@register(
    """SELECT 'c_acctbal' AS column_name, count(*) AS total, count(*) - count(c_acctbal) AS null_count, count(DISTINCT c_acctbal) AS distinct_count, round(avg(c_acctbal), 4) AS avg_value, round(stddev(c_acctbal), 4) AS stddev_value,
       round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(c_acctbal), 2)::DOUBLE AS negative_rate FROM customer
       UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL, 0.0 FROM customer"""
)
def dq_quick_profile(spark, sf_dir):
    profile = quality.quick_profile(_read(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment"))
    return profile.select("column_name", "total", "null_count", "distinct_count", "avg_value", "stddev_value", "negative_rate")


@register(
    """WITH f AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY p_size), w AS (SELECT sum(n) AS total, count(*) AS u FROM f), r AS (SELECT n, rank() OVER (ORDER BY n DESC) AS k FROM f)
       SELECT count(*) AS total, round(avg(p_size), 4) AS avg_value, round(variance(p_size), 4) AS var_value, min(p_size)::DOUBLE AS min_value, max(p_size)::DOUBLE AS max_value, round(quantile_cont(p_size, 0.25), 4)::DOUBLE AS p25,
       round(quantile_cont(p_size, 0.5), 4)::DOUBLE AS median_value, (SELECT u FROM w) AS unique_count, (SELECT round(-sum(n / total * log2(n / total)), 6) FROM f, w) AS entropy,
       (SELECT round(100.0 * sum(n) / (SELECT total FROM w), 4)::DOUBLE FROM r WHERE k <= 10) AS top_coverage FROM part"""
)
def dq_deep_numeric(spark, sf_dir):
    return quality.deep_numeric(_read(spark, sf_dir, "part"), "p_size").select("total", "avg_value", "var_value", "min_value", "max_value", "p25", "median_value", "unique_count", "entropy", "top_coverage")


@register(
    """WITH d AS (SELECT CASE p_partkey % 13 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN 'not available' ELSE p_brand END AS v FROM part),
       f AS (SELECT v, count(*) AS n FROM d WHERE v IS NOT NULL GROUP BY v), w AS (SELECT sum(n) AS total, count(*) AS u FROM f), r AS (SELECT n, rank() OVER (ORDER BY n DESC) AS k FROM f)
       SELECT count(*) AS total, round(avg(length(v)), 4) AS avg_length, round(variance(length(v)), 4) AS var_length, min(length(v))::BIGINT AS min_length, max(length(v))::BIGINT AS max_length,
       quantile_cont(length(v), 0.5)::DOUBLE AS median_length, round(100.0 * count(*) FILTER (WHERE lower(v) IN ('', 'n/a', 'unknown', 'undef', 'none', 'null', '-', 'tbd', 'na', 'not available')) / count(*), 4)::DOUBLE AS placeholder_rate,
       (SELECT u FROM w) AS unique_count, (SELECT round(-sum(n / total * log2(n / total)), 6) FROM f, w) AS entropy, (SELECT round(100.0 * sum(n) / (SELECT total FROM w), 4)::DOUBLE FROM r WHERE k <= 10) AS top_coverage FROM d"""
)
def dq_deep_string(spark, sf_dir):
    v = F.expr("CASE p_partkey % 13 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN 'not available' ELSE p_brand END")
    return quality.deep_string(_read(spark, sf_dir, "part").select(v.alias("v")), "v")


@register("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def dq_top_values(spark, sf_dir):
    return quality.top_values(_read(spark, sf_dir, "part"), "p_brand")


@register("SELECT bucket::INTEGER AS bucket, min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT value AS v, ntile(10) OVER (ORDER BY value) AS bucket FROM events) GROUP BY bucket")
def dq_histogram(spark, sf_dir):
    return quality.histogram(_read(spark, sf_dir, "events"), F.col("value"))


@register(
    """SELECT 'cheapest' AS rule_name, min(p_retailprice) AS measured, CASE WHEN min(p_retailprice) >= 0 THEN 'ok' ELSE 'critical' END AS status FROM part
       UNION ALL SELECT 'enough', count(*)::DOUBLE, CASE WHEN count(*) >= 1000000 THEN 'ok' ELSE 'warning' END FROM part
       UNION ALL SELECT 'sizes', count(*) FILTER (WHERE p_size NOT IN (1, 2, 3))::DOUBLE, CASE WHEN count(*) FILTER (WHERE p_size NOT IN (1, 2, 3)) = 0 THEN 'ok' ELSE 'warning' END FROM part
       UNION ALL SELECT 'nulls', 0.0, 'ok'"""
)
def dq_custom_rules(spark, sf_dir):
    rules = [quality.Rule("cheapest", "column_min", "p_retailprice", 0, "critical"), quality.Rule("enough", "row_count_min", None, 1000000), quality.Rule("sizes", "distinct_in", "p_size", [1, 2, 3]), quality.Rule("nulls", "null_rate_max", "p_name", 1)]
    return quality.check_rules(_read(spark, sf_dir, "part"), rules).select("rule_name", "measured", "status")


@register(
    """WITH n AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS b, c_custkey * 3 AS k FROM customer WHERE c_custkey % 2 = 0),
       d AS (SELECT 100.0 * abs((SELECT count(*) FROM n) - count(*)) / count(*) AS rows_pct, round(100.0 * (SELECT count(*) - count(b) FROM n) / (SELECT count(*) FROM n), 2) AS nulls,
         100.0 * abs((SELECT count(DISTINCT b) FROM n) - count(DISTINCT c_acctbal)) / count(DISTINCT c_acctbal) AS d_b, 100.0 * abs((SELECT count(DISTINCT k) FROM n) - count(DISTINCT c_custkey)) / count(DISTINCT c_custkey) AS d_k,
         abs((SELECT round(avg(k), 4) FROM n) - round(avg(c_custkey), 4)) / round(stddev(c_custkey), 4) AS z FROM customer)
       SELECT NULL AS column_name, 'row_count' AS anomaly, round(rows_pct, 4)::DOUBLE AS change, CASE WHEN rows_pct > 60 THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE rows_pct > 30
       UNION ALL SELECT 'c_acctbal', 'null_rate', round(nulls, 4)::DOUBLE, CASE WHEN nulls > 10 THEN 'critical' ELSE 'warning' END FROM d WHERE nulls > 5
       UNION ALL SELECT 'c_acctbal', 'distinct_count', round(d_b, 4)::DOUBLE, CASE WHEN d_b > 100 THEN 'critical' ELSE 'warning' END FROM d WHERE d_b > 50
       UNION ALL SELECT 'c_custkey', 'distinct_count', round(d_k, 4)::DOUBLE, 'warning' FROM d WHERE d_k > 50
       UNION ALL SELECT 'c_custkey', 'mean_shift', round(z, 4)::DOUBLE, CASE WHEN z > 4 THEN 'critical' ELSE 'warning' END FROM d WHERE z > 2
       UNION ALL SELECT 'c_custkey', 'bounds', 1.0::DOUBLE, 'warning'"""
)
def dq_anomalies(spark, sf_dir):
    base = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    now = base.where("c_custkey % 2 = 0").select((F.col("c_custkey") * 3).alias("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return quality.anomalies(quality.quick_profile(now), quality.quick_profile(base))


@register("SELECT * FROM (VALUES ('r_name', 'removed'), ('r_comment', 'added'), ('r_regionkey', 'type_changed')) v(column_name, change)")
def dq_schema_drift(spark, sf_dir):
    base = _read(spark, sf_dir, "region")
    now = base.select(F.col("r_regionkey").cast("string").alias("r_regionkey"), F.lit("x").alias("r_comment"))
    return quality.schema_drift(quality.schema_rows(now), quality.schema_rows(base)).select("column_name", "change")


@register("SELECT 85 AS quality_score, 1::BIGINT AS critical, 1::BIGINT AS warnings")
def dq_score(spark, sf_dir):
    df = _read(spark, sf_dir, "part")
    rules = quality.check_rules(df, [quality.Rule("a", "column_min", "p_size", 10**9, "critical"), quality.Rule("b", "column_max", "p_size", 0)])
    return quality.score(quality.quick_profile(df), rules).select("quality_score", "critical", "warnings")


# --- metadata, audit, streams ----------------------------------------------------------------------------------------


@register("SELECT 'nation' AS table_name, count(*) AS live_rows FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 'region', count(*) FROM region")
def m_tables(spark, sf_dir):
    lake = new_lake(spark)
    nation = _read(spark, sf_dir, "nation")
    lake.table("nation").append(nation)
    lake.table("region").append(_read(spark, sf_dir, "region"))
    lake.table("nation").delete(nation.where("n_nationkey < 5"), ["n_nationkey"])
    return lake.tables_frame().select("table_name", "live_rows")


@register("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(0 AS BIGINT) AS nulls FROM orders")
def m_show_stats(spark, sf_dir):
    stats = lake_of(spark, sf_dir, "orders").sql("SHOW STATS orders")
    return stats.where("column_name = 'o_orderkey'").agg(F.min("min_bigint").alias("low"), F.max("max_bigint").alias("high"), F.sum("null_count").alias("nulls"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("actor_id"))


@register("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS category FROM events WHERE event_type = 'click' ORDER BY epoch_ms(ts) DESC, CAST(event_id AS VARCHAR) LIMIT 50")
def au_query(spark, sf_dir):
    return audit.query_events(_audit(spark, sf_dir), category="click", limit=50).select("event_id", "category")


@register(
    """WITH e AS (SELECT event_type AS category, event_id // 500 AS batch, CAST(event_id AS VARCHAR) AS i, CAST(user_id AS VARCHAR) AS u FROM events),
       b AS (SELECT category, batch, string_agg(i, chr(10) ORDER BY i) AS ids, sha256(string_agg(u, chr(10) ORDER BY u)) AS body FROM e GROUP BY category, batch)
       SELECT category, batch, sha256(ids || chr(10) || body) AS batch_hash FROM b"""
)
def au_batch_hash(spark, sf_dir):
    """All events, in batches of bounded size."""
    events = _audit(spark, sf_dir).withColumn("batch", F.expr("cast(event_id as long) div 500"))
    return audit.batch_hashes(events, ["category", "batch"], F.col("actor_id"))


@register(
    """WITH h AS (SELECT n_regionkey AS day, CAST(n_nationkey AS VARCHAR) AS instance_id, sha256(n_name) AS head FROM nation)
       SELECT day, sha256(string_agg(head, chr(10) ORDER BY instance_id)) AS root FROM h GROUP BY day"""
)
def au_daily_root(spark, sf_dir):
    heads = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("day"), F.col("n_nationkey").cast("string").alias("instance_id"), F.sha2("n_name", 256).alias("head"))
    return audit.daily_root(heads)


@register("SELECT true AS whole, 3::BIGINT AS events")
def au_chain(spark, sf_dir):
    log = audit.AuditLog(spark, folder(spark))
    log.append([{"category": "data_mutation", "action": "write", "detail": "a"}, {"category": "system", "action": "start"}])
    log.append([{"category": "authorization", "action": "deny"}])
    return spark.createDataFrame([(log.verify()[0], log.events().count())], "whole boolean, events long")


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 5 <> 0 UNION ALL {DELTA}")
def st_pipe_upsert(spark, sf_dir):
    base, lake = _orders(spark, sf_dir), new_lake(spark)
    staging = Staging(lake, "landing")
    pipe = Pipe(lake, "feed", "landing", "t", ["o_orderkey"]).save()
    for part in (base, _delta(base)):
        staging.save(part, "orders")
        pipe.start(base.schema).awaitTermination()
    pipe.start(base.schema).awaitTermination()  # nothing new: nothing changes
    return lake.table("t").read()


@register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling_window(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = tumbling(events, "ts", "1 hour", ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def st_session_window(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(events, "ts", "30 minutes", "user_id").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@register(
    """WITH m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM events), w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
       SELECT window_start, event_type, n, total FROM w, m WHERE window_start + INTERVAL '1 hour' <= mark"""
)
def st_stream_watermark(spark, sf_dir):
    """A stream over files with late rows let in for ten minutes; windows that are still open at the end aren't given out."""
    source = folder(spark)
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{source}/in")  # in any order and many files: the watermark moves only after a batch, and all files that are there are one
    stream = spark.readStream.schema(events.schema).parquet(f"{source}/in")
    out = collected(tumbling(stream, "ts", "1 hour", ["event_type"], "value", late="10 minutes"), spark, source)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 4 > 1")
def mi_delta_log(spark, sf_dir):
    """Rows of a mirrored table, read from the files that its transaction log names."""
    import json

    from ..sources import mirror

    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.delete(base.where("o_orderkey % 4 = 0"), ["o_orderkey"])
    mirror.configure(t.folder, ["delta"])
    base_at = folder(spark)
    mirror.mirror(t.folder, base_at)
    t.delete(base.where("o_orderkey % 4 = 1"), ["o_orderkey"])
    path = mirror.mirror(t.folder, base_at)["delta"]
    actions = [json.loads(x) for p, _, _ in t.folder.store.list(f"{path}/_delta_log") if p.endswith(".json") for x in t.folder.store.read_text(p).splitlines()]
    gone = {a["remove"]["path"] for a in actions if "remove" in a}
    return spark.read.parquet(*(f"{path}/{a['add']['path']}" for a in actions if "add" in a and a["add"]["path"] not in gone))


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 4 <> 0")
def mi_iceberg(spark, sf_dir):
    """Rows of a mirrored table, read from the files that its manifests name."""
    from ..sources import mirror
    from ..sources.avro import read_container

    base = _orders(spark, sf_dir)
    t = _table(spark, base)
    t.delete(base.where("o_orderkey % 4 = 0"), ["o_orderkey"])
    mirror.configure(t.folder, ["iceberg"])
    store, path = t.folder.store, mirror.mirror(t.folder, folder(spark))["iceberg"]
    meta = store.read_json(f"{path}/metadata/v{store.read_text(f'{path}/metadata/version-hint.text')}.metadata.json")
    _, manifests = read_container(store.read_bytes(meta["snapshots"][-1]["manifest-list"]))
    return spark.read.parquet(*(e["data_file"]["file_path"] for m in manifests for e in read_container(store.read_bytes(m["manifest_path"]))[1]))


@register(f"SELECT * FROM ({BASE}) b WHERE b.o_orderkey % 4 <> 0")
def mi_parquet(spark, sf_dir):
    """Mirrored by the commits themselves."""
    from ..sources import mirror

    base, base_at = _orders(spark, sf_dir), folder(spark)
    t = new_lake(spark).table("t")
    mirror.configure(t.folder, ["parquet"], base_at)
    t.append(base)
    t.delete(base.where("o_orderkey % 4 = 0"), ["o_orderkey"])
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base_at}/parquet/t")


# --- further forms of statements ---------------------------------------------------------------------------------


def _sql(query: str, oracle: str, *tables: str, name: str, **how) -> None:
    RUNS[name] = lambda spark, sf_dir: lake_of(spark, sf_dir, *tables).sql(query, **how)
    SQL[name] = oracle


_sql("SELECT o_orderkey, IIF(o_totalprice > 100000, 'big', 'small') AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders", "orders", name="f_iif")
_sql(
    "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS m, o_orderdate - INTERVAL '36 hours' AS h, CURRENT_DATE = CURRENT_DATE AS same FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS m, o_orderdate - INTERVAL '36 hours' AS h, CURRENT_DATE = CURRENT_DATE AS same FROM orders",
    "orders",
    name="f_interval",
)
_sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25", "orders", name="s_auto_limit", limit=25)
_sql("SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders", "SELECT true AS near", "orders", name="a_approximate")


@register("SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS names, max(n_nationkey) AS last FROM nation GROUP BY n_regionkey")
def a_list_of_structs(spark, sf_dir):
    found = lake_of(spark, sf_dir, "nation").sql("SELECT n_regionkey, list(named_struct('k', n_nationkey, 'name', n_name) ORDER BY n_nationkey) AS all_ FROM nation GROUP BY n_regionkey")
    return found.select("n_regionkey", F.array_join(F.transform("all_", lambda x: F.concat_ws(":", x["k"].cast("string"), x["name"])), ",").alias("names"), F.element_at("all_", -1)["k"].alias("last"))


@register("SELECT o_orderkey % 3 AS k, unnest([o_orderkey, o_custkey]) AS v FROM orders")
def f_unnest(spark, sf_dir):
    return lake_of(spark, sf_dir, "orders").sql("SELECT o_orderkey % 3 AS k, explode(array(o_orderkey, o_custkey)) AS v FROM orders")


@register("SELECT count(*) AS rows FROM orders WHERE o_totalprice > 1000")
def m_explain_analyze(spark, sf_dir):
    return lake_of(spark, sf_dir, "orders").sql("EXPLAIN ANALYZE SELECT * FROM orders WHERE o_totalprice > 1000").select("rows")


@register("SELECT n_nationkey, n_name, n_regionkey, kind FROM nation, (VALUES ('csv'), ('jsonl'), ('parquet'), ('orc')) k(kind)")
def sc_loaders(spark, sf_dir):
    from functools import reduce

    from ..sources.files import load

    base, at = _read(spark, sf_dir, "nation"), folder(spark)
    base.write.option("header", True).csv(f"{at}/n.csv")
    base.write.json(f"{at}/n.jsonl")
    base.write.parquet(f"{at}/n.parquet")
    base.write.orc(f"{at}/n.orc")
    return reduce(DataFrame.unionByName, (load(spark, f"{at}/n.{kind}", base.schema).withColumn("kind", F.lit(kind)) for kind in ("csv", "jsonl", "parquet", "orc")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
