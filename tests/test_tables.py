"""The table format: write semantics against a model, failures, pruning, schema union, roles, SQL shim."""

import datetime
import json
import random
import threading

import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.lake import Lake, _within
from snaplake.operators import audit, compact, quality
from snaplake.operators.rbac import Role, compile_filter
from snaplake.plans import dialect, pruning
from snaplake.plans.pruning import Interval, comparison, prune, span
from snaplake.sources import catalog, mirror
from snaplake.sources.catalog import Conflict, NotFound, Resource
from snaplake.sources.files import load, store_path
from snaplake.sources.scan import live
from snaplake.sources.storage import address
from snaplake.types import union_all, union_schema, widen


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/lake")


def frame(spark, rows, schema="id long, v string"):
    return spark.createDataFrame(rows, schema)


def seen(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_writes_follow_a_model(spark, lake):
    rng, t, model = random.Random(5), lake.table("t"), []
    for step in range(6):
        kind = rng.choice(["append", "upsert", "delete", "newer"]) if step else "append"
        batch = [(rng.choice([None, *range(6)]), rng.randint(0, 9)) for _ in range(4)]
        df = frame(spark, batch, "k int, v int")
        keys = {b[0] for b in batch}
        if kind == "append":
            out = t.append(df)
            model += batch
        elif kind == "upsert":
            out = t.upsert(df, ["k"])
            model = [m for m in model if m[0] not in keys] + batch
        elif kind == "delete":
            out = t.delete(df, ["k"])
            model = [m for m in model if m[0] not in keys]
            assert out[2] == 0
        else:
            history = physical[:]  # noqa: F821  the greatest value counts deleted rows too
            new = [b for b in batch if all(h[1] is None or b[1] > h[1] for h in history if h[0] == b[0])]
            out = t.upsert(df, ["k"], newer_than="v")
            gone = {b[0] for b in new}
            model = [m for m in model if m[0] not in gone] + new
            batch = new
        physical = batch if not step else physical + (batch if kind != "delete" else [])  # noqa: F821
        assert seen(t) == sorted(model, key=str), (step, kind)
        assert t.snapshot().live_rows == len(model)
        if kind == "newer":
            break  # reclaimed files leave the physical rows, so the model ends here
    t.compact()
    assert seen(t) == sorted(model, key=str)


def test_row_ids_are_contiguous_and_hidden(spark, lake):
    t = lake.table("t")
    t.append(spark.range(0, 100, numPartitions=7).withColumn("__rowid__", F.lit(1)))
    t.append(spark.range(50))
    from snaplake.sources.scan import live

    ids = sorted(r["__rowid__"] for r in live(spark, t.snapshot(), system=True).collect())
    assert ids == list(range(1, 151))
    assert t.read().columns == ["id"]
    with pytest.raises(ValueError, match="Missing required column"):
        lake.sql("SELECT __timestamp__ FROM t")


def test_deletes_count_once(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(1, "a"), (2, "b"), (3, "c")]))
    assert t.delete(frame(spark, [(2, "")]), ["id"])[3] == 1
    assert t.delete(frame(spark, [(2, "")]), ["id"])[3] == 0
    assert t.delete(frame(spark, [(9, "")]), ["id"])[3] == 0
    assert t.delete_all()[3] == 2
    assert t.snapshot().resources == [] and seen(t) == []
    t.append(frame(spark, [(2, "again")]))
    assert seen(t) == [(2, "again")]


def test_lost_deletion_vector_stops_readers_and_writers(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(1, "a"), (2, "b")]).coalesce(1))
    t.delete(frame(spark, [(1, "")]), ["id"])
    t.folder.store.delete(t.snapshot().deletions[0])
    with pytest.raises(Exception, match="(?i)path|file"):
        t.read().collect()
    with pytest.raises(Exception, match="(?i)path|file"):
        t.delete(frame(spark, [(2, "")]), ["id"])
    with pytest.raises(Exception, match="(?i)path|file"):
        t.compact()
    assert t.snapshot().version == 1


def test_one_of_two_writers_wins(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(1, "a")]))
    lost = t.snapshot()
    lost.version += 1
    t.append(frame(spark, [(2, "b")]))
    with pytest.raises(Conflict):
        t.folder.commit(lost)
    assert seen(t) == [(1, "a"), (2, "b")]


def test_bad_writes_are_refused(spark, lake):
    df = frame(spark, [(1, "a")])
    with pytest.raises(ValueError):
        lake.table("t").upsert(df, ["nope"])
    with pytest.raises(ValueError):
        lake.table("t").upsert(df, ["id"], newer_than="nope")
    with pytest.raises(ValueError):
        lake.table("1bad")
    with pytest.raises(ValueError):
        lake.table("t").configure(chunk_bytes=0)
    with pytest.raises(NotFound):
        lake.table("t").read()


def test_stale_only_batch_commits_nothing(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(1, 5)], "id long, v int"))
    assert t.upsert(frame(spark, [(1, 5)], "id long, v int"), ["id"], newer_than="v") == (2, 0, 0, 0)
    assert t.snapshot().version == 0


def test_small_files_are_merged_on_write(spark, lake):
    t = lake.table("t")
    t.configure(max_small_files=3)
    for i in range(3):
        t.append(frame(spark, [(i, "x")]).coalesce(1))
    assert len(t.snapshot().resources) == 1 and len(seen(t)) == 3


def test_merged_files_are_limited_by_rows_too(spark, lake):
    """All of these rows have the bytes of one small file."""
    t = lake.table("t")
    t.append(spark.range(0, 2_400_000, numPartitions=6).select((F.col("id") % 2).alias("k")))
    assert t.compact()["files_before"] == 6
    rows = [r.rows for r in t.snapshot().resources]
    assert sum(rows) == 2_400_000 and len(rows) == 3 and max(rows) < 1_000_000
    assert sum(r.file_size for r in t.snapshot().resources) < compact.CHUNK_BYTES
    assert {tuple(r) for r in t.read().groupBy("k").count().collect()} == {(0, 1_200_000), (1, 1_200_000)}
    version = t.snapshot().version
    assert t.compact()["version"] == version  # full by rows: not small again


def test_an_upsert_that_drains_limits_files_by_rows(spark, lake):
    t = lake.table("t")
    t.configure(max_deletion_rows=1)
    base = spark.range(0, 2_400_000, numPartitions=1).select((F.col("id") / 4).cast("long").alias("k"), (F.col("id") % 4).alias("n"), F.lit(1.0).alias("q"))
    t.append(base)
    assert t.upsert(base.where("k % 1000 = 0 AND n = 1").withColumn("q", -F.col("q")), ["k", "n"])[2:] == (600, 600)
    rows = [r.rows for r in t.snapshot().resources]
    assert not t.snapshot().deletions and sum(rows) == 2_400_000 and max(rows) < 1_000_000
    assert {tuple(r) for r in t.read().groupBy("q").count().collect()} == {(1.0, 2_399_400), (-1.0, 600)}


def test_widening():
    i, b, s, d = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType()
    assert widen(i, b) == b and widen(i, d) == d and widen(d, s) == s
    assert widen(T.DateType(), T.TimestampType()) == T.TimestampNTZType()
    kinds = [i, b, s, d, T.DateType(), T.TimestampNTZType(), T.BooleanType()]
    for x in kinds:
        for y in kinds:
            assert widen(x, y) == widen(y, x)
            for z in kinds:
                assert widen(widen(x, y), z) == widen(x, widen(y, z))
    assert union_schema([T.StructType().add("a", i), T.StructType().add("B", s).add("A", d)]).names == ["a", "B"]


def test_union_of_frames(spark):
    out = union_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x", 2.0)], "a string, b double")])
    assert sorted(map(tuple, out.collect()), key=str) == [("1", None), ("x", 2.0)]


def test_intervals():
    a, b = comparison(">=", 3), comparison("<", 7)
    assert a.meet(b) == Interval("bigint", 3, 7, False, True) == b.meet(a)
    assert a.meet(comparison("<", 3)).empty
    assert a.meet(comparison("=", "x")) is None
    assert span([3, 1, 2]) == Interval("bigint", 1, 3) and span([1, "a"]) is None and span([None]) is None
    big = (1 << 53) + 1
    assert comparison(">", big - 1).apart(big - 1, big - 1) and not comparison(">", big - 1).apart(big, big)


@pytest.mark.parametrize("seed", range(40))
def test_pruning_never_drops_a_match(seed):
    rng = random.Random(seed)
    files, stats, data = [], [], {}
    for f in range(6):
        values = [rng.choice([None, *range(20)]) for _ in range(rng.randint(1, 5))]
        name = f"f{f}"
        data[name] = values
        files.append(Resource(name, 1, len(values), 1, "{}"))
        full = [v for v in values if v is not None]
        row = dict.fromkeys(("min_double", "max_double", "min_timestamp", "max_timestamp", "min_string", "max_string", "min_bigint", "max_bigint"))
        row |= {"file_path": name, "row_group_id": 0, "column_name": "X", "null_count": len(values) - len(full), "row_group_rows": len(values), "stats_available": bool(full)}
        if full:
            row |= {"min_bigint": min(full), "max_bigint": max(full)}
        if rng.random() > 0.1:
            stats.append(row)
    op, v = rng.choice(["=", "<", "<=", ">", ">="]), rng.randint(-2, 22)
    test = {"=": lambda x: x == v, "<": lambda x: x < v, "<=": lambda x: x <= v, ">": lambda x: x > v, ">=": lambda x: x >= v}[op]
    kept = {r.file for r in prune(files, stats, [{"x": comparison(op, rng.choice([v, float(v)]))}])}
    assert {n for n, values in data.items() if any(x is not None and test(x) for x in values)} <= kept


def test_pruned_scan_reads_fewer_files(spark, lake):
    t = lake.table("t")
    for a in range(4):
        t.append(spark.range(a * 100, a * 100 + 100).withColumn("v", F.lit("x")).coalesce(1))
    full = lake.sql("SELECT id FROM t WHERE id BETWEEN 150 AND 160", prune=False)
    few = lake.sql("SELECT id FROM t WHERE id BETWEEN 150 AND 160")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, full.collect()))
    assert (len(few.inputFiles()), len(full.inputFiles())) == (1, 4)
    plan = few._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,150)" in plan and "ReadSchema: struct<id:bigint>" in plan


def files_read(df):
    return len(set(df.inputFiles()))


@pytest.fixture()
def sales(spark, lake):
    """Two tables of four files each, with ranges that don't meet; one has a deletion vector."""
    for name, n in (("a", 100), ("b", 100)):
        for k in range(4):
            lake.table(name).append(spark.range(k * n, k * n + n).selectExpr("id", f"id % 7 AS {name}v", "cast(id as string) AS s").coalesce(1))
    lake.table("a").delete(spark.createDataFrame([(5,), (105,)], "id long"), ["id"])
    return lake


@pytest.mark.parametrize(
    ("sql", "files"),
    [
        ("SELECT x.id FROM a x JOIN b y ON x.id = y.id WHERE x.id < 50", 2),  # the condition holds for both sides of the join
        ("SELECT x.id, y.bv FROM a x LEFT JOIN b y ON x.id = y.id + 300 AND y.id >= 350 WHERE x.id BETWEEN 110 AND 120", 2),
        ("SELECT x.id, y.id AS other FROM a x JOIN a y ON x.id = y.id + 300 WHERE x.id >= 390 AND y.id < 95", 2),
        ("WITH w AS (SELECT * FROM a WHERE id > 350) SELECT count(*) AS n, max(av) AS m FROM w", 1),
        ("SELECT id FROM a WHERE id IN (SELECT id FROM b WHERE id > 380)", 5),
        ("SELECT id FROM a WHERE id = (SELECT max(id) FROM b WHERE id < 60)", 5),
        ("SELECT id FROM a WHERE id < 10 UNION ALL SELECT id FROM b WHERE id > 390", 2),
        ("SELECT d.id FROM (SELECT id, av + 1 AS w FROM a) d WHERE d.id = 250", 1),
        ("SELECT id FROM a WHERE id < 10 OR id > 390", 4),
        ("SELECT id FROM a WHERE id IN (7, 12) AND s = '7'", 1),
        ("SELECT count(*) AS n FROM a WHERE id > 1000", 0),
    ],
)
def test_each_occurrence_is_pruned(sales, sql, files):
    full, few = sales.sql(sql, prune=False), sales.sql(sql)
    assert sorted(map(str, few.collect())) == sorted(map(str, full.collect()))
    data = {f for f in few.inputFiles() if "/data/" in f}
    assert len(data) <= files


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_pruning_in_other_zones(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = Lake(spark, f"file://{tmp_path}/lake").table("t")
        for day in ("2024-01-01", "2024-01-02", "2024-03-10", "2024-11-03"):
            t.append(spark.sql(f"SELECT timestamp '{day} 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int), 30, 0) AS ts, timestamp_ntz '{day} 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int), 30, 0) AS wall, id FROM range(24)").coalesce(1))
        for sql in (
            "SELECT count(*) AS n FROM t WHERE ts <= TIMESTAMP '2024-01-01 23:00:00'",
            "SELECT count(*) AS n FROM t WHERE ts >= TIMESTAMP '2024-01-02 00:30:00' AND ts < TIMESTAMP '2024-03-10 02:30:00'",
            "SELECT count(*) AS n FROM t WHERE wall = TIMESTAMP_NTZ '2024-11-03 01:30:00'",
            "SELECT count(*) AS n FROM t WHERE ts > DATE '2024-11-02'",
            "SELECT count(*) AS n FROM t WHERE ts = '2024-03-10 00:30:00'",
            "SELECT count(*) AS n FROM t WHERE wall BETWEEN '2024-01-01 03:00:00' AND TIMESTAMP '2024-01-01 05:00:00'",
        ):
            few = t.lake.sql(sql)
            assert few.first()["n"] == t.lake.sql(sql, prune=False).first()["n"] > 0
            assert files_read(few) < 4
        # keys that are instants find their rows again
        again = t.read().where("id = 23").select("ts", "wall", "id")
        assert t.upsert(again, ["ts"])[3] == 4 and t.read().count() == 96
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_statistics_filtered_by_spark_drop_the_same_files(spark, lake, monkeypatch):
    rng = random.Random(11)
    t = lake.table("t")
    for k in range(6):
        rows = [(rng.choice([None, rng.randint(k * 3, k * 3 + 5)]), rng.choice([None, rng.uniform(k, k + 2)]), rng.choice("abcdef"[k:])) for _ in range(6)]
        t.append(spark.createDataFrame(rows, "i long, d double, s string").coalesce(1))
    t.append(spark.createDataFrame([(None, None, None)] * 3, "i long, d double, s string").coalesce(1))
    snapshot = t.snapshot()
    for _ in range(25):
        wanted = [{c: comparison(rng.choice(["=", "<", "<=", ">", ">="]), v) for c, v in (("i", rng.choice([rng.randint(0, 20), rng.uniform(0, 20)])), ("d", rng.uniform(0, 8)), ("s", rng.choice("abcdefg"))) if rng.random() < 0.6} for _ in range(rng.randint(1, 2))]
        got = []
        for few in (10**6, 0):
            monkeypatch.setattr(pruning, "FEW_FILES", few)
            got.append([r.file for r in pruning.pruned(spark, snapshot, wanted)])
        assert got[0] == got[1]


def test_a_commit_does_not_grow_with_the_files(spark, lake):
    t = lake.table("t")
    t.configure(max_small_files=10**6)
    rows = spark.range(3).coalesce(1)
    for k in range(40):
        t.append(rows.withColumn("id", F.col("id") + 3 * k))
    store, snapshot = t.folder.store, t.snapshot()
    assert len(snapshot.resources) == 40 and t.read().count() == 120 and t.folder.current() == 39
    sizes = [n for p, n, _ in store.list(f"{t.folder.path}/_log") if p.endswith(".json")]
    assert sizes[-1] < 12_000 and len(snapshot.manifests) <= catalog.MANIFESTS and len(snapshot.stats) <= catalog.MANIFESTS + 1
    catalog._KNOWN.clear()
    assert [r.file for r in t.snapshot(20).resources] != [] and t.read(20).count() == 63
    for k in range(20):
        t.delete(spark.createDataFrame([(6 * k,)], "id long"), ["id"])
    assert len(t.snapshot().deletions) <= catalog.MANIFESTS and t.read().count() == 100 and t.snapshot().deletion_rows == 20
    t.delete(spark.range(30), ["id"])  # whole files go, with their part of the vectors
    assert t.read().count() == 75 and len(t.snapshot().resources) == 30 and t.snapshot().deletion_rows == 15
    store.delete(f"{t.folder.path}/_log/_last")
    assert t.read().count() == 75


def test_merged_files_keep_their_deletions(spark, lake):
    t = lake.table("t")
    t.configure(max_small_files=4)
    for k in range(3):
        t.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    t.delete(spark.createDataFrame([(1,), (11,), (25,)], "id long"), ["id"])
    before = t.snapshot()
    t.append(spark.range(30, 40).coalesce(1))  # the fourth small file: all are merged
    after = t.snapshot()
    assert len(before.resources) == 3 and len(after.resources) < 4 and after.live_rows == 37
    t.delete(spark.createDataFrame([(2,)], "id long"), ["id"])
    t.compact()
    want = sorted(set(range(40)) - {1, 2, 11, 25})
    assert sorted(r["id"] for r in t.read().collect()) == want and t.snapshot().live_rows == 36 and not t.snapshot().deletions
    assert t.read(before.version).count() == 27
    t.delete(spark.createDataFrame([(3,)], "id long"), ["id"])
    assert t.compact(force_deletions=False)["deleted_rows_dropped"] == 0 and t.read().count() == 35


def test_of_racing_commits_one_wins(spark, lake):
    store = lake.store
    for k in range(60):
        won, gate = [], threading.Barrier(4)

        def race(i):
            gate.wait()
            try:
                store.write_text(f"{lake.path}/race/{k}", str(i))  # noqa: B023
                won.append(i)  # noqa: B023
            except FileExistsError:
                pass

        threads = [threading.Thread(target=race, args=(i,)) for i in range(4)]
        [x.start() for x in threads]
        [x.join() for x in threads]
        assert len(won) == 1 and store.read_text(f"{lake.path}/race/{k}") == str(won[0])
    store.write_text(f"{lake.path}/race/0", "new", overwrite=True)
    assert store.read_text(f"{lake.path}/race/0") == "new" and not [p for p, _, _ in store.list(f"{lake.path}/race") if p.endswith(".tmp")]


def test_racing_writers_lose_nothing(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(-1, "a")]))
    errors = []

    def add(i):
        try:
            t.append(frame(spark, [(i, "x")]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and sorted(i for i, _ in seen(t)) == [-1, 0, 1, 2, 3] and t.snapshot().version == 4
    ids = [r["__rowid__"] for r in live(spark, t.snapshot(), system=True).collect()]
    assert len(set(ids)) == 5


def test_addresses_of_other_stores():
    assert address("s3a://bucket/a") == "s3://bucket/a" and address("file:/x/y") == "file:///x/y" and address("/x") == "file:///x" and address("hdfs://h:1/x") == "hdfs://h:1/x"
    store, path = pyarrow.fs.FileSystem.from_uri(address("s3a://bucket/a/b.parquet?region=eu-west-1"))
    assert store.type_name == "s3" and path == "bucket/a/b.parquet"


def test_a_timeout_ends_with_its_query(spark, lake):
    lake.table("t").append(spark.range(10))
    assert lake.sql("SELECT * FROM t", timeout=60).count() == 10
    spark.sparkContext.addJobTag("mine")
    slow = spark.range(1).select(F.udf(lambda x: __import__("time").sleep(20) or x, "long")("id").alias("id"))
    with pytest.raises(TimeoutError):
        _within(slow, 1.5)
    assert set(spark.sparkContext.getJobTags()) == {"mine"}
    assert spark.range(5).count() == 5
    spark.sparkContext.removeJobTag("mine")


def test_metrics_lie_under_their_own_day(spark, lake):
    lake.monitor.record("mcp", tool="x")
    lake.monitor.waiting["mcp"].append({"query_id": "q", "recorded_at": "2020-02-02T00:00:00+00:00"})
    assert lake.monitor.flush() == 2
    assert len([p for p, _, d in lake.store.list(f"{lake.path}/_metrics/mcp") if d]) == 2
    assert [r["query_id"] for r in lake.monitor.recent(spark, "mcp", 5).collect()][-1] == "q" and lake.monitor.recent(spark, "odata").count() == 0


def test_filter_stays_pushed_below_the_deletion_join(spark, lake):
    t = lake.table("t")
    t.append(spark.range(100).withColumn("v", F.lit("x")).coalesce(1))
    t.delete(spark.range(5), ["id"])
    plan = lake.sql("SELECT id FROM t WHERE id > 50")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "GreaterThan(id,50)" in plan


def test_sql_shim(spark):
    spark_sql = dialect.to_spark
    assert spark_sql("SELECT 'a // b' -- x // y\n, 7 // 2") == "SELECT 'a // b' -- x // y\n, 7  div  2"
    assert "NULLS LAST" in spark_sql("SELECT a FROM t ORDER BY a") and "NULLS LAST" not in spark_sql("SELECT a FROM t ORDER BY a DESC")
    assert spark_sql("SELECT log(x)") == "SELECT log10(x)"
    assert spark_sql("SELECT strftime(t, 'at %H:%M')") == "SELECT date_format(t, '''at'' HH:mm')"
    assert spark_sql("SELECT * EXCLUDE (a) FROM t") == "SELECT * EXCEPT (a) FROM t"
    ordered = spark_sql("SELECT array_agg(v ORDER BY a DESC, b DESC) AS l FROM VALUES (1, 2, 'x'), (1, 3, 'y'), (0, 9, 'z') AS t(a, b, v)")
    assert spark.sql(ordered).first()["l"] == ["y", "x", "z"]
    with pytest.raises(ValueError):
        spark_sql("SELECT array_agg(v ORDER BY a DESC, b) FROM t")
    assert "__qualify" in spark_sql("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1")
    with pytest.raises(ValueError):
        spark_sql("SELECT strftime(t, '%Q')")
    with pytest.raises(ValueError):
        dialect.classify("DROP TABLE t")
    assert dialect.classify("explain analyze select 1")[0] == "explain analyze"


def test_roles(spark, lake):
    lake.table("t").append(frame(spark, [(1, "a"), (2, "b")]))
    role = lake.roles.save(Role("r", "reader", {"t": {"columns": ["id"], "filters": [{"column": "v", "operation": "=", "value": "b"}]}}))
    assert [tuple(r) for r in lake.sql("SELECT * FROM t", role="r").collect()] == [(2,)]
    with pytest.raises(PermissionError):
        lake.sql("SELECT v FROM t", role="r")
    with pytest.raises(PermissionError):
        lake.table("t").append(frame(spark, [(3, "c")]), role="r")
    lake.table("u").append(frame(spark, [(1, "a")]))
    with pytest.raises(PermissionError):
        lake.sql("SELECT * FROM u", role="r")
    with pytest.raises(PermissionError):
        lake.sql("SELECT * FROM t", role="nobody")
    lake.roles.save_user("ann", ["r"])
    assert [x.role_id for x in lake.roles.of_user("ann")] == [role.role_id]
    df = frame(spark, [(1, "x'; DROP"), (2, None), (3, "50%_a")])
    ids = lambda f: sorted(r["id"] for r in df.where(compile_filter(f)).collect())
    assert ids({"column": "v", "operation": "=", "value": "x'; DROP"}) == [1]
    assert ids({"column": "v", "operation": "IS", "type": "null", "value": None}) == [2]
    assert ids({"column": "v", "operation": "IS NOT", "type": "null", "value": None}) == [1, 3]
    assert ids({"column": "v", "operation": "ILIKE", "value": "50!%!_A", "escape": "!"}) == [3]
    assert ids({"OR": [{"column": "id", "operation": "BETWEEN", "value": [1, 1]}, {"column": "id", "operation": "NOT IN", "value": [1, 2]}]}) == [1, 3]


def test_roles_are_those_of_a_database(spark, lake):
    for name in ("secret", "b.secret", "b.open"):
        lake.table(name).append(frame(spark, [(1, "a"), (2, "b")]))
    lake.roles.save(Role("home", "reader", {"secret": {}}))
    lake.roles.save(Role("other", "writer", {"b.*": {}, "b.secret": {"columns": ["id"], "filters": {"column": "id", "operation": "=", "value": 2}}}))
    assert lake.sql("SELECT * FROM secret", role="home").count() == 2 and lake.sql("SELECT * FROM main.secret", role="home").count() == 2
    assert [tuple(r) for r in lake.sql("SELECT * FROM b.secret", role="other").collect()] == [(2,)]
    assert lake.sql("SELECT * FROM b.open", role="other").count() == 2
    for role, sql in (("home", "SELECT * FROM b.secret"), ("home", "SHOW STATS b.secret"), ("other", "SELECT * FROM secret"), ("other", "SELECT v FROM b.secret"), ("home", "SELECT * FROM secret s JOIN b.secret t ON s.id = t.id")):
        with pytest.raises(PermissionError):
            lake.sql(sql, role=role)
    with pytest.raises(PermissionError):
        lake.table("secret").append(frame(spark, [(3, "c")]), role="other")
    lake.table("b.open").append(frame(spark, [(3, "c")]), role="other")


def test_share_and_clone(spark, lake):
    t = lake.table("t")
    t.append(frame(spark, [(1, "a"), (2, "b")]))
    t.database.clone("copy", ["t"])
    assert lake.sql("SELECT count(*) AS n FROM copy.t").first()["n"] == 2
    with pytest.raises(PermissionError):
        lake.table("copy.t").append(frame(spark, [(3, "c")]))
    with pytest.raises(NotFound):
        lake.sql("SELECT * FROM copy.u")


def test_explain_and_limit(spark, lake):
    lake.table("t").append(spark.range(50))
    assert lake.sql("SELECT * FROM t", limit=5).count() == 5
    assert lake.sql("SELECT * FROM t LIMIT 7", limit=5).count() == 7
    assert "Physical Plan" in lake.sql("EXPLAIN SELECT * FROM t").first()["plan"]
    assert lake.sql("EXPLAIN ANALYZE SELECT * FROM t").first()["rows"] == 50
    assert lake.sql("SHOW STATS t").where("column_name = 'id'").count() >= 1
    assert lake.monitor.read(spark, "writes").count() == 1


def test_quality_check_is_recorded(spark, lake):
    lake.table("t").append(frame(spark, [(1, "a"), (2, None)]))
    row = quality.run_check(lake, "t", [quality.Rule("low", "column_min", "id", 5)]).first()
    assert (row["quality_score"], row["status"], row["warnings"]) == (70, "warning", 1)
    assert lake.table("__data_quality__").read().count() == 1
    assert quality.may_run(1000, 1, None, False) and not quality.may_run(1000, 1, 900, False)


def test_audit_chain_shows_tampering(spark, tmp_path):
    log = audit.AuditLog(spark, f"file://{tmp_path}/audit", key="0123456789abcdef")
    log.append([{"category": "system", "action": "start", "detail": "secret"}])
    log.append([{"category": "authentication", "action": "login"}])
    assert log.verify()[0]
    assert {r["criterion"]: r["events"] for r in log.evidence().collect()} == {"CC6.1": 1, "CC7.1": 1, "CC7.3": 2}
    assert [r["detail"] for r in log.query(category="system").collect()] == ["secret"]
    link = log.store.list(f"{log.path}/chain/main")[0][0]
    doc = log.store.read_json(link)
    log.store.write_json(link, {**doc, "ids": ["other"]}, overwrite=True)
    assert not log.verify()[0]
    assert log.expire(legal_hold=True) == []


@pytest.mark.parametrize("forged", [{"detail": "forged"}, {"outcome": "failure"}, {"timestamp_ms": 5}, {"actor_id": None}, {"chain_hash": "x"}])
def test_forged_events_are_found(spark, tmp_path, forged):
    log = audit.AuditLog(spark, f"file://{tmp_path}/audit")
    log.append([{"category": "system", "action": "start", "detail": "é", "actor_id": "me"}, {"category": "rbac_change", "action": "grant"}])
    assert log.verify()[0]
    day = log.store.list(f"{log.path}/events")[0][0]
    rows = [r.asDict() for r in log.events().collect()]
    log.store.delete(day)
    rows[0] |= forged
    spark.createDataFrame([tuple(r[f] for f in audit.FIELDS) for r in rows], audit.SCHEMA).write.parquet(day)
    assert not log.verify()[0]


def test_a_log_stays_whole_when_days_expire(spark, tmp_path):
    log = audit.AuditLog(spark, f"file://{tmp_path}/audit")
    log.append([{"category": "system", "action": "service_stop"}, {"category": "config_change", "action": "engine_config_change"}, {"category": "system", "action": "other"}])
    assert {r["criterion"]: r["events"] for r in log.evidence().collect()} == {"A1.2": 2, "CC7.1": 2, "CC7.3": 3, "CC8.1": 1}
    log.export(f"{log.path}/out", criterion="A1.2")
    assert spark.read.json(f"{log.path}/out").count() == 2
    assert len(log.expire(1, today=datetime.date(2999, 1, 1))) == 1
    assert log.verify()[0] and log.events().count() == 0
    with pytest.raises(ValueError):
        log.append([{"categoryy": "x"}])


def test_checks_find_anomalies_against_the_last_one(spark, lake):
    t = lake.table("t")
    t.append(spark.range(100).selectExpr("id", "id * 1.0 AS x"))
    first = quality.run_check(lake, "t").first()
    assert (first["anomaly_count"], first["quality_score"], first["status"]) == (0, 100, "ok")
    t.append(spark.range(100, 200).selectExpr("id", "cast(null as double) AS x", "'new' AS extra"))
    row = quality.run_check(lake, "t").first()
    found = {(x["column_name"], x["anomaly"]): x["severity"] for x in json.loads(row["anomalies_json"])}
    assert found[(None, "row_count")] == "critical" and found[("x", "null_rate")] == "critical" and found[("id", "bounds")] == "warning"
    assert found[(None, "schema_drift")] == "warning" and found[("id", "distinct_count")] == "warning"
    assert row["anomaly_count"] == len(found) and row["status"] == "critical" and row["quality_score"] < 60
    assert quality.table_anomalies({"hours": 25, "bytes": 10}, {"bytes": 4}) == [{"column_name": None, "anomaly": "freshness", "change": 25, "severity": "warning"}, {"column_name": None, "anomaly": "table_size", "change": 150.0, "severity": "critical"}]
    assert quality.run_check(lake, "t").first()["anomaly_count"] == 0
    quality.configure_checks(lake, {"freshness_hours": -1.0})
    quality.configure_checks(lake, {"freshness_hours": 48.0}, "u")
    assert quality.run_check(lake, "t").first()["anomaly_count"] == 1 and quality.thresholds_of(lake, "u")["freshness_hours"] == 48.0
    with pytest.raises(ValueError):
        quality.configure_checks(lake, {"other": 1.0})


def test_mirrors(spark, lake, tmp_path):
    t = lake.table("t")
    t.append(frame(spark, [(1, "a"), (2, "b")]))
    mirror.configure(t.folder, ["delta", "parquet"])
    t.delete(frame(spark, [(1, "")]), ["id"])
    paths = mirror.mirror(t.folder, f"file://{tmp_path}/mirror")
    mirror.mirror(t.folder, f"file://{tmp_path}/mirror")
    log = [p for p, _, _ in t.folder.store.list(paths["delta"] + "/_delta_log") if p.endswith(".json")]
    assert len(log) == 1
    rows = spark.read.option("recursiveFileLookup", "true").parquet(paths["parquet"])
    assert [tuple(r) for r in rows.collect()] == [(2, "b")] and rows.columns == ["id", "v"]
    with pytest.raises(ValueError):
        mirror.configure(t.folder, ["other"])


def test_a_delta_mirror_keeps_files_that_did_not_change(spark, lake, tmp_path):
    t, base = lake.table("t"), f"file://{tmp_path}/mirror"
    mirror.configure(t.folder, ["delta"], base)  # the commits themselves mirror

    def seen_there():
        live_files, kinds = {}, []
        for p, _, _ in t.folder.store.list(f"{base}/delta/t/_delta_log"):
            actions = [json.loads(x) for x in t.folder.store.read_text(p).splitlines()]
            kinds.append((sum("add" in a for a in actions), sum("remove" in a for a in actions)))
            for a in actions:
                if "remove" in a:
                    del live_files[a["remove"]["path"]]
                if "add" in a:
                    live_files[a["add"]["path"]] = json.loads(a["add"]["stats"])
        rows = spark.read.schema("id long, v string").parquet(*(f"{base}/delta/t/{f}" for f in live_files)).collect() if live_files else []
        return sorted(map(tuple, rows)), kinds, live_files

    t.append(frame(spark, [(1, "a"), (2, None)]).coalesce(1))
    t.append(frame(spark, [(3, "c")]).coalesce(1))
    assert seen_there()[:2] == ([(1, "a"), (2, None), (3, "c")], [(1, 0), (1, 0)])
    t.delete(frame(spark, [(1, "")]), ["id"])
    rows, kinds, files = seen_there()
    assert rows == [(2, None), (3, "c")] and kinds[2] == (1, 1)
    assert sorted(s["numRecords"] for s in files.values()) == [1, 1] and {"minValues": {"id": 2}, "maxValues": {"id": 2}, "nullCount": {"id": 0, "v": 1}, "numRecords": 1} in files.values()
    t.delete_all()
    assert seen_there()[0] == []


def test_iceberg_mirror(spark, lake, tmp_path):
    from snaplake.sources.avro import read_container

    t = lake.table("t")
    t.append(spark.sql("SELECT 1L AS id, 'a' AS v, array(1, 2) AS l, named_struct('x', 1.5D) AS s, CAST(1 AS DECIMAL(9, 2)) AS d"))
    mirror.configure(t.folder, ["iceberg"])
    store, path = t.folder.store, mirror.mirror(t.folder, f"file://{tmp_path}/mirror")["iceberg"]
    t.append(spark.sql("SELECT 'b' AS v, 2L AS id, true AS extra"))
    mirror.mirror(t.folder, f"file://{tmp_path}/mirror")
    mirror.mirror(t.folder, f"file://{tmp_path}/mirror")
    assert store.read_text(f"{path}/metadata/version-hint.text") == "2"
    one, two = (store.read_json(f"{path}/metadata/v{k}.metadata.json") for k in (1, 2))
    ids = [{f["name"]: f["id"] for f in d["schemas"][0]["fields"]} for d in (one, two)]
    assert ids[0]["v"] == ids[1]["v"] and ids[1]["extra"] > max(ids[0].values())
    _, lists = read_container(store.read_bytes(two["snapshots"][-1]["manifest-list"]))
    meta, entries = read_container(store.read_bytes(lists[0]["manifest_path"]))
    assert meta["format-version"] == b"2" and lists[0]["added_rows_count"] == 2
    files = [e["data_file"]["file_path"] for e in entries]
    assert spark.read.schema("id long").parquet(*files).count() == 2 == sum(e["data_file"]["record_count"] for e in entries)


def test_loaders(spark, tmp_path):
    df = frame(spark, [(1, "a")])
    df.write.json(f"{tmp_path}/x.jsonl")
    df.write.option("header", True).csv(f"{tmp_path}/x.csv")
    assert load(spark, f"{tmp_path}/x.jsonl").count() == load(spark, f"{tmp_path}/x.csv").count() == 1
    with pytest.raises(ValueError):
        load(spark, "x.doc")
    assert store_path("s3://b/k") == "s3a://b/k"


def test_metrics_are_drained_once(spark, lake):
    from snaplake.operators.monitor import drain

    lake.table("t").append(spark.range(3))
    assert drain(lake, "writes") == 1
    assert drain(lake, "writes") == 0
    lake.table("t").append(spark.range(2))
    assert drain(lake, "writes") == 1
    assert sorted(r["inserted"] for r in lake.table("__writes__").read().collect()) == [2, 3]
    assert drain(lake, "compact") == 0


def test_diagnostics_and_times(spark, lake):
    from snaplake.sources.files import times_from_numbers

    assert {r["status"] for r in lake.diagnostics().collect()} == {"ok"}
    df = spark.createDataFrame([(1, 1000, 1000000, 1000000000)], "a long, b long, c long, d long")
    row = times_from_numbers(df, {"a": "s", "b": "ms", "c": "us", "d": "ns"}).selectExpr("a = b AND b = c AND c = d AS same").first()
    assert row["same"]
