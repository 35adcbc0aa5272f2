"""Registered queries of the event store, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import times
from .operators import compaction, packets, rules, schema
from .plans import search as plan
from .sources import envelopes, store
from .streaming import placement
from .streaming import subscriptions as subs

Q: dict = {}
SQL: dict[str, str] = {}
DAY = "yyyyMMdd"
E = "(SELECT *, 'evt_' || lower(event_type) AS _index FROM events)"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return store.as_events(table(spark, d, "events"))


def bucketed(spark: SparkSession, d: str) -> str:
    return store.write_buckets(events(spark, d), store.fresh_dir(spark), stamp=DAY)


def opened(spark: SparkSession, d: str) -> store.Store:
    return store.Store(spark, bucketed(spark, d))


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)




# roles above regions: 4 below 1, and 2 and 3 below each other
ACCESS = """WITH RECURSIVE ro AS (SELECT n_nationkey AS id, 100 + n_regionkey AS parent FROM nation UNION ALL SELECT 100 + r_regionkey, 100 + [2, NULL, 3, 2, 1][r_regionkey + 1] FROM region),
up AS (SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer UNION SELECT user_id, parent FROM up JOIN ro ON ro.id = up.role_id WHERE parent IS NOT NULL),
g AS (SELECT user_id, 'evt_click' AS index_name FROM up WHERE role_id = 101 UNION ALL SELECT user_id, 'evt_view' FROM up WHERE role_id = 7 UNION ALL SELECT c_custkey, 'evt_error' FROM customer WHERE c_custkey % 3 = 0)
SELECT DISTINCT user_id, index_name FROM g"""


# ---- search


@query(f"SELECT _index, count(*) AS n, max(ts) AS last FROM {E} GROUP BY 1")
def wildcard_count(spark, d):
    s = opened(spark, d)
    return plan.search(spark, "select _index, count(*) n, cast(max(_time) as timestamp_ntz) last from evt_* group by 1", s.rows, s.indexes())


@query(f"SELECT a._index, count(*) AS n FROM {E} a JOIN (SELECT DISTINCT user_id FROM {E} WHERE _index = 'evt_purchase') b USING (user_id) WHERE a._index = 'evt_click' GROUP BY 1")
def index_join(spark, d):
    s = opened(spark, d)
    return plan.search(spark, "select a._index, count(*) n from EVT_Click a join (select distinct user_id from evt_purchase) b on a.user_id = b.user_id group by a._index", s.rows, s.indexes())


IN_RANGE = "min(ts) OVER w <= TIMESTAMP '2024-01-10 12:30:00' AND max(ts) OVER w >= TIMESTAMP '2024-01-09 12:30:00'"


@query(f"SELECT event_id, ts FROM (SELECT *, {IN_RANGE} AS hit FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts))) WHERE hit")
def time_pruned_search(spark, d):
    return opened(spark, d).rows(None, "2024-01-09 12:30:00", "2024-01-10 12:30:00").select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09 12:30:00' AND TIMESTAMP '2024-01-10 12:30:00' AND event_type IN ('click', 'view')")
def time_strict_search(spark, d):
    return opened(spark, d).rows(["EVT_click", "evt_view"], "2024-01-09 12:30:00", "2024-01-10 12:30:00", strict=True).select("event_id", "ts")


@query("SELECT e.event_id, count(*) AS buckets FROM events e JOIN (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY event_type, date_trunc('day', ts)) b ON b.event_type = e.event_type AND e.ts BETWEEN b.lo AND b.hi GROUP BY 1")
def bucket_range_join(spark, d):
    return store.buckets_of(events(spark, d), opened(spark, d).catalog).groupBy("event_id").agg(F.count("*").alias("buckets"))


RANGES = {"1h": "1 HOUR", "6h": "6 HOUR", "12h": "12 HOUR", "24h": "24 HOUR", "3d": "3 DAY", "7d": "7 DAY", "14d": "14 DAY", "1m": "1 MONTH", "3m": "3 MONTH", "1y": "1 YEAR"}


@query(" UNION ALL ".join(f"SELECT '{r}' AS name, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {i}" for r, i in RANGES.items()) + " UNION ALL SELECT 'ytd', count(*) FROM events WHERE ts >= (SELECT date_trunc('year', max(ts)) FROM events)")
def relative_ranges(spark, d):
    e = events(spark, d)
    now = F.lit(e.agg(F.max("_time").alias("now")).first()["now"])
    counts = e.agg(*[F.count(F.when(F.col("_time") >= times.range_start(now, r), 1)).alias(r) for r in [*RANGES, "ytd"]])
    return counts.unpivot([], [*RANGES, "ytd"], "name", "n")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def relative_range(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("_time").alias("now")).first()["now"]
    return e.where(F.col("_time") >= times.range_start(F.lit(now), "7d")).select("event_id")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND user_id = 8 ORDER BY value DESC, event_id LIMIT 50")
def filter_dict(spark, d):
    return plan.filtered(table(spark, d, "events"), {"event_type": ["click", "view"], "user_id": "8", "unknown": 1}, ["-value", "event_id"], 50).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, value FROM events WHERE value > 50 AND event_type <> 'error'")
def store_scan(spark, d):
    return store.scan(spark, bucketed(spark, d)).where("value > 50 and event_type <> 'error'").select("event_id", "value")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def file_glob_scan(spark, d):
    return store.scan(spark, bucketed(spark, d), "part-*", index="EVT_Click").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND date_trunc('day', ts) = (SELECT min(date_trunc('day', ts)) FROM events WHERE event_type = 'click')")
def single_file_scan(spark, d):
    s = opened(spark, d)
    first = s.catalog.where("index = 'evt_click'").orderBy("start_time", "file_location").first()["file_location"]
    return spark.read.parquet(first).select("event_id", "event_type")


def drifted(spark, d) -> store.Store:
    """A store whose second half has value as text and another field."""
    e = events(spark, d)
    path = store.write_buckets(e.where(F.col("_time") < "2024-01-15").drop("props"), store.fresh_dir(spark), stamp=DAY)
    store.write_buckets(e.where(F.col("_time") >= "2024-01-15").withColumns({"value": F.col("value").cast("int").cast("string"), "more": F.lit(1)}), path, stamp=DAY)
    return store.Store(spark, path)


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN props END AS props, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 END AS more, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN CAST(trunc(value) AS BIGINT) ELSE -1 END AS value FROM events")
def schema_drift_scan(spark, d):
    e = drifted(spark, d).rows()
    return e.select("event_id", "props", "more", F.when(F.col("_time") >= "2024-01-15", F.col("value").cast("bigint")).otherwise(-1).alias("value"))


@query(f"SELECT _index, count(*) AS n, 1::BIGINT AS broken FROM {E} GROUP BY 1")
def quarantine_scan(spark, d):
    """A store with one damaged file: it is moved away and the rest is read."""
    path = bucketed(spark, d)
    spark.range(1).select(F.lit("no parquet").alias("value")).coalesce(1).write.mode("append").text(f"{path}/_index=evt_click/bucket_start=20240101")
    broken = store.quarantine(spark, path)
    left = store.read_footers(spark, path)
    return store.Store(spark, path, left).rows().groupBy("_index").agg(F.count("*").alias("n")).withColumn("broken", F.lit(broken.count() - left.where("not ok").count()).cast("bigint"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 300")
def paged_search(spark, d):
    return plan.page(table(spark, d, "orders"), 3, 100, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def last_records(spark, d):
    return plan.last_records(events(spark, d), "event_id").select("event_id", "ts")


@query(f"SELECT (SELECT count(*) FROM {E} WHERE _index = 'evt_click' AND value > 50) AS returned, (SELECT count(*) FROM {E} WHERE _index = 'evt_click') AS total")
def result_envelope(spark, d):
    s = opened(spark, d)
    got = s.rows(["evt_click"]).where("value > 50").agg(F.count("*").alias("returned"))
    return got.withColumn("total", F.lit(store.record_total(plan_files(s)).first()[0]).cast("bigint"))


def plan_files(s: store.Store) -> DataFrame:
    return store.prune(s.catalog, ["evt_click"])


@query("SELECT count(*)::HUGEINT::BIGINT AS record_count FROM (SELECT *, min(ts) OVER w AS lo FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts))) WHERE lo >= TIMESTAMP '2024-01-20'")
def record_totals(spark, d):
    s = opened(spark, d)
    return store.record_total(s.catalog, s.catalog.where(F.col("start_time") >= "2024-01-20"))


SQL_SEARCH = f"""SELECT kind, n, top FROM (SELECT 'both' AS kind, count(*) AS n, max(value) AS top FROM {E} WHERE _index IN ('evt_click', 'evt_view') UNION ALL
SELECT x.kind, count(1), max(x.value) FROM (SELECT 'from evt_x' AS kind, value FROM {E} WHERE _index = 'evt_error') x GROUP BY 1) ORDER BY 1 DESC, 2 LIMIT 5"""


@query(SQL_SEARCH)
def sql_surface(spark, d):
    """UNION ALL, a derived table, ordinals, a quoted name and a literal that looks like a table, paged."""
    s = opened(spark, d)
    sql = """select kind, n, top from (select 'both' kind, count(*) n, max(value) top from (select * from `EVT_Click` union all select * from evt_view) b
      union all select x.kind, count(1), max(x.value) from (select 'from evt_x' kind, value from evt_error limit 100000000) x group by 1) order by 1 desc, 2"""
    return plan.search(spark, plan.paged_sql(sql, 0, 5), s.rows, s.indexes())


@query(f"""WITH c AS (SELECT user_id, count(*) AS n FROM {E} WHERE _index = 'evt_click' GROUP BY 1) SELECT v.user_id, c.n, count(*) AS views FROM {E} v, c WHERE v._index = 'evt_view' AND v.user_id = c.user_id
AND c.n > (SELECT count(*) FROM {E} WHERE _index = 'evt_error') / 1000000.0 GROUP BY 1, 2""")
def sql_names(spark, d):
    """Indexes in a list of tables, in a common table expression and in a subquery."""
    s = opened(spark, d)
    sql = """with c as (select user_id, count(*) n from evt_cl* group by 1) select evt_view.user_id, c.n, count(*) views from evt_view, c
      where evt_view.user_id = c.user_id and c.n > (select count(*) from "EVT_error") / 1000000.0 group by 1, 2"""
    return plan.search(spark, sql, s.rows, s.indexes())


# ---- schema


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS balance, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'S' || s_suppkey, s_acctbal, s_name, NULL FROM supplier")
def reconcile_union(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    s = table(spark, d, "supplier").selectExpr("'S' || s_suppkey as key", "s_name as name", "s_acctbal as balance")
    return schema.reconcile([c, s])


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def promote_union(spark, d):
    return schema.promote_union([table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as name", "c_mktsegment as segment"), table(spark, d, "supplier").selectExpr("s_suppkey as key", "s_name as name")])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def align_first(spark, d):
    c = table(spark, d, "customer")
    return schema.align_to_first([c.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), c.where("c_custkey % 2 = 1").selectExpr("c_name", "cast(c_custkey as int) as c_custkey").select("c_custkey", "c_name")])


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier")
def drop_null_columns(spark, d):
    return schema.without_null_columns(promote_union(spark, d).join(table(spark, d, "supplier").selectExpr("s_suppkey as key", "s_name as name"), ["key", "name"], "left_semi"))[0]


@query("SELECT event_id, CASE WHEN value > 50 THEN value END AS value, ts FROM events")
def zone_harmonised(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_id % 2 = 0").selectExpr("event_id", "if(value > 50, value, null) as value", "ts")
    b = e.where("event_id % 2 <> 0").selectExpr("event_id", "if(value > 50, value, null) as value", "cast(ts as timestamp) as ts")
    return schema.reconcile([a, b]).select("event_id", "value", ntz("ts"))


@query("SELECT side, field, type, (SELECT count(*) FROM events WHERE (ts < TIMESTAMP '2024-01-15') = (side = 'left')) AS n FROM (VALUES ('left', 'value', 'double'), ('right', 'value', 'string'), ('right', 'props', 'string'), ('right', 'more', 'int')) t(side, field, type)")
def schema_difference(spark, d):
    """Fields of the files of two times, as the files have them, with the rows on that side."""
    c = drifted(spark, d).catalog
    a, b = c.where("bucket_start < '20240115'"), c.where("bucket_start >= '20240115'")
    rows = a.agg(F.sum("record_count").alias("n")).withColumn("side", F.lit("left")).unionByName(b.agg(F.sum("record_count").alias("n")).withColumn("side", F.lit("right")))
    return schema.schema_difference(schema.field_list(a), schema.field_list(b)).join(rows, "side")


@query("SELECT event_id, '{\"user_id\":' || user_id || CASE WHEN value > 50 THEN ',\"kind\":\"' || event_type || '\"' ELSE '' END || '}' AS record FROM events")
def null_fields_dropped(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("event_type")).alias("kind"))
    return e.select("event_id", plan.without_null_fields(e.select("user_id", "kind")).alias("record"))


# ---- catalog and meta tables

BUCKETS = f"SELECT _index AS index, strftime(ts, '%Y%m%d') AS bucket_start, count(*) AS record_count, min(ts) AS start_time, max(ts) AS end_time FROM {E} GROUP BY 1, 2"


@query(BUCKETS)
def catalog_build(spark, d):
    c = store.build_catalog(spark, bucketed(spark, d))
    return c.groupBy("index", "bucket_start").agg(F.sum("record_count").alias("record_count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).select("index", "bucket_start", "record_count", ntz("start_time"), ntz("end_time"))


@query(f"SELECT index, count(*) AS buckets, sum(record_count)::BIGINT AS record_count, true AS sized, min(start_time) AS start_time, max(end_time) AS end_time FROM ({BUCKETS}) GROUP BY 1")
def indexes_meta(spark, d):
    s = opened(spark, d)
    sql = "select index, buckets, record_count, size > record_count sized, cast(start_time as timestamp_ntz) start_time, cast(end_time as timestamp_ntz) end_time from _indexes"
    return plan.search(spark, sql, s.rows, s.indexes(), {m: s.meta(m) for m in plan.META})


@query(f"SELECT index, count(*) AS buckets, sum(record_count)::BIGINT AS record_count, min(start_time) AS start_time FROM ({BUCKETS}) GROUP BY 1")
def indexes_merged(spark, d):
    """Summaries of two stores, early and late days, made apart and merged."""
    e = events(spark, d)
    parts = [store.Store(spark, store.write_buckets(e.where(when), store.fresh_dir(spark), stamp=DAY)).meta("_indexes") for when in (F.col("_time") < "2024-01-15", F.col("_time") >= "2024-01-15")]
    return store.merged_indexes(parts[0].unionByName(parts[1])).select("index", "buckets", "record_count", F.col("start_time").cast("timestamp_ntz").alias("start_time"))


@query(f"SELECT DISTINCT _index AS index FROM {E} WHERE ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT * FROM (VALUES ('_indexes'), ('_schema')) t(i)")
def index_list(spark, d):
    return spark.createDataFrame([(n,) for n in [*opened(spark, d).indexes("2024-01-20"), *plan.META]], "index string")


@query(f"SELECT index, count(*) AS files, sum(n)::BIGINT AS rows, max(v)::BIGINT AS version FROM (SELECT _index AS index, strftime(ts, '%Y%m%d') AS h, count(*) AS n, CASE WHEN min(ts) < TIMESTAMP '2024-01-25' THEN 1 ELSE 2 END AS v FROM {E} WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2, date_trunc('day', ts)) GROUP BY 1")
def catalog_refresh(spark, d):
    """Files that others write into a store: days up to the 24th come first, then the rest, while those before the 5th go."""
    e, path = events(spark, d).withColumn("bucket_start", F.date_format("_time", DAY)), store.fresh_dir(spark)
    write = lambda rows: rows.repartition("_index", "bucket_start").write.mode("append").partitionBy("_index", "bucket_start").parquet(path)
    write(e.where(F.col("_time") < "2024-01-25"))
    store.refresh(spark, path)
    write(e.where(F.col("_time") >= "2024-01-25"))
    early = store.Store(spark, path).catalog.where("bucket_start < '20240105'").select("file_location")
    store.moved(early, lambda name: f"{name}.old").write.format("noop").mode("overwrite").save()
    store.refresh(spark, path)
    return store.Store(spark, path).catalog.groupBy("index").agg(F.countDistinct("bucket_start").alias("files"), F.sum("record_count").alias("rows"), F.max("version").alias("version"))


@query(f"SELECT _index AS index, 'string' AS event_type, CASE WHEN h < TIMESTAMP '2024-01-15' THEN 'double' ELSE 'string' END AS value, CASE WHEN h >= TIMESTAMP '2024-01-15' THEN 'int' END AS more, count(*) AS buckets, sum(n)::BIGINT AS events FROM (SELECT _index, date_trunc('day', ts) AS h, count(*) AS n FROM {E} GROUP BY 1, 2) GROUP BY 1, 2, 3, 4")
def schema_meta(spark, d):
    s = drifted(spark, d)
    sql = "select __index index, event_type, value, more, count(distinct _bucket_id) buckets, sum(_count) events from _schema group by 1, 2, 3, 4"
    return plan.search(spark, sql, s.rows, s.indexes(), {m: s.meta(m) for m in plan.META})


@query(f"SELECT index, count(*) AS files, sum(record_count)::BIGINT AS record_count, true AS sized, 0::BIGINT AS broken FROM ({BUCKETS}) GROUP BY ROLLUP (index)")
def file_stats(spark, d):
    """sized: megabytes on disk are those of the listing, and raw ones those of the row per file."""
    path = bucketed(spark, d)
    footers = store.read_footers(spark, path)
    index = F.regexp_extract("path", "_index=([^/]+)/", 1).alias("index")
    listed = store.list_files(spark, path).rollup(index).agg(F.round(F.sum("length") / 1e6, 2).alias("listed"))
    files = store.file_table(footers).rollup("index").agg(F.sum("raw_mb").alias("raw"), F.count("*").alias("n"))
    both = store.file_stats(footers).join(listed.withColumnRenamed("index", "_i"), F.col("index").eqNullSafe(F.col("_i"))).join(files.withColumnRenamed("index", "_j"), F.col("index").eqNullSafe(F.col("_j")))
    sized = (F.col("mb") == F.col("listed")) & (F.abs(F.col("raw_mb") - F.col("raw")) <= 0.005 * (F.col("n") + 1)) & (F.size("broken_files") == 0)
    return both.select("index", "files", "record_count", sized.alias("sized"), "broken")


@query("SELECT count(*) AS listed, 0::BIGINT AS flagged FROM (SELECT DISTINCT event_type, date_trunc('day', ts) FROM events)")
def file_listing(spark, d):
    path = bucketed(spark, d)
    listed = store.list_files(spark, path).select(F.regexp_extract("path", "(_index=[^/]+/bucket_start=[^/]+)/", 1).alias("b")).agg(F.countDistinct("b").alias("listed"))
    return listed.withColumn("flagged", F.lit(store.read_footers(spark, path).where("row_groups > 10").count()).cast("bigint"))


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def json_results(spark, d):
    path = store.fresh_dir(spark)
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props").write.option("compression", "gzip").json(path)
    return spark.read.schema("event_id long, user_id long, event_type string, value double, props string").json(path)


# ---- ingest and time

KIND = "event_id % 4"


def written_times(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    text = F.expr(f"case {KIND} when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") when 1 then cast(unix_timestamp(cast(ts as timestamp)) as string) when 2 then cast(unix_timestamp(cast(ts as timestamp)) * 1000 as string) else 'bad' end")
    raw = e.select("event_id", "user_id", text.alias("raw"), F.expr(KIND).alias("kind"))
    return raw.withColumn("t", F.when(F.col("kind") == 2, times.smart_time(F.col("raw"), "unix_ms")).otherwise(times.smart_time(F.col("raw"))))


@query(f"SELECT event_id, CASE WHEN {KIND} < 3 THEN date_trunc('second', ts) END AS t FROM events")
def smart_time(spark, d):
    return written_times(spark, d).select("event_id", ntz("t"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN date_trunc('second', ts) END AS t FROM events")
def hostile_time(spark, d):
    """Numbers that are no times: NaN, infinite and far out of range give null and end no job."""
    bad = F.try_element_at(F.array(*[F.lit(x) for x in ("NaN", "1e400", "9e18", "-9e18")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 5 == 4, F.unix_timestamp("_time").cast("string")).otherwise(bad).alias("raw"))
    return e.select("event_id", F.coalesce(times.smart_time(F.col("raw")), times.smart_time(F.when(F.col("event_id") % 5 < 4, F.col("raw")), "unix_ms")).cast("timestamp_ntz").alias("t"))


#: Formats as a sender names them, with the patterns that write such times.
WRITTEN = [("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%d/%b/%Y:%H:%M:%S", "dd/MMM/yyyy:HH:mm:ss"), ("YYYY-MM-DD hh:mm:ss", "yyyy-MM-dd HH:mm:ss"), ("YYYYMMDD", "yyyyMMdd"), ("%m/%d/%Y", "MM/dd/yyyy")]


@query("SELECT event_id, CASE WHEN event_id % 6 < 3 THEN date_trunc('second', ts) WHEN event_id % 6 < 5 THEN date_trunc('day', ts) END AS t FROM events")
def time_formats(spark, d):
    """Times in strptime and token formats, and a text that doesn't fit its format."""
    e = events(spark, d).withColumn("kind", F.col("event_id") % 6)
    t = F.lit(None).cast("timestamp")
    for k, (form, pattern) in enumerate(WRITTEN):
        t = F.when(F.col("kind") == k, times.smart_time(F.date_format("_time", pattern), form)).otherwise(t)
    t = F.when(F.col("kind") == 5, times.smart_time(F.date_format("_time", "yyyy-MM-dd"), "%m/%d/%Y")).otherwise(t)
    return e.select("event_id", t.cast("timestamp_ntz").alias("t"))


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN {KIND} < 3 THEN date_trunc('second', ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), TIMESTAMP '2024-02-01') AS t FROM events")
def time_ffill(spark, d):
    return times.filled_times(written_times(spark, d), "t", "user_id", "event_id", F.lit("2024-02-01").cast("timestamp")).select("event_id", ntz("t"))


@query("SELECT user_id, min(ts) AS min_time, max(ts) AS max_time, arg_min(ts, event_id) AS first_time, arg_max(ts, event_id) AS last_time FROM events GROUP BY 1")
def batch_times(spark, d):
    return times.batch_times(events(spark, d), "user_id", "_time", "event_id").select("user_id", *[ntz(c) for c in ("min_time", "max_time", "first_time", "last_time")])


@query("SELECT 'evt_' || event_type AS _index, event_id, value FROM events")
def row_batches(spark, d):
    e = table(spark, d, "events").withColumn("json", F.to_json(F.struct("event_id", "value")))
    one = e.groupBy("user_id", F.expr(LOT), F.concat(F.lit("EVT_"), "event_type").alias("index")).agg(F.collect_list("json").alias("events"))
    payload = one.groupBy("user_id", "lot").agg(F.to_json(F.collect_list(F.struct("index", "events"))).alias("payload"))
    return envelopes.row_batches(payload).select("_index", F.get_json_object("event", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("event", "$.value").cast("double").alias("value"))


#: Batches hold the events of a user within a range of ids, 500 at most.
LOT = "event_id div 500 as lot"


def packed(spark, d, columns: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as when", columns)


@query("SELECT 'main' AS _index, date_trunc('second', ts) AS t, event_id, 'header' AS event_type FROM events")
def envelope_rows(spark, d):
    e = packed(spark, d, "1 as one").withColumn("json", F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("when").alias("at"))))
    box = e.groupBy("user_id", F.expr(LOT)).agg(F.collect_list("json").alias("events")).withColumn("header", F.create_map(F.lit("timefield"), F.lit("at"), F.lit("event_type"), F.lit("header")))
    return envelopes.row_envelopes(box).select("_index", F.col("_time").cast("timestamp_ntz").alias("t"), F.col("fields")["event_id"].cast("bigint").alias("event_id"), F.col("fields")["event_type"].alias("event_type"))


@query("SELECT 'main' AS _index, date_trunc('second', ts) AS t, event_id, event_type, 'constant' AS source FROM events")
def envelope_columns(spark, d):
    e = packed(spark, d, "1 as one")
    box = e.groupBy("user_id", F.expr(LOT)).agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("a"), F.col("event_type").alias("b"), F.col("when").alias("c"))).alias("r"))
    box = box.select(F.create_map(F.lit("source"), F.lit("constant"), F.lit("event_type"), F.lit("header"), F.lit("timeformat"), F.lit("%Y-%m-%dT%H:%M:%S")).alias("header"), F.array(F.lit("event_id"), F.lit("event_type"), F.lit("_time")).alias("columns"), F.array(F.col("r.a"), F.col("r.b"), F.col("r.c")).alias("events"))
    f = F.col("fields")
    return envelopes.column_envelopes(box).select("_index", F.col("_time").cast("timestamp_ntz").alias("t"), f["event_id"].cast("bigint").alias("event_id"), f["event_type"].alias("event_type"), f["source"].alias("source"))


@query("SELECT event_id, date_trunc('hour', ts) AS bucket_start, ((row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) - 1) // 3)::BIGINT AS seq FROM events")
def bucket_assign(spark, d):
    e = events(spark, d).withColumn("bucket_start", F.window("_time", "1 hour")["start"])
    rank = F.row_number().over(W.partitionBy("_index", "bucket_start").orderBy("_time", "event_id"))
    return e.select("event_id", ntz("bucket_start"), F.floor((rank - 1) / 3).cast("bigint").alias("seq"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start_time, count(*) AS n FROM s GROUP BY user_id, s""")
def bucket_expiry(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id", F.session_window("_time", "30 minutes").alias("s")).agg(F.count("*").alias("n"), F.min("_time").cast("timestamp_ntz").alias("start_time")).select("user_id", "start_time", "n")


@query("SELECT event_type AS index, strftime(ts, '%Y%m%d') AS bucket_start, count(*) AS n FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY < TIMESTAMP '2024-01-20 06:00:00' AND max(ts) < TIMESTAMP '2024-01-19 20:00:00'")
def expired_buckets(spark, d):
    """Buckets to close: their end is past by six hours and they had no event for ten."""
    now = F.lit("2024-01-20 06:00:00").cast("timestamp")
    b = events(spark, d).groupBy(F.col("_index"), F.window("_time", "1 day").alias("w")).agg(F.count("*").alias("n"), F.max("_time").alias("last"))
    return compaction.expired(b, F.col("w.end"), F.col("last"), now, "0 hours", "10 hours").select(F.regexp_replace("_index", "^evt_", "").alias("index"), F.date_format("w.start", DAY).alias("bucket_start"), "n")


# ---- compaction

FILES = "SELECT event_type AS index, date_trunc('day', ts)::DATE AS day, date_trunc('hour', ts) AS h, 100 * count(*) AS size FROM events GROUP BY 1, 2, 3"


def hour_files(spark, d) -> DataFrame:
    e = events(spark, d).groupBy(F.col("event_type").alias("index"), F.date_trunc("HOUR", "_time").alias("start_time")).agg((100 * F.count("*")).alias("length"), F.count("*").alias("record_count"))
    return e.withColumn("file_location", F.date_format("start_time", "yyyyMMddHH"))


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY index, day ORDER BY h) AS k, count(*) OVER (PARTITION BY index, day) AS c FROM ({FILES})),
r AS (SELECT index, day, k, 0 AS bin, size AS bytes, 1 AS files, size FROM f WHERE k = 1 AND c >= 2
UNION ALL SELECT f.index, f.day, f.k, CASE WHEN r.files >= 5 OR r.bytes + f.size > 1500 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.files >= 5 OR r.bytes + f.size > 1500 THEN f.size ELSE r.bytes + f.size END, CASE WHEN r.files >= 5 OR r.bytes + f.size > 1500 THEN 1 ELSE r.files + 1 END, f.size FROM r JOIN f ON f.index = r.index AND f.day = r.day AND f.k = r.k + 1)
SELECT index, day, bin, count(*) AS files, sum(size)::BIGINT AS bytes FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def compaction_plan(spark, d):
    files = compaction.candidates(hour_files(spark, d), 100_000)
    return compaction.greedy_bins(files, 1500, 5).select("index", "day", "bin", "files", "bytes")


def compacted(spark, d) -> tuple[str, int]:
    """A store of two writes of each day whose small files have become one file an index and day; and the number of the snapshot before."""
    path, e = store.fresh_dir(spark), events(spark, d)
    for part in range(2):
        store.write_buckets(e.where((F.hour("_time") < 12) == F.lit(part == 0)), path, stamp=DAY)
    before = store.catalog_of(spark, path).snapshot().number
    compaction.compact(spark, path, 100_000_000, 1_000_000_000, 5)
    return path, before


@query("SELECT event_id, value FROM events")
def compaction_rows(spark, d):
    """What a reader who opens the store by its path sees after the compaction."""
    return store.Store(spark, compacted(spark, d)[0]).rows().select("event_id", "value")


@query(f"SELECT _index AS index, count(DISTINCT (date_trunc('day', ts), hour(ts) >= 12)) AS files_before, count(DISTINCT date_trunc('day', ts)) AS files_after, count(*) AS rows_before, count(*) AS rows_after FROM {E} GROUP BY 1")
def compaction_commit(spark, d):
    """Files and rows by the snapshots before and after; files that none but the older one names are set aside last."""
    path, number = compacted(spark, d)
    before, after = (store.Store(spark, path, number=n).catalog.groupBy("index").agg(F.count("*").alias(f"files_{w}"), F.sum("record_count").alias(f"rows_{w}")) for n, w in ((number, "before"), (None, "after")))
    store.set_aside(spark, path, "0 seconds")
    return before.join(after, "index")


@query(f"SELECT _index AS index, strftime(ts, '%Y%m%d') AS bucket_start, (count(DISTINCT event_id % 4) + 1) // 2 AS files, count(*) AS n FROM {E} GROUP BY 1, 2")
def compaction_bins(spark, d):
    """Bins of at most two files each keep files of their own: every index and day has as many files as bins."""
    path = store.fresh_dir(spark)
    for part in range(4):
        store.write_buckets(events(spark, d).where(F.col("event_id") % 4 == part), path, stamp=DAY)
    compaction.compact(spark, path, 100_000_000, 1_000_000_000, 2)
    return store.Store(spark, path).catalog.groupBy("index", "bucket_start").agg(F.count("*").alias("files"), F.sum("record_count").alias("n"))


@query(f"SELECT index || strftime(h, '%Y%m%d%H') AS file, ((row_number() OVER (ORDER BY h, index) - 1) // 20)::BIGINT AS batch FROM ({FILES})")
def merge_batches(spark, d):
    return compaction.fixed_batches(hour_files(spark, d), 20, "start_time", "index").select(F.concat("index", "file_location").alias("file"), "batch")


@query("SELECT event_type AS index, strftime(min(ts), '%Y%m%d%H%M%S') || '-' || strftime(max(ts), '%Y%m%d%H%M%S') || '_packed_20240201000000' AS name, date_trunc('second', min(ts)) AS start_time FROM events GROUP BY 1")
def packed_names(spark, d):
    e = events(spark, d).groupBy(F.col("event_type").alias("index")).agg(F.min("_time").alias("lo"), F.max("_time").alias("hi"))
    e = e.withColumn("name", compaction.packed_name(F.col("lo"), F.col("hi"), F.lit("2024-02-01").cast("timestamp")))
    return e.select("index", "name", compaction.parse_name(F.col("name"))[0].cast("timestamp_ntz").alias("start_time"))


# ---- streams

SUBS = [("s1", ["evt_click"], {"user_id": ["8", "9"]}), ("s2", [], {"event_type": ["error"], "nofield": ["x"]}), ("s3", ["evt_view", "evt_error"], {}), ("s4", ["evt_click"], {"user_id": ["9", "8"]})]
ROUTED = f"SELECT 's1' AS stream_id, event_id FROM {E} WHERE _index = 'evt_click' AND user_id IN (8, 9) UNION ALL SELECT 's2', event_id FROM {E} WHERE event_type = 'error' UNION ALL SELECT 's3', event_id FROM {E} WHERE _index IN ('evt_view', 'evt_error')"


def subscribed(spark) -> DataFrame:
    return subs.define(spark.createDataFrame(SUBS, subs.SUBSCRIPTION))


@query(ROUTED)
def firehose_route(spark, d):
    return subs.route(events(spark, d), subscribed(spark)).select("stream_id", "event_id")


@query(f"SELECT a.user_id, sum(s.n)::BIGINT AS streams FROM (SELECT 'evt_' || event_type AS index_name, count(*) AS n FROM events GROUP BY 1) s JOIN ({ACCESS}) a USING (index_name) GROUP BY 1")
def streams_visible(spark, d):
    """Streams derived from events, one for each, and how many of them each user may see."""
    s = table(spark, d, "events").select(F.col("event_id").alias("stream_id"), F.array(F.concat(F.lit("evt_"), "event_type")).alias("indexes"))
    return subs.visible_counts(s, access(spark, d).where("can_read"))


@query("""SELECT c.c_custkey AS user_id, s.stream_id FROM customer c JOIN (SELECT r_regionkey AS stream_id, r_regionkey AS k FROM region) s ON s.k = c.c_nationkey % 5 UNION ALL SELECT c_custkey, 99 FROM customer""")
def streams_of_users(spark, d):
    """Each user reads one index; one stream is over all indexes."""
    c = table(spark, d, "customer").selectExpr("c_custkey as user_id", "'i' || (c_nationkey % 5) as index_name", "true as can_read")
    s = table(spark, d, "region").selectExpr("cast(r_regionkey as bigint) as stream_id", "array('i' || r_regionkey, 'i' || r_regionkey) as indexes")
    return subs.visible(s.unionByName(spark.createDataFrame([(99, [])], "stream_id bigint, indexes array<string>")), c)


@query("SELECT event_id FROM events ORDER BY ts, event_id OFFSET 100")
def stream_replay(spark, d):
    return subs.replay(events(spark, d), "100", ["_time", "event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE ts < TIMESTAMP '2024-01-20') WHERE k > 50 UNION ALL SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def stream_replay_tail(spark, d):
    """What is there from the 51st row on, then what comes in two more batches."""
    e, path, base = landed(spark, d)
    old = e.where(F.col("_time") < "2024-01-20")
    new = e.where(F.col("_time") >= "2024-01-20")
    new.where("event_id % 2 = 0").write.mode("append").parquet(path)
    subs.replay_then_tail(spark, old, path, "50", ["_time", "event_id"], f"{base}/out", f"{base}/state")
    new.where("event_id % 2 <> 0").write.mode("append").parquet(path)
    subs.run_available(subs.parquet_stream(spark, e, path), f"{base}/out", f"{base}/state")
    return spark.read.schema(e.schema).parquet(f"{base}/out/*.parquet").select("event_id")


def landed(spark, d, *parts) -> tuple[DataFrame, str, str]:
    base = store.fresh_dir(spark)
    return events(spark, d), f"{base}/in", base


@query(f"SELECT _index, event_id, strftime(ts, '%Y%m%d') AS bucket_start FROM {E}")
def stream_ingest(spark, d):
    """Two runs of a stream into the store, the second from the checkpoint; then a batch that comes again adds nothing."""
    e, path, base = landed(spark, d)
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select("event_id", "_index", "_time").write.mode("append").json(path)
        subs.ingest(envelopes.landing_stream(spark, path, "event_id long, _index string, _time timestamp"), f"{base}/out", f"{base}/state", DAY, "events")
    subs.put_batch(e.select("event_id", "_index", "_time"), f"{base}/out", "events", 1, DAY)
    return store.Store(spark, f"{base}/out").rows().select("_index", "event_id", "bucket_start")


LIVE = ROUTED.replace("'s4'", "'s1'") + f" UNION ALL SELECT 's9', event_id FROM {E} WHERE event_id % 2 = 1 AND _index = 'evt_signup'"


@query(LIVE + " EXCEPT ALL SELECT 's3', event_id FROM " + E + " WHERE event_id % 2 = 1 AND _index IN ('evt_view', 'evt_error')")
def subscriptions_live(spark, d):
    """Between two batches of a stream one subscription comes and one goes; the stream goes on from its checkpoint and follows."""
    e, path, base = landed(spark, d)
    table = subs.subscription_table(spark, f"{base}/subscriptions")
    subs.subscribe(table, subscribed(spark))
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(path)
        subs.route_live(subs.parquet_stream(spark, e, path), table, f"{base}/out{part}", f"{base}/state")
        subs.subscribe(table, spark.createDataFrame([("s8", ["evt_click"], {"user_id": ["9", "8", "9"]}), ("s9", ["evt_signup"], {})], subs.SUBSCRIPTION))
        subs.unsubscribe(table, spark.createDataFrame([("s3",)], "stream_id string"))
    return spark.read.parquet(f"{base}/out0/*").unionByName(spark.read.parquet(f"{base}/out1/*")).select("stream_id", "event_id")


# batches: the events of an index and hour, which come up to twelve hours late
BATCHES = f"SELECT _index, strftime(ts, '%Y%m%d%H') AS batch, max(ts) + to_hours(((hour(ts) * 7) % 5 * 3)::INTEGER) AS arrival, min(ts) AS low, max(ts) AS high, count(*) AS n FROM {E} GROUP BY 1, 2, hour(ts)"
PLACES = f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY _index ORDER BY arrival, batch) AS k FROM ({BATCHES})),
r AS (SELECT DISTINCT _index, 0::BIGINT AS k, NULL::VARCHAR AS batch, 0::BIGINT AS next, NULL::BIGINT AS seq, NULL::TIMESTAMP AS start_time, NULL::TIMESTAMP AS end_time, []::STRUCT(s TIMESTAMP, e TIMESTAMP, n BIGINT, q BIGINT, a TIMESTAMP)[] AS open FROM b
UNION ALL SELECT _index, k, batch, next, (put[1]).q, (put[1]).s, (put[1]).e, CASE WHEN len(full_list) >= 3 THEN list_filter(full_list, lambda o: o.q <> (list_sort(list_transform(full_list, lambda o: struct_pack(a := o.a, q := o.q)))[1]).q) ELSE full_list END FROM (
  SELECT _index, k, batch, next, put, list_transform(left_open, lambda o: CASE WHEN o.q = (put[1]).q THEN put[1] ELSE o END) || CASE WHEN fit IS NULL THEN put ELSE []::STRUCT(s TIMESTAMP, e TIMESTAMP, n BIGINT, q BIGINT, a TIMESTAMP)[] END AS full_list FROM (
    SELECT _index, k, batch, left_open, fit, next + (fit IS NULL)::BIGINT AS next, [CASE WHEN fit IS NULL THEN {{'s': low - INTERVAL 10 MINUTE, 'e': greatest(low + INTERVAL 110 MINUTE, high), 'n': n, 'q': next, 'a': arrival}} ELSE {{'s': fit.s, 'e': fit.e, 'n': fit.n + n, 'q': fit.q, 'a': arrival}} END] AS put FROM (
      SELECT *, (list_filter(left_open, lambda o: low <= o.e AND high > o.s AND o.n < 6))[1] AS fit FROM (
        SELECT b._index, b.k, b.batch, b.low, b.high, b.arrival, b.n, r.next, list_filter(r.open, lambda o: NOT (o.e < b.arrival - INTERVAL 4 HOUR AND o.a < b.arrival - INTERVAL 1 HOUR)) AS left_open FROM r JOIN b ON b._index = r._index AND b.k = r.k + 1))))
) SELECT _index, batch, seq, start_time, end_time FROM r WHERE k > 0"""
LIMITS = placement.Limits(start_delta=10 * placement.MINUTE, duration=120 * placement.MINUTE, most=6, open=3, over=240 * placement.MINUTE, idle=60 * placement.MINUTE)


def hour_batches(spark, d) -> DataFrame:
    hours = F.hour("_time") * 7 % 5 * 3
    e = events(spark, d).withColumns({"batch": F.date_format("_time", "yyyyMMddHH"), "arrival": F.col("_time") + F.make_interval(hours=hours)})
    return placement.batches_of(e, "batch", "arrival")


@query(PLACES)
def bucket_place(spark, d):
    return placement.place(hour_batches(spark, d), LIMITS).select("_index", "batch", "seq", ntz("start_time"), ntz("end_time"))


@query(PLACES)
def bucket_place_stream(spark, d):
    """The batches as they arrive, in three runs of a stream that keeps its open buckets."""
    _, path, base = landed(spark, d)
    batches = hour_batches(spark, d)
    batches.write.parquet(f"{base}/all")
    batches = spark.read.parquet(f"{base}/all")
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2099-01-01"]
    for low, high in zip(cuts, cuts[1:], strict=False):
        batches.where((F.col("arrival") >= low) & (F.col("arrival") < high)).write.mode("append").parquet(path)
        subs.run_available(placement.place_stream(subs.parquet_stream(spark, batches, path), LIMITS), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("_index", "batch", "seq", ntz("start_time"), ntz("end_time"))


@query(ROUTED)
def subscription_restore(spark, d):
    e, path, base = landed(spark, d)
    subscribed(spark).write.parquet(f"{base}/subscriptions")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(path)
        subs.run_available(subs.route(subs.parquet_stream(spark, e, path), spark.read.parquet(f"{base}/subscriptions")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("stream_id", "event_id")


@query(f"SELECT _index, date_trunc('hour', ts) AS bucket_start, count(*) AS n FROM {E} GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_summary(spark, d):
    e, path, base = landed(spark, d)
    e.write.parquet(path)
    subs.run_available(subs.summary(subs.parquet_stream(spark, e, path)), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("_index", ntz("bucket_start"), "n")


# ---- rules

YAML = """id: r1
title: Errors of user 8
level: high
detection: {selection: {Kind: error, User: 8}}
---
id: r2
title: Text
level: low
detection: {selection: {"Kind|contains": rcha, "Kind|startswith": pur}}
---
title: no id
---
id: [broken
---
id: r3
title: unmapped
detection: {selection: {Other: 1}}
---
id: r4
title: Any of two
level: low
detection: {selection: {Kind: [click, view], User: [8, 9]}}
---
id: r4
title: Older text of the same id
level: low
detection: {selection: {Kind: signup}}
"""
FIELD_MAP = [("r1", "Kind", "event_type"), ("r1", "User", "user_id"), ("r2", "Kind", "event_type"), ("r4", "Kind", "event_type"), ("r4", "User", "user_id")]
MAPPING = {"r1": {"Kind": "event_type", "User": "user_id"}, "r2": {"Kind": "event_type"}}
MATCHED = f"SELECT 'r1' AS rule_id, * FROM {E} WHERE event_type = 'error' AND user_id = 8 UNION ALL SELECT 'r2', * FROM {E} WHERE event_type = 'purchase'"


def rule_table(spark) -> DataFrame:
    """The rules, of equal ids the one whose path comes last."""
    parts = YAML.split("---\n")
    return rules.load_rules(spark.createDataFrame([(f"rules/{99 - i:02}.yml", t) for i, t in enumerate(parts)], "path string, value string"))


def rule_list(spark) -> list:
    return [r.asDict(recursive=True) for r in rule_table(spark).where("id <> 'r4'").collect()]


@query(f"SELECT 'r1' AS rule_id, event_id FROM {E} WHERE event_type = 'error' AND user_id = 8 UNION ALL SELECT 'r4', event_id FROM {E} WHERE event_type = 'click' AND user_id IN (8, 9)")
def rules_bound(spark, d):
    """Rule, binding and field tables, the last two made here: r4 is bound to one of its two indexes, r2 to none, r1 twice."""
    all_rules = rule_table(spark)
    pairs = spark.createDataFrame([("r1", "EVT_error"), ("r1", "evt_error"), ("r4", "evt_click"), ("r9", "evt_view")], "rule_id string, index_id string")
    bound = rules.bind(all_rules, pairs)
    maps = rules.mappings(spark.createDataFrame(FIELD_MAP, "rule_id string, rule_field string, index_field string"))
    return rules.match_bound(events(spark, d), [r.asDict(recursive=True) for r in all_rules.collect()], maps, bound).select("rule_id", "event_id")


@query(f"SELECT rule_id, event_id FROM ({MATCHED})")
def rule_matches(spark, d):
    return rules.match(events(spark, d), rule_list(spark), MAPPING).select("rule_id", "event_id")


@query(f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) AS k FROM ({MATCHED})) SELECT rule_id, count(*) AS num_rows, string_agg('{{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}}', chr(10) ORDER BY k) FILTER (k <= 5) AS result_data FROM m GROUP BY 1")
def rule_exec_log(spark, d):
    m = rules.match(events(spark, d), rule_list(spark), MAPPING).select("rule_id", "event_id", "user_id", "_time")
    return rules.executions(m, ["event_id", "user_id"], ["_time", "event_id"])


@query(f"""SELECT 'alerts_rule_' || rule_id AS _index, ts, rule_id, _index AS index_id, CASE rule_id WHEN 'r1' THEN 'event_type equals error AND user_id equals 8' ELSE 'event_type contains rcha AND event_type startswith pur' END AS query,
event_type AS matched_kind, 'Rule matched: ' || CASE rule_id WHEN 'r1' THEN 'Errors of user 8' ELSE 'Text' END AS message, 'rule' AS alert_type FROM ({MATCHED})""")
def rule_alerts(spark, d):
    found = rules.alerts(rules.match(events(spark, d), rule_list(spark), MAPPING), rule_list(spark), MAPPING)
    return found.select("_index", F.col("_time").cast("timestamp_ntz").alias("ts"), "rule_id", "index_id", "query", F.col("matched_fields")["event_type"].alias("matched_kind"), "message", "alert_type")


@query(f"SELECT rule_id, event_id FROM ({MATCHED})")
def stream_alerts(spark, d):
    e, path, base = landed(spark, d)
    e.write.parquet(path)
    subs.run_available(rules.match(subs.parquet_stream(spark, e, path), rule_list(spark), MAPPING), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("rule_id", "event_id")


@query(f"SELECT 'alerts_rule_' || rule_id AS _index, rule_id, event_id FROM ({MATCHED})")
def rules_incremental(spark, d):
    """Rules run after each of two writes, once more with nothing new, and after a compaction of what they have seen: the alerts of one run over all."""
    path, to = store.fresh_dir(spark), store.fresh_dir(spark)
    own = [r.asDict(recursive=True) for r in rules.upsert(rule_table(spark).where("id <> 'r2'"), rule_table(spark).where("id = 'r2'")).where("id <> 'r4'").collect()]
    pairs = spark.createDataFrame([("r1", "evt_error"), ("r2", "evt_purchase"), ("r1", "evt_view")], "rule_id string, index_id string")
    bound = rules.bind(rule_table(spark), pairs)
    for part in (0, 1):
        store.write_buckets(events(spark, d).where(F.col("event_id") % 2 == part), path, stamp=DAY)
        rules.detect(spark, path, to, own, MAPPING, bound)
    compaction.compact(spark, path, 100_000_000, 1_000_000_000, 5, rules.seen_upto(spark, to))
    rules.detect(spark, path, to, own, MAPPING, bound)
    found = store.Store(spark, to).rows()
    return found.select("_index", "rule_id", F.get_json_object("raw_event", "$.event_id").cast("bigint").alias("event_id"))


@query(f"""SELECT 'alerts_rule_' || rule_id AS _index, max(ts) AS ts, rule_id, _index AS index_id, count(*) AS num_rows, arg_min(event_id, (ts, event_id)) AS first FROM ({MATCHED}) GROUP BY 3, 4""")
def rule_samples(spark, d):
    m = rules.match(events(spark, d), rule_list(spark), MAPPING)
    found = rules.summaries(m, rule_list(spark), MAPPING, ["event_id"], ["_time", "event_id"])
    return found.select("_index", ntz("_time").alias("ts"), "rule_id", "index_id", "num_rows", F.get_json_object(F.split("sample", "\n")[0], "$.event_id").cast("bigint").alias("first"))


@query("SELECT user_id AS rule_id, date_trunc('hour', ts) AS run_at FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2")
def rule_schedule(spark, d):
    due = events(spark, d).select(F.col("user_id").alias("rule_id"), F.date_trunc("HOUR", "_time").alias("run_at")).distinct()
    return rules.not_yet_run(due, due.where("rule_id % 2 <> 0")).select("rule_id", ntz("run_at"))


# ---- access, audit, history

def access(spark, d) -> DataFrame:
    roles = table(spark, d, "nation").selectExpr("n_nationkey as id", "100 + n_regionkey as parent_id").unionByName(table(spark, d, "region").selectExpr("100 + r_regionkey as id", "100 + array(2, null, 3, 2, 1)[r_regionkey] as parent_id"))
    c = table(spark, d, "customer")
    grant = "true as read_permission, false as write_permission, false as delete_permission".split(", ")
    role_permissions = spark.createDataFrame([(101, "evt_click"), (7, "evt_view")], "role_id int, index_name string").selectExpr("*", *grant)
    own = c.where("c_custkey % 3 = 0").selectExpr("c_custkey as user_id", "'evt_error' as index_name", *grant)
    return plan.effective_access(spark, c, roles, c.selectExpr("c_custkey as user_id", "c_nationkey as role_id"), own, role_permissions)


@query(ACCESS)
def effective_access(spark, d):
    return access(spark, d).where("can_read").select("user_id", "index_name")


@query(f"SELECT a.user_id, e._index, e.n FROM ({ACCESS}) a JOIN (SELECT _index, count(*) AS n FROM {E} GROUP BY 1) e ON e._index = a.index_name")
def visible_events(spark, d):
    sizes = events(spark, d).groupBy("_index").agg(F.count("*").alias("n"))
    return access(spark, d).where("can_read").join(sizes, F.col("index_name") == F.col("_index")).select("user_id", "_index", "n")


@query(f"""WITH a AS (SELECT user_id, index_name, true AS can_read, false AS can_write FROM ({ACCESS}) UNION ALL SELECT c_custkey, i, true, true FROM customer, (SELECT DISTINCT _index AS i FROM {E}) WHERE c_custkey % 50 = 0
UNION ALL SELECT c_custkey, m, true, false FROM customer, (VALUES ('_indexes'), ('_schema')) t(m)) SELECT user_id, index_name, bool_or(can_read) AS can_read, bool_or(can_write) AS can_write FROM a GROUP BY 1, 2""")
def full_access(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return plan.full_access(access(spark, d), users, users.where("user_id % 50 = 0"), opened(spark, d).indexes()).select("user_id", "index_name", "can_read", "can_write")


@query(f"SELECT user_id, index_name FROM ({ACCESS}) JOIN (SELECT DISTINCT _index FROM {E} WHERE ts >= TIMESTAMP '2024-01-29') ON _index = index_name")
def user_indexes(spark, d):
    """Indexes that each user can read and that have events in the window."""
    have = store.prune(opened(spark, d).catalog, None, "2024-01-29").select(F.col("index").alias("index_name")).distinct()
    return access(spark, d).where("can_read").join(have, "index_name", "left_semi").select("user_id", "index_name")


@query(f"SELECT user_id, index_name FROM ({ACCESS}) WHERE user_id % 2 = 1 OR index_name = CASE WHEN user_id % 4 = 0 THEN 'evt_click' ELSE 'evt_view' END")
def requested_indexes(spark, d):
    """Users with even numbers ask for one index each, the others for none in particular."""
    wanted = table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as user_id", "if(c_custkey % 4 = 0, 'EVT_click', 'evt_VIEW') as index_name")
    return plan.permitted(wanted, access(spark, d))


@query(f"SELECT _index, count(*) AS n FROM {E} WHERE _index IN (SELECT index_name FROM ({ACCESS}) WHERE user_id = 3) GROUP BY 1 ORDER BY 1 LIMIT 10")
def search_as_user(spark, d):
    """A wildcard search finds what the user may read only."""
    return plan.search_as(spark, "select _index, count(*) n from evt_* group by 1 order by 1", opened(spark, d), 3, access(spark, d), number=0, size=10)


@query("SELECT c_custkey AS user_id, 'evt_' || e.event_type AS index_name FROM customer c JOIN (SELECT DISTINCT event_type FROM events) e ON e.event_type = CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' END")
def existing_permissions(spark, d):
    kind = F.when(F.col("c_custkey") % 3 == 0, "click").when(F.col("c_custkey") % 3 == 1, "view").otherwise("nosuch")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("evt_"), kind).alias("index_name"))
    return plan.existing_permissions(wanted, opened(spark, d).catalog)


CLIENT = "CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.0.' || user_id WHEN 2 THEN 'peer' ELSE 'unknown' END"


@query(f"SELECT {CLIENT} AS ip_address, (event_id % 5 < 4) AS success, count(*) AS n FROM events GROUP BY 1, 2")
def audit_client_ip(spark, d):
    e = table(spark, d, "events").selectExpr("if(event_id % 4 = 0, '10.0.0.' || user_id, '') as real_ip", "if(event_id % 4 = 1, ' 10.1.0.' || user_id || ', 1.1.1.1', null) as forwarded", "if(event_id % 4 = 2, 'peer', null) as host", "100 * (event_id % 5) + 1 as status_code")
    ip = plan.client_ip(F.col("real_ip"), F.col("forwarded"), F.col("host"))
    return e.groupBy(ip.alias("ip_address"), (F.col("status_code") < 400).alias("success")).agg(F.count("*").alias("n"))


@query(f"SELECT ts, user_id, 'GET /' || event_type AS action, (event_id % 5 < 4) AS success, {CLIENT} AS ip_address, '{{\"status_code\":' || (100 * (event_id % 5) + 1) || ',\"path\":\"/' || event_type || '\"}}' AS details FROM events")
def audit_rows(spark, d):
    e = table(spark, d, "events").selectExpr("cast(ts as timestamp) as time", "user_id", "'get' as method", "'/' || event_type as path", "cast(100 * (event_id % 5) + 1 as int) as status_code", "if(event_id % 4 = 0, '10.0.0.' || user_id, '') as real_ip", "if(event_id % 4 = 1, ' 10.1.0.' || user_id || ', 1.1.1.1', null) as forwarded", "if(event_id % 4 = 2, 'peer', null) as host")
    return plan.audit_rows(e).select(ntz("_time").alias("ts"), "user_id", "action", "success", "ip_address", "details")


HISTORY = "SELECT user_id, event_type AS query, max(ts) AS last_used, count(*) AS times_used FROM events GROUP BY 1, 2"


def history(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("query")).agg(F.max("ts").alias("last_used"), F.count("*").alias("times_used"))


@query(HISTORY)
def history_upsert(spark, d):
    return history(spark, d).orderBy(F.desc("last_used"))


@query(HISTORY)
def history_merge(spark, d):
    """A history of the first days, with the log of the later ones taken in."""
    e = table(spark, d, "events")
    early, late = e.where("ts < timestamp_ntz '2024-01-15'"), e.where("ts >= timestamp_ntz '2024-01-15'")
    old = early.groupBy("user_id", F.col("event_type").alias("query")).agg(F.max("ts").alias("last_used"), F.count("*").alias("times_used"))
    return plan.merged_history(old, late.select("user_id", F.col("event_type").alias("query"), F.col("ts").alias("used_at")))


@query(f"SELECT * FROM ({HISTORY}) WHERE contains(query, 'cli')")
def history_search(spark, d):
    return history(spark, d).where(F.contains(F.lower("query"), F.lower(F.lit("CLI")))).orderBy(F.desc("last_used"))


@query(f"SELECT user_id, query, last_used, times_used FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, query) AS k FROM ({HISTORY})) WHERE k <= 2")
def history_retention(spark, d):
    return plan.newest(history(spark, d), ["user_id"], [F.desc("last_used"), F.asc("query")], 2)


@query(f"SELECT * FROM ({HISTORY}) WHERE user_id <> 8")
def history_delete(spark, d):
    return history(spark, d).where("user_id <> 8")


# ---- packets


def frames(spark, d) -> DataFrame:
    """Ethernet frames made of lineitem's integers: IPv4 with TCP, UDP or ICMP."""
    h = lambda c, n: F.lpad(F.hex(c), n, "0")
    li = table(spark, d, "lineitem").withColumn("p", F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1)), (F.col("l_linenumber") % 3 + 1).cast("int")))
    ip = F.concat(F.lit("450000280000000040"), h(F.col("p"), 2), F.lit("0000"), F.lit("0A00"), h(F.col("l_suppkey") % 65536, 4), F.lit("0B00"), h(F.col("l_partkey") % 65536, 4))
    tcp = F.concat(h(F.col("l_orderkey") % 65536, 4), F.lit("01BB"), F.lit("0000000000000000"), F.lit("50"), h(F.col("l_linenumber") * 7 % 64, 2), F.lit("000000000000"), F.lit("DEADBEEF"))
    return li.select("l_orderkey", "l_linenumber", F.lit(1).alias("link_type"), F.unhex(F.concat(F.lit("FFFFFFFFFFFF0000000000000800"), ip, tcp)).alias("data"))


PROTO = "CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END"


@query(f"SELECT CASE {PROTO} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'other' END AS protocol, count(*) AS packets, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS share FROM lineitem GROUP BY 1")
def protocol_mix(spark, d):
    return packets.protocol_mix(packets.headers(frames(spark, d)))


@query(f"SELECT l_orderkey, l_linenumber, '10.0.' || (l_suppkey // 256) % 256 || '.' || l_suppkey % 256 AS src, CASE WHEN {PROTO} <> 1 THEN l_orderkey % 65536 END AS src_port, CASE WHEN {PROTO} <> 1 THEN 443::BIGINT END AS dst_port FROM lineitem")
def packet_headers(spark, d):
    return packets.headers(frames(spark, d)).select("l_orderkey", "l_linenumber", "src", "src_port", "dst_port")


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_linenumber * 7 % 64 AS b FROM lineitem WHERE {PROTO} = 6),
n AS (SELECT *, concat_ws('|', CASE WHEN b & 1 > 0 THEN 'FIN' END, CASE WHEN b & 2 > 0 THEN 'SYN' END, CASE WHEN b & 4 > 0 THEN 'RST' END, CASE WHEN b & 8 > 0 THEN 'PSH' END, CASE WHEN b & 16 > 0 THEN 'ACK' END, CASE WHEN b & 32 > 0 THEN 'URG' END) AS s FROM f)
SELECT CASE WHEN s = '' THEN 'None' ELSE s END AS flags, count(*) AS n FROM n GROUP BY 1""")
def tcp_flags(spark, d):
    return packets.headers(frames(spark, d)).where("proto = 6").groupBy(packets.flag_names(F.col("flags")).alias("flags")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {PROTO} = 6 THEN 54 ELSE 42 END::INTEGER AS size, count(*) AS n FROM lineitem GROUP BY 1")
def strip_payload(spark, d):
    return packets.without_payload(packets.headers(packets.blank_arp(frames(spark, d)))).groupBy(F.octet_length("data").alias("size")).agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
