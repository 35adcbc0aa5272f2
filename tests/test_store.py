"""Snapshots, commits, compaction, quarantine, refresh, names, and searches that stay within their indexes."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from sightline.functions import times
from sightline.operators import compaction, ranks, rules, schema
from sightline.plans import search
from sightline.sources import envelopes, store
from sightline.sources.snapshots import Conflict, Snapshots, create_once
from sightline.streaming import placement
from sightline.streaming import subscriptions as subs


def events(spark, n=300, index="one", start=0):
    return spark.range(start, start + n).select("id", F.lit(index).alias("_index"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias("_time"))


def ids(spark, path, **k):
    return sorted(r.id for r in store.Store(spark, path, **k).rows().select("id").collect())


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", "a long, b string", ["a"])
    rows = lambda *x: spark.createDataFrame([(i, "x") for i in x], "a long, b string")
    assert table.rows().count() == 0 and table.snapshot().number == 0
    table.commit(rows(1, 2))
    base = table.snapshot()
    table.commit(rows(3), notes={"k": 1})
    table.commit(rows(9), table.rows(base).where("a = 1"), base)  # on top of the newer one
    assert sorted((r.a, r.version) for r in table.rows().collect()) == [(2, 1), (3, 2), (9, 3)]
    with pytest.raises(Conflict):
        table.commit(rows(8), table.rows(base).where("a = 1"), base)
    assert [r.a for r in table.rows(base).orderBy("a").collect()] == [1, 2] and table.snapshot().notes == {"k": 1}
    for i in range(20, 34):  # many tables become one
        table.commit(rows(i))
    assert table.rows().count() == 17 and len(table.snapshot().tables) < 13 and {r.a: r.version for r in table.rows().collect()}[3] == 2
    assert not create_once(spark, f"{tmp_path}/t/{1:020d}.json", "") and not [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".tmp")]


def test_compaction_through_the_path(spark, tmp_path):
    path = f"{tmp_path}/s"
    for k in range(4):
        store.write_buckets(events(spark, 30, start=30 * k), path, stamp="yyyyMMdd")
    store.write_buckets(events(spark, 10, "two").withColumn("more", F.lit(1)), path)
    before = store.catalog_of(spark, path).snapshot()
    # a crash between writing and the commit loses and adds nothing
    bins = compaction.greedy_bins(compaction.candidates(store.catalog_of(spark, path).rows(before), 10**8), 10**9, 2)
    bins.write.parquet(f"{tmp_path}/bins")
    bins = spark.read.parquet(f"{tmp_path}/bins")
    made = compaction.rewrite(spark, store.catalog_of(spark, path).rows(before), bins, path)
    assert bins.count() == 2 and made.count() == 2 and len(ids(spark, path)) == 130
    after = compaction.commit(spark, path, before, bins, made)
    assert ids(spark, path) == sorted([*range(120), *range(10)]) == ids(spark, path, number=before.number)
    assert {r.since for r in made.collect()} <= {1, 2, 3, 4}
    with pytest.raises(Conflict):  # another compaction of the same files
        compaction.commit(spark, path, before, bins, made)
    assert store.catalog_of(spark, path).snapshot().number == after.number
    assert store.set_aside(spark, path, "0 seconds").count() == 4 and len(ids(spark, path)) == 130
    assert "more" not in store.Store(spark, path).rows(["one"]).columns


def test_three_bins_three_files(spark, tmp_path):
    path = f"{tmp_path}/s"
    for k in range(6):
        store.write_buckets(events(spark, 20, start=20 * k), path, stamp="yyyyMMdd")
    compaction.compact(spark, path, 10**8, 10**9, 2)
    c = store.Store(spark, path).catalog.collect()
    assert len(c) == 3 and {r.record_count for r in c} == {40}
    loop = compaction.greedy_bins(spark.createDataFrame([("i", datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, h), f"f{h}", n) for h, n in enumerate([5, 5, 9, 20, 1, 1, 1])], "index string, day date, start_time timestamp, file_location string, length long"), 10, 3)
    assert sorted((r.bin, r.files, r.bytes) for r in loop.collect()) == [(0, 2, 10), (3, 3, 3)]


def test_quarantine(spark, tmp_path):
    """Equal names stay apart, faults of the moment move nothing, files that are gone are left out."""
    path = store.write_buckets(events(spark, 10), f"{tmp_path}/s")
    for bucket in ("a", "b"):
        os.makedirs(f"{path}/_index=one/bucket_start={bucket}")
        with open(f"{path}/_index=one/bucket_start={bucket}/part-0.parquet", "w") as f:
            f.write("no parquet at all, but long enough")
    good = store.Store(spark, path).catalog.first()["file_location"]
    with open(good.removeprefix("file:").replace("//", "/"), "r+b") as f:
        f.seek(-20, 2)
        f.write(b"\xff" * 12)  # the footer, not its marks
    moved = store.quarantine(spark, path)
    assert moved.count() == 3 and all(os.path.exists(r.moved_to) and r.reason for r in moved.collect())
    assert {r.bucket_start for r in store.quarantined(spark, path).collect()} >= {"a", "b"} and store.Store(spark, path).catalog.where(F.col("file_location") == good).count() == 0
    assert store.quarantine(spark, path).count() == 0

    calls = []

    def late(name):
        calls.append(name)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return (1,) * 6

    assert store.tried("x", late)[1] is None and len(calls) == 3
    with pytest.raises(TimeoutError):
        store.tried("x", lambda name: (_ for _ in ()).throw(TimeoutError()))
    kinds = [FileNotFoundError(), PermissionError(), store.Damaged(), OSError("reset")]
    assert [store.fault_of(e) for e in kinds] == ["absent", "denied", "format", "transient"]


def test_refresh_opens_new_files_only(spark, tmp_path):
    path = f"{tmp_path}/s"
    put = lambda b, n: events(spark, n).drop("_index").coalesce(1).write.parquet(f"{path}/_index=Abc/bucket_start={b}")
    put("007", 5)
    store.refresh(spark, path)
    name = store.Store(spark, path).catalog.first()["file_location"].removeprefix("file:").replace("//", "/")
    at = os.stat(name)
    with open(name, "r+b") as f:  # what is in the catalog isn't looked at again
        f.write(b"x" * at.st_size)
    os.utime(name, ns=(at.st_atime_ns, at.st_mtime_ns))
    put("008", 7)
    assert store.refresh(spark, path).number == 2
    assert sorted((r.bucket_start, r.record_count, r.version) for r in store.Store(spark, path).catalog.collect()) == [("007", 5, 1), ("008", 7, 2)]
    os.unlink(name)
    store.refresh(spark, path)
    s = store.Store(spark, path)
    assert [r.bucket_start for r in s.catalog.collect()] == ["008"] and s.rows(["ABC"]).count() == 7 and s.indexes() == ["Abc"]
    assert search.search(spark, "select count(*) n from abc", s.rows, s.indexes()).first().n == 7


def test_names_stay_as_written(spark, tmp_path):
    rows = events(spark, 4, "007").unionByName(events(spark, 3, "ABC d%/x")).unionByName(events(spark, 2, None))
    s = store.Store(spark, store.write_buckets(rows, f"{tmp_path}/s"))
    assert {(r._index, r["count"]) for r in s.rows().groupBy("_index").count().collect()} == {("007", 4), ("abc d%/x", 3), ("main", 2)} == {(r["index"], r.record_count) for r in s.catalog.select("index", "record_count").collect()}
    assert s.rows(["Abc D%/X"]).count() == 3 and {t for _, t in s.rows().select("_index", "bucket_start").dtypes} == {"string"}
    assert "INT96" not in str(s.catalog.select("fields").first())


def test_agreeing_fields(spark, tmp_path):
    sets = [{"a": "int", f"f{i}": "string"} | ({"v": "double"} if i % 3 == 0 else {"v": "string"} if i % 3 == 1 else {}) for i in range(200)]
    got = schema.agreeing(sets)
    assert len(got) == 2 and sorted(i for _, m in got for i in m) == list(range(200)) and len(got[0][0]) + len(got[1][0]) == 204
    path = f"{tmp_path}/s"
    for k in range(3):
        store.write_buckets(events(spark, 2, start=2 * k).withColumn(f"f{k}", F.lit(k)), path)
    plan = store.Store(spark, path).rows()._jdf.queryExecution().analyzed().toString()
    assert plan.count("parquet") == 1 and ids(spark, path) == list(range(6))


def test_search_stays_inside(spark, tmp_path):
    path = f"{tmp_path}/s"
    for index in ("open_a", "open_b", "secret"):
        store.write_buckets(events(spark, 3, index), path)
    s = store.Store(spark, path)
    access = spark.createDataFrame([(1, "open_a", True), (1, "open_b", True), (2, "secret", True)], "user_id int, index_name string, can_read boolean")
    spark.range(5).createOrReplaceTempView("hidden_view")
    run = lambda sql, user=1: search.search_as(spark, sql, s, user, access).collect()
    for sql in [
        f"select * from open_a join parquet.`{path}/_index=secret`", "select * from open_a, secret", "select (select count(*) from secret) from open_a", "with c as (select * from secret) select * from c, open_a",
        "select * from open_a where id in (select id from `SECRET`)", "select * from open_a where exists (select 1 from secret)", "select * from open_a union all select * from \"secret\"", "select * from open_a, range(3)",
        "drop table open_a", "insert into open_a select * from open_b", "create table x as select * from open_a", "select reflect('java.lang.System', 'nanoTime') from open_a", "select * from default.hidden_view",
        "show tables", "set a = b", "select * from open_a, ${x}", "with open_b as (select * from open_a) select * from open_b, (with z as (select 1 a) select * from z, secret)", "describe open_a", "select * from identifier('secret')",
    ]:
        with pytest.raises(PermissionError):
            run(sql)
    for sql in ("select * from hidden_view", "select * from open_a, hidden_view", "select * from secret_*", "select 1", "with c as (select * from c) select * from c, open_a", "select * from z, (with z as (select * from open_a) select * from z)"):
        with pytest.raises(ValueError):
            run(sql)
    for sql, n in [
        ("select * from open_a, open_b", 9), ("select * from * where id * 2 >= 2", 4), ("select a.id*2 from open_a a, open_* b where a.id*1 = b.id", 6), ("with secret as (select * from open_a) select * from secret", 3),
        ("with a as (select * from open_a), b as (select * from a) select * from b x join a on x.id = a.id", 3), ("select open_a.id from open_a join (select id from open_b where id > 0) y using (id)", 2),
        ("select count(*), 'from secret' from open_a -- , secret\n", 1), ("select * from open_a lateral view explode(array(1, 2)) t as z", 6), ("select * from _indexes", 2), ("values (1), (2)", None), ("select * from (select * from open_a) , open_b where 1 = 1", 9),
    ]:
        if n is None:
            with pytest.raises(ValueError):
                run(sql)
        else:
            assert len(run(sql)) == n, sql
    assert len(run("select * from secret", 2)) == 3 and spark.catalog.tableExists("hidden_view")


def test_batches_of_a_stream_come_once(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert subs.put_batch(events(spark, 5), path, "q", 0) and not subs.put_batch(events(spark, 5), path, "q", 0)
    assert subs.put_batch(events(spark, 5, start=5), path, "q", 1) and not subs.put_batch(events(spark, 5), path, "q", 0) and subs.put_batch(events(spark, 1, start=10), path, "other", 0)
    assert ids(spark, path) == list(range(11)) and store.Store(spark, path).catalog.agg(F.sum("record_count")).first()[0] == 11
    assert subs.put_batch(events(spark, 0), path, "q", 2) and not subs.put_batch(events(spark, 3), path, "q", 2)


def test_placement_against_a_loop(spark):
    minute = placement.MINUTE
    limits = placement.Limits(10 * minute, 60 * minute, 30, 3, 60 * minute, 10 * minute)
    lane = placement.Lane(limits)
    at = lambda *x: lane.place(*(v * minute for v in x[:3]), x[3])
    assert at(100, 90, 100, 20) == (0, 80 * minute, 140 * minute)
    assert at(101, 95, 130, 10)[0] == 0 and at(102, 95, 130, 1)[0] == 1  # no room in the first any more
    assert at(103, 10, 20, 1) == (2, 0, 60 * minute)  # late events open an older bucket; the one that waited longest closes
    assert [b[3] for b in lane.buckets] == [1, 2] and at(104, 60, 61, 1)[0] == 2 and at(105, 0, 0, 1)[0] == 3
    assert placement.Lane(limits, lane.state()).buckets == lane.buckets
    lane.close(10_000 * minute)
    assert not lane.buckets and lane.next == 4


def test_ranks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = ranks.numbered(df, [F.col("k")], parts=7)
    assert all(r.place == r.k + 1 for r in got.collect()) and got.count() == 1000
    for n, most in ((0, None), (500, None), (990, 20), (123, 300), (1000, None), (5, 1)):
        want = list(range(n, 1000 if most is None else min(1000, n + most)))
        assert sorted(r.k for r in ranks.skipped(df, [F.col("k")], n, most, 7).collect()) == want
    assert ranks.skipped(df.limit(0), [F.col("k")], 3).count() == 0


def test_merge_of_single_files(spark, tmp_path):
    for k in range(5):
        events(spark, 4, start=4 * k).withColumn(f"f{k % 2}", F.lit(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done = compaction.merge_batches(spark, store.list_files(spark, f"{tmp_path}/in"), 2, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in done.collect()) == [(0, 2, 8), (1, 2, 8), (2, 1, 4)]
    assert store.list_files(spark, f"{tmp_path}/out").count() == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_long_envelopes(spark):
    n = 100_000
    one = spark.range(1).select(F.create_map(F.lit("timeformat"), F.lit("unix")).alias("header"), F.array(F.lit("_time"), F.lit("v")).alias("columns"), F.array(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 3 == 1, i.cast("string")).otherwise("bad")), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))).alias("events"))
    began = time.time()
    got = envelopes.column_envelopes(one).select(F.unix_timestamp("_time").alias("t"), F.col("fields")["v"].cast("long").alias("v")).where("t <> v - (v - 1) % 3").count()
    assert got == 0 and time.time() - began < 30
    lead = spark.createDataFrame([({}, ["_raw"], [["x", None, "2024-01-01", None]]), ({}, ["v"], [["1"]]), (None, ["_time"], [["1"]])], "header map<string,string>, columns array<string>, events array<array<string>>")
    assert [str(r.t) for r in envelopes.column_envelopes(lead).select(F.when(F.year("_time") > 2024, "now").otherwise(F.col("_time").cast("string")).alias("t")).collect()] == ["now", "now", "2024-01-01 00:00:00", "2024-01-01 00:00:00"]


def test_times_by_type(spark):
    row = spark.range(1).select(*[times.smart_time(c).cast("timestamp_ntz").alias(n) for n, c in [("number", F.lit(20220101)), ("text", F.lit("20220101")), ("clock", F.lit("12:30")), ("real", F.lit(1640995200.5)), ("year", F.lit("2022-1-5")), ("none", F.lit(None).cast("int"))]]).first()
    assert row.number == datetime.datetime(1970, 8, 23, 0, 41, 41) and row.text == datetime.datetime(2022, 1, 1) and row.clock is None and row.real.microsecond == 500_000 and row.year == datetime.datetime(2022, 1, 5) and row.none is None


def test_chain_and_cycle_of_roles(spark):
    roles = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (30, None)], "id int, parent_id int")
    got = {}
    for r in search.above(roles).collect():
        got.setdefault(r.role_id, set()).add(r.ancestor)
    assert got[0] == set(range(13)) and got[20] == got[21] == {20, 21} and got[30] == {30}


def test_two_runs_of_rules_at_once(spark, tmp_path):
    path, to = store.write_buckets(events(spark, 4), f"{tmp_path}/s"), f"{tmp_path}/alerts"
    own = [{"id": "r", "title": None, "level": None, "fields": [{"field": "I", "op": "equals", "values": ["1", "3"]}]}]
    bound = rules.bind(spark.createDataFrame([("r",)], "id string"), spark.createDataFrame([("r", "ONE"), ("r", "later")], "rule_id string, index_id string"))
    run = lambda: rules.detect(spark, path, to, own, {"r": {"I": "id"}}, bound)
    run()
    run()
    assert store.Store(spark, to).rows().count() == 2 and rules.seen_upto(spark, to) == 1
    store.write_buckets(events(spark, 4, "later"), path)
    store.write_buckets(events(spark, 4, "other"), path)
    run()
    found = store.Store(spark, to).rows()
    assert sorted((r.index_id, r.n) for r in found.groupBy("index_id").agg(F.count("*").alias("n")).collect()) == [("later", 2), ("one", 2)]
