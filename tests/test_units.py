"""Fixtures of the survey: time formats, query texts, conflicting schemas, names and edge rows."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.times import pattern_of, smart_time
from sightline.operators import compaction, schema
from sightline.plans import search
from sightline.sources import envelopes, store

# Times as text, their formats and instants.
CASES = [
    ("2022-01-01", None, "2022-01-01"), ("2022-01-01", "%Y-%m-%d", "2022-01-01"), ("1640995200", "unix", "2022-01-01"), ("1640995200000", "unix_ms", "2022-01-01"),
    ("2022-01-01 12:30:45", "%Y-%m-%d %H:%M:%S", "2022-01-01T12:30:45"), ("01/15/2022", "%m/%d/%Y", "2022-01-15"), ("01/15/2022 14:30", "%m/%d/%Y %H:%M", "2022-01-15T14:30"),
    ("20220101", "%Y%m%d", "2022-01-01"), ("20220101", "YYYYMMDD", "2022-01-01"), ("Jan 15, 2022", "%b %d, %Y", "2022-01-15"), ("15-Jan-2022", "%d-%b-%Y", "2022-01-15"),
    ("not-a-date", "%Y-%m-%d", None), ("2022-01-01", "%m/%d/%Y", None), ("20220101T101112", None, "2022-01-01T10:11:12"), ("NaN", None, None), ("1e400", "unix", None), ("9e18", "unix_ms", None), ("-9e18", None, None), ("Infinity", "unix_ms", None), ("1640995200", None, "2022-01-01"),
]


@pytest.mark.parametrize("value,form,want", CASES)
def test_time(spark, value, form, want):
    got = spark.createDataFrame([(value,)], "v string").select(smart_time(F.col("v"), form).cast("timestamp_ntz")).first()[0]
    assert got == (datetime.datetime.fromisoformat(want) if want else None)


def test_patterns():
    assert pattern_of("YYYY-MM-DD hh:mm:ss") == "yyyy-MM-dd HH:mm:ss" and pattern_of("unix_ms") == "unix_ms"


def test_wildcards(spark):
    names = ["acme_gateway", "acme_logins", "_own", "_indexes"]
    assert search.matching(names, "ACME_*") == names[:2] and search.matching(names, "*") == names[:3]
    store = spark.createDataFrame([(n, i) for i, n in enumerate(names[:3])], "_index string, value long")
    run = lambda sql: search.search(spark, sql, store, names).collect()
    assert run("select max(value) from *")[0][0] == 2 and len(run("SELECT * FROM ACME_logins a")) == 1
    assert len(run("select a.value from (select * from acme_* where value >= 0) a join _own b on a.value <= b.value")) == 2
    with pytest.raises(ValueError):
        run("select * from nowhere_*")
    assert len(run("select `ACME_gateway`.value, 'from nowhere_*' as t from `ACME_gateway` -- from nowhere_*\nwhere value >= 0")) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_index_")]
    assert search.paged_sql("select 1 limit 7;", 2, 10) == "select 1 limit 7 OFFSET 20"
    assert search.paged_sql("select * from (select 1 limit 7) where x = 'limit 3'", 1, 10).endswith("\nLIMIT 10 OFFSET 10")


def test_conflicting_schemas(spark):
    one = T.StructType.fromDDL("_time timestamp_ntz, badge string, door string, floor bigint")
    two = T.StructType.fromDDL("_time timestamp_ntz, badge binary, lift string, floor binary")
    assert schema.unified_schema([one, two]) == T.StructType.fromDDL("_time timestamp_ntz, badge string, door string, floor string, lift string")


def test_row_batches_skip_and_count(spark):
    text = '[{"index":"A","events":["{\\"x\\":1}"]},{"events":["{}","{}"]},{"index":"b","events":[]}]'
    df = spark.createDataFrame([(text,)], "payload string")
    assert [tuple(r) for r in envelopes.row_batches(df).collect()] == [("a", '{"x":1}')] and envelopes.reported_count(df).first()[0] == 3


def test_access_cycle_and_dates(spark):
    empty = "index_name string, read_permission boolean, write_permission boolean, delete_permission boolean, effective_date timestamp, expiration_date timestamp"
    roles = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent_id int")
    users, links = spark.createDataFrame([(7,)], "id int"), spark.createDataFrame([(7, 1)], "user_id int, role_id int")
    late = datetime.datetime(2030, 1, 1)
    grants = spark.createDataFrame([(3, "i", True, False, None, None, None), (2, "j", True, None, False, late, None)], "role_id int, " + empty)
    own = spark.createDataFrame([], "user_id int, " + empty)
    see = lambda **k: {r.index_name for r in search.effective_access(spark, users, roles, links, own, grants, **k).collect()}
    assert see() == {"i", "j"} and see(as_of="2025-01-01 00:00:00") == {"i"}


def test_names(spark):
    low, high = compaction.parse_name(F.lit("20231130235958-20231231010203_packed_20240101000000.parquet"))
    got = spark.range(1).select(low.cast("string"), high.cast("string")).first()
    assert tuple(got) == ("2023-11-30 23:59:58", "2023-12-31 01:02:03")


def test_header_formats_and_bad_times(spark):
    rows = [({"timeformat": "%d/%m/%Y %H:%M:%S", "index": "X"}, ["_time", "v"], [["01/02/2024 03:04:05", "never", "02/02/2024 00:00:00"], ["a", "b", "c"]]), ({"timeformat": "unix_ms"}, ["_time"], [["1640995200000"]])]
    df = spark.createDataFrame(rows, "header map<string,string>, columns array<string>, events array<array<string>>")
    got = [(r._index, str(r._time)) for r in envelopes.column_envelopes(df).select("_index", F.col("_time").cast("string").alias("_time")).collect()]
    assert got == [("x", "2024-02-01 03:04:05"), ("x", "2024-02-01 03:04:05"), ("x", "2024-02-02 00:00:00"), ("main", "2022-01-01 00:00:00")]
    box = spark.createDataFrame([({"timeformat": "YYYYMMDD"}, ['{"_time":"20240203"}', '{"v":1}'])], "header map<string,string>, events array<string>")
    assert [str(r[0]) for r in envelopes.row_envelopes(box).select(F.col("_time").cast("string")).collect()] == ["2024-02-03 00:00:00"]


def test_store_limits_globs_and_row_groups(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    e = spark.range(1000).select("id", F.lit("one").alias("_index"), F.lit("2024-01-01").cast("timestamp").alias("_time"))
    path = store.write_buckets(e, f"{tmp_path}/s", most=300)
    c = store.build_catalog(spark, path)
    assert sorted(r.record_count for r in c.collect()) == [100, 300, 300, 300] and store.Store(spark, path).rows(["ONE"]).count() == 1000
    for bad in (dict(glob="nothing"), dict(index="two")):
        with pytest.raises(ValueError):
            store.scan(spark, path, **bad)
    os.makedirs(f"{path}/_index=one/bucket_start=2024010100")
    pq.write_table(pa.Table.from_pandas(pd.DataFrame({"id": range(24)})), f"{path}/_index=one/bucket_start=2024010100/part-x.parquet", row_group_size=2)
    open(f"{path}/_index=one/bucket_start=2024010100/part-y.parquet.old", "w").close()
    assert [r.row_groups for r in store.read_footers(spark, path).where("row_groups > 10").collect()] == [12] and store.list_files(spark, path).count() == 5


def test_restricted():
    assert search.restricted([], ["a", "b"]) == ["a", "b"] and search.restricted(["B"], ["a", "b"]) == ["b"]
    with pytest.raises(PermissionError):
        search.restricted(["c"], ["a", "b"])


def test_frames_of_other_kinds(spark):
    """IPv6, Linux cooked captures and ARP, by hand."""
    from sightline.operators import packets

    v6 = "60000000" + "0014" + "{next}" + "40" + "20010db8000000000000000000000001" + "20010db8000000000000000000000002"
    tcp, v4 = "1F90" + "01BB" + "00" * 8 + "50" + "12" + "00" * 6 + "CAFE", "45000028000000004006" + "0000" + "0A000001" + "0A0000FE"
    arp = "FF" * 6 + "00" * 6 + "0806" + "0001080006040001" + "AABBCCDDEEFF" + "0A000001" + "112233445566" + "0A000002"
    frames = [(1, 1, "FF" * 12 + "86DD" + v6.format(next="06") + tcp), (2, 113, "00" * 14 + "0800" + v4 + tcp), (3, 1, "FF" * 12 + "86DD" + v6.format(next="3A") + "8000" + "00" * 6), (4, 1, arp), (5, 113, "00" * 14 + "86DD" + v6.format(next="11") + "00350036" + "00080000"), (6, 1, None), (7, 1, "FF")]
    df = spark.createDataFrame(frames, "id int, link_type int, h string").select("id", "link_type", F.unhex("h").alias("data"))
    got = {r.id: r for r in packets.headers(df).withColumn("names", packets.flag_names(F.col("flags"))).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert (got[1].src, got[1].proto, got[1].src_port, got[1].dst_port, got[1].names) == ("2001:0db8:0000:0000:0000:0000:0000:0001", 6, 8080, 443, "SYN|ACK")
    assert (got[2].src, got[2].dst, got[2].src_port) == ("10.0.0.1", "10.0.0.254", 8080) and (got[3].proto, got[3].src_port) == (58, None) and (got[5].proto, got[5].src_port, got[5].dst_port) == (17, 53, 54)
    assert {r.protocol: r.packets for r in packets.protocol_mix(packets.headers(df)).collect()} == {"TCP": 2, "ICMP": 1, "UDP": 1}
    blank = {r.id: bytes(r.data).hex() for r in packets.blank_arp(df.where("id = 4")).collect()}[4]
    assert blank == (arp[:56] + "0" * 8 + arp[64:76] + "0" * 8).lower()
    cut = {r.id: len(r.data) for r in packets.without_payload(packets.headers(df)).collect()}
    assert cut[1] == 14 + 40 + 20 and cut[2] == 16 + 20 + 20
