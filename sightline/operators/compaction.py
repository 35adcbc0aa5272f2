"""Small-file compaction: candidates, greedy bins, rewrite, publication and reports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import store
from ..sources.snapshots import Snapshot
from . import ranks


def candidates(catalog: DataFrame, threshold: int, upto: int | None = None) -> DataFrame:
    """Files smaller on disk than threshold of (index, day) groups that have two or more; upto: only files that snapshots up to that number added."""
    small = catalog.where((F.col("length") < threshold) & (F.col("record_count") > 0)).withColumn("day", F.to_date("start_time"))
    small = small if upto is None else small.where(F.coalesce("since", "version") <= upto)
    many = small.groupBy("index", "day").count().where("count >= 2").drop("count")
    return small.join(many, ["index", "day"], "left_semi")


def greedy_bins(files: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """index, day, bin, files, bytes (on disk), paths: bins filled in the order of start time and path; bins of one are left out.
    A group is one index's small files of one day, bounded by the ingest rate of a day."""

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for name, size in group.sort_values(["start_time", "file_location"])[["file_location", "length"]].itertuples(index=False):
            if not rows or len(rows[-1][0]) >= most_files or rows[-1][1] + size > most_bytes:
                rows.append([[], 0])
            rows[-1][0].append(name)
            rows[-1][1] += size
        full = [(*key, k, len(names), size, sorted(names)) for k, (names, size) in enumerate(rows) if len(names) > 1]
        return pd.DataFrame(full, columns=["index", "day", "bin", "files", "bytes", "paths"])

    return files.select("index", "day", "start_time", "file_location", F.col("length").cast("long").alias("length")).groupBy("index", "day").applyInPandas(fill, "index string, day date, bin int, files long, bytes long, paths array<string>")


def fixed_batches(files: DataFrame, size: int, *order: str) -> DataFrame:
    """batch number of files taken in order, `size` at a time: places come from range partitions and their counts."""
    return ranks.numbered(files, [F.col(c) for c in order], "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def rewrite(spark: SparkSession, catalog: DataFrame, bins: DataFrame, path: str) -> DataFrame:
    """Write the rows of each bin (index, day, bin, paths) as one file below the store's path, with a folder of its own, and
    check that none is lost. Returns catalog rows of the new files, which no reader sees before a commit. Indexes whose
    fields agree are written together; files of one whose fields differ are brought to one schema."""
    name = uuid.uuid4().hex
    tag = F.concat_ws("-", F.lit(name), F.date_format("day", "yyyyMMdd"), F.col("bin").cast("string"))
    of = bins.select(tag.alias("_write"), F.date_format("day", "yyyyMMdd").alias("_day"), F.explode("paths").alias("file_location"))
    to = store.fresh_dir(spark)
    catalog.join(of, "file_location").write.parquet(to)
    files = spark.read.parquet(to)
    fields: dict[str, list[dict]] = {}
    for r in files.select("index", "fields").groupBy("index", F.to_json(F.array_sort(F.map_entries("fields")))).agg(F.first("fields").alias("fields")).collect():
        fields.setdefault(r["index"], []).append(r["fields"])
    alike: dict[tuple, list[str]] = {}
    for index, sets in fields.items():
        alike.setdefault(tuple(sorted({(n, t) for x in sets for n, t in x.items()})), []).append(index)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    for indexes in alike.values():
        some = files.where(F.coalesce("index", F.lit("")).isin([i or "" for i in indexes]))
        deal = some.select(plain(F.col("file_location")).alias("_file"), "_write", "_day")
        deal = F.broadcast(deal) if deal.count() <= store.FEW_FILES else deal
        rows = store.read_files(spark, some, name="_file")
        rows = rows.drop("bucket_start").withColumn("_file", plain(F.col("_file"))).join(deal, "_file").drop("_file").withColumnRenamed("_day", "bucket_start")
        with store.writing(spark):
            rows.repartition("_write", "_index").write.partitionBy("_write", "_index", "bucket_start").option("compression", "snappy").mode("append").parquet(path)
    new = store.list_files(spark, path).where(F.col("path").contains(f"/_write={name}-"))
    since = files.groupBy("_write", "index").agg(F.max(F.coalesce("since", "version")).alias("_since"), F.sum("record_count").alias("_rows"))
    made = store.build_catalog(spark, path, new).withColumn("_write", F.regexp_extract("file_location", "/_write=([^/]+)/", 1)).join(since, ["_write", "index"], "full")
    made.write.parquet(kept := store.fresh_dir(spark))
    made = spark.read.parquet(kept)
    lost = made.where("record_count is null or _rows is null or record_count <> _rows").count()
    if lost:
        raise ValueError(f"{lost} bins have other numbers of rows than their files")
    return made.withColumn("since", F.col("_since")).drop("_write", "_since", "_rows").select([f.name for f in T._parse_datatype_string(store.CATALOG).fields])


def commit(spark: SparkSession, path: str, base: Snapshot, bins: DataFrame, made: DataFrame) -> Snapshot:
    """Publish a rewrite as the next snapshot: rows of the bins' files are replaced by those of the new files at one point.
    base: the snapshot that the bins were made from. If another commit has replaced one of the files, it is a Conflict and
    the store stays as it is. The old files stay until store.set_aside."""
    table = store.catalog_of(spark, path)
    old = table.rows(base).join(bins.select(F.explode("paths").alias("file_location")), "file_location", "left_semi").select("file_location", "version")
    return table.commit(made, old, base)


def compact(spark: SparkSession, path: str, threshold: int, most_bytes: int, most_files: int, upto: int | None = None) -> Snapshot:
    """Rewrite the small files of each index and day of the newest snapshot into bins, and commit."""
    table = store.catalog_of(spark, path)
    at = table.snapshot()
    greedy_bins(candidates(table.rows(at), threshold, upto), most_bytes, most_files).write.parquet(to := store.fresh_dir(spark))
    bins = spark.read.parquet(to)
    if bins.isEmpty():
        return at
    return commit(spark, path, at, bins, rewrite(spark, table.rows(at), bins, path))


def merge_batches(spark: SparkSession, files: DataFrame, size: int, to: str) -> DataFrame:
    """Plain merge of single files (path, modificationTime), `size` at a time in the order of their times, each batch into one file
    of the dated folder `to`/day/batch; returns batch, files, rows. Files with different fields come to one schema. The old
    files are left to the caller, who may delete them when this has ended."""
    fixed_batches(files, size, "modificationTime", "path").withColumn("day", F.date_format("modificationTime", "yyyyMMdd")).write.parquet(kept := store.fresh_dir(spark))
    dealt = spark.read.parquet(kept)
    days = dealt.groupBy("batch").agg(F.min("day").alias("day"))
    dealt = dealt.drop("day").join(days, "batch").select(F.regexp_replace("path", "^file:/+", "/").alias("_file"), "batch", "day")
    rows = store.read_files(spark, store.build_catalog(spark, "", files.select("path", "length", "modificationTime")), name="_file")
    rows = rows.withColumn("_file", F.regexp_replace("_file", "^file:/+", "/")).join(dealt, "_file").drop("_file")
    with store.writing(spark):
        rows.repartition("day", "batch").write.partitionBy("day", "batch").option("compression", "snappy").mode("append").parquet(to)
    done = store.read_footers(spark, to).select(F.regexp_extract("file_location", "/batch=([0-9]+)/", 1).cast("long").alias("batch"), F.col("record_count").alias("rows"))
    return dealt.groupBy("batch").agg(F.count("*").alias("files")).join(done.groupBy("batch").agg(F.sum("rows").alias("rows")), "batch", "left")


def expired(buckets: DataFrame, end: Column, last: Column, now: Column, after: str, idle: str) -> DataFrame:
    """Buckets to close: over for longer than `after`, and without an event for longer than `idle`."""
    return buckets.where((end < now - F.expr(f"interval {after}")) & (last < now - F.expr(f"interval {idle}")))


def packed_name(low: Column, high: Column, now: Column) -> Column:
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    return F.concat(stamp(low), F.lit("-"), stamp(high), F.lit("_packed_"), stamp(now))


def parse_name(name: Column) -> tuple[Column, Column]:
    part = lambda i: F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{14})-(\d{14})_", i), F.lit("")), F.lit("yyyyMMddHHmmss"))
    return part(1), part(2)
