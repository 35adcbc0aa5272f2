"""The bucket store: partitioned Parquet by index and time bucket, its catalog as snapshots, quarantine and scans."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema
from .snapshots import Snapshot, Snapshots, local_name

CATALOG = "file_location string, index string, bucket_start string, start_time timestamp, end_time timestamp, record_count long, row_groups int, size long, length long, modified timestamp, fields map<string,string>, since long"
FOOTERS = f"{CATALOG}, ok boolean, fault string, reason string"
HIDDEN = r"/_broken/|/_catalog/|\.tmp$|\.old$|/_SUCCESS$|\.crc$"
META = ("_indexes", "_schema")
#: Events in a file at most.
MOST_EVENTS = 100_000
#: Files whose names are broadcast, at most.
FEW_FILES = 200_000
#: Type of a field that only Spark's reader may know.
UNKNOWN = "unknown"
#: Tries and seconds between them when a file can't be read for now.
TRIES, PAUSE = 3, 0.2


def fresh_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder. Without one, a temporary folder, on a single machine only."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="/tmp/spark-") + "/store"


def as_events(events: DataFrame) -> DataFrame:
    """Events with an event_type and a time ts as indexed events: _index, _time and the fields."""
    return events.withColumns({"_index": F.concat(F.lit("evt_"), F.lower("event_type")), "_time": F.col("ts").cast("timestamp")})


# ---- writing


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Write times as microseconds, whose bounds footers hold; and many small buckets by many tasks: hashing keeps a bucket in one
    task anyhow, so putting small tasks together would save no file."""
    wanted = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def catalog_of(spark: SparkSession, path: str) -> Snapshots:
    """The store's snapshots: rows of CATALOG, each with the version that added it. since: the version whose events a rewritten file holds."""
    return Snapshots(spark, f"{path.rstrip('/')}/_catalog", CATALOG, ["file_location"])


def write_files(df: DataFrame, path: str, name: str | None = None, stamp: str | None = "yyyyMMddHH", most: int = MOST_EVENTS) -> str:
    """Write events (_index, _time, fields) below a folder of this write, one folder per index (in lower case; `main` for
    none) and bucket, files of `most` events at most; returns the folder. No reader sees it before a commit. Large buckets are
    dealt to many tasks by the planner (rebalance), small ones to one. stamp: pattern of bucket_start; None: it is there."""
    name = name or uuid.uuid4().hex
    d = df.withColumns({"_write": F.lit(name), "_index": F.lower(F.coalesce("_index", F.lit("main")))})
    d = d.withColumn("bucket_start", F.date_format("_time", stamp)) if stamp else d
    with writing(df.sparkSession):
        d.hint("rebalance", F.col("_index"), F.col("bucket_start")).write.partitionBy("_write", "_index", "bucket_start").option("maxRecordsPerFile", most).mode("append").parquet(path)
    return f"{path.rstrip('/')}/_write={name}"


def append(df: DataFrame, path: str, stamp: str = "yyyyMMddHH", most: int = MOST_EVENTS, notes: dict | None = None, check: Callable[[Snapshot], None] | None = None) -> Snapshot:
    """Write events and commit their files as the store's next snapshot."""
    spark = df.sparkSession
    folder = write_files(df, path, stamp=stamp, most=most)
    there = exists(spark, folder)  # no events, no folder
    return catalog_of(spark, path).commit(build_catalog(spark, folder) if there else None, notes=notes, check=check)


def write_buckets(df: DataFrame, path: str, stamp: str = "yyyyMMddHH", most: int = MOST_EVENTS) -> str:
    """append; returns the store's path."""
    append(df, path, stamp, most)
    return path


# ---- catalog


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of the store's files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").where(~F.col("path").rlike(HIDDEN))


def _opened(path: str):
    """Filesystem and path of a file's name as Spark gives it."""
    from pyarrow import fs

    there = local_name(path)
    return (fs.LocalFileSystem(), there) if there else fs.FileSystem.from_uri(path)


class Damaged(Exception):
    """The content of a file isn't what its format asks for."""


def fault_of(error: Exception) -> str:
    """format, absent, denied or transient."""
    if isinstance(error, Damaged):
        return "format"
    if isinstance(error, FileNotFoundError):
        return "absent"
    return "denied" if isinstance(error, PermissionError) else "transient"


def tail_of(fs, path: str) -> bytes:
    """A Parquet file's footer with its marks. Reading and parsing stay apart: what fails here is the file system's fault, but for Damaged."""
    with fs.open_input_file(path) as f:
        size = f.size()
        if size < 12:
            raise Damaged(f"{size} bytes")
        end = f.read_at(8, size - 8)
        n = int.from_bytes(end[:4], "little")
        if end[4:] != b"PAR1" or n + 12 > size:
            raise Damaged("no Parquet mark at the end")
        return b"PAR1" + f.read_at(n, size - 8 - n) + end


def _times(fs, path: str, m) -> tuple:
    """Bounds of _time from the footer; where it has none, as with 96-bit times, from that column alone."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    at = m.schema.names.index("_time")
    groups = [m.row_group(i) for i in range(m.num_row_groups)]
    stats = [g.column(at).statistics for g in groups if g.num_rows and g.column(at).physical_type != "INT96"]
    if stats and len(stats) == sum(g.num_rows > 0 for g in groups) and all(s is not None and s.has_min_max for s in stats):
        return min(s.min for s in stats), max(s.max for s in stats)
    try:
        bounds = pc.min_max(pq.read_table(path, columns=["_time"], filesystem=fs, partitioning=None)["_time"]).as_py()
    except pa.ArrowInvalid as e:
        raise Damaged(str(e)) from e
    return bounds["min"], bounds["max"]


def _footer(name: str) -> tuple:
    """start, end, record_count, row_groups, size, fields (name to Spark's type) of a file."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    fs, path = _opened(name)
    tail = tail_of(fs, path)
    try:
        m = pq.read_metadata(pa.BufferReader(tail))
        own = m.schema.to_arrow_schema()
        wide = {m.schema.column(i).name for i in range(len(m.schema)) if m.schema.column(i).physical_type == "INT96"}
    except Exception as e:  # the bytes are here, so it is their fault
        raise Damaged(str(e)) from e
    fields = {}
    for f in own:
        try:
            fields[f.name] = "timestamp" if f.name in wide else from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString()
        except Exception:  # noqa: BLE001  a type that only Spark's reader may know
            fields[f.name] = UNKNOWN
    low, high = _times(fs, path, m) if "_time" in fields and m.num_rows and "timestamp" in fields["_time"] else (None, None)
    utc = lambda t: None if t is None else pd.Timestamp(t).tz_localize("UTC") if pd.Timestamp(t).tzinfo is None else pd.Timestamp(t).tz_convert("UTC")
    return utc(low), utc(high), m.num_rows, m.num_row_groups, sum(m.row_group(i).total_byte_size for i in range(m.num_row_groups)), fields


def tried(name: str, read: Callable[[str], tuple] = _footer) -> tuple[tuple, str | None, str | None]:
    """What `read` gives, or nothing with the kind of fault and its reason. A fault of the moment is tried again, then raised: the task fails and is repeated."""
    for k in range(TRIES):
        try:
            return read(name), None, None
        except Exception as e:
            if (kind := fault_of(e)) != "transient":
                return (None,) * 6, kind, str(e)
            if k == TRIES - 1:
                raise
            time.sleep(PAUSE * 2**k)
    raise AssertionError


def read_footers(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Catalog rows from file footers, which tasks read from the files' ends, of all files below path or of those listed (path,
    length, modificationTime). Files with a fault have ok = false, no counts, and its kind: `format` for damage, `denied`; files
    that are gone by now are left out."""
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", FOOTERS)]
        plain = lambda x: None if x in ("", "__HIVE_DEFAULT_PARTITION__") else unquote(x)
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got, kind, why = tried(r.path)
                if kind != "absent":
                    rows.append((r.path, plain(r.index), plain(r.bucket_start), *got[:5], r.length, r.modified, got[5], None, kind is None, kind, why))
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_time", "end_time", "modified"):
                out[c] = pd.to_datetime(out[c], utc=True)
            yield out.astype({"record_count": "Int64", "row_groups": "Int32", "size": "Int64", "length": "Int64", "since": "Int64"})

    listed = list_files(spark, path) if files is None else files
    return listed.select("path", part("_index").alias("index"), part("bucket_start").alias("bucket_start"), "length", F.col("modificationTime").alias("modified")).mapInPandas(probe, FOOTERS)


def build_catalog(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Good files with their index, record count, size, fields and time range."""
    return read_footers(spark, path, files).where("ok").drop("ok", "fault", "reason")


def saved_catalog(spark: SparkSession, path: str) -> DataFrame:
    """build_catalog of a folder without snapshots, kept as a table so that it is read once."""
    to = fresh_dir(spark)
    build_catalog(spark, path).withColumn("version", F.lit(0).cast("bigint")).write.parquet(to)
    return spark.read.parquet(to)


def refresh(spark: SparkSession, path: str) -> Snapshot:
    """Bring the catalog up to the files that others have put into the store, changed or removed: the listing is compared with
    the newest snapshot first, and only new and changed files are opened. Files of a write are its own commit's business."""
    table = catalog_of(spark, path)
    at = table.snapshot()
    have = table.rows(at)
    listed = list_files(spark, path).withColumns({"file_location": F.col("path"), "modified": F.col("modificationTime")})
    same = ["file_location", "length", "modified"]
    new = listed.join(have.select(same), same, "left_anti").where(~F.col("path").rlike("/_write=[^/]+/"))
    gone = have.join(listed.select(same), same, "left_anti").select("file_location", "version")
    return table.commit(build_catalog(spark, path, new.select("path", "length", "modificationTime")), gone, at)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def moved(rows: DataFrame, to: Callable[[str], str]) -> DataFrame:
    """Move files (file_location) to the names that `to` makes of theirs, within tasks; adds moved_to. One that runs again finds its file moved."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = []
            for name in b["file_location"]:
                (fs, p), target = _opened(name), _opened(to(name))[1]
                fs.create_dir(target.rpartition("/")[0])
                if fs.get_file_info(p).is_file:
                    k, free = 0, target
                    while fs.get_file_info(free).is_file:  # an earlier file of this name
                        k += 1
                        free = f"{target}.{k}"
                    fs.move(p, free)
                    target = free
                names.append(target)
            yield b.assign(moved_to=names)

    form = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(move, f"{form}, moved_to string")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Move damaged files below the store's folder `_broken`, where they keep their folders, and take them out of the catalog.
    Returns file_location, index, bucket_start, reason, moved_to, also kept as a table (see quarantined). Files that can't be
    read for other causes stay."""
    base = path.rstrip("/")
    root = local_name(base) or base

    def target(name: str) -> str:
        own = local_name(name) or name
        return f"{root}/_broken/{own[len(root) :].lstrip('/')}"

    to = f"{base}/_broken/_log/{uuid.uuid4().hex}"
    read_footers(spark, path).where("fault = 'format'").select("file_location", "index", "bucket_start", "reason").write.parquet(found := fresh_dir(spark))
    moved(spark.read.parquet(found), target).write.parquet(to)  # from a table, so that a task that runs again still knows its files
    out, table = spark.read.parquet(to), catalog_of(spark, path)
    at = table.snapshot()
    if at.number:
        gone = table.rows(at).join(out, "file_location", "left_semi").select("file_location", "version")
        if not gone.isEmpty():
            table.commit(removed=gone, base=at)
    return out


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """All that quarantine has moved: file_location, index, bucket_start, reason, moved_to."""
    return spark.read.parquet(f"{path.rstrip('/')}/_broken/_log/*")


def set_aside(spark: SparkSession, path: str, age: str = "1 day") -> DataFrame:
    """Rename files of writes that no newest snapshot names and that are older than `age` to .old. Readers don't need it: they
    follow snapshots. The age leaves alone writes that are still to be committed and readers of earlier snapshots."""
    known = catalog_of(spark, path).rows().select(F.col("file_location").alias("path"))
    old = list_files(spark, path).where(F.col("path").rlike("/_write=[^/]+/") & (F.col("modificationTime") <= F.current_timestamp() - F.expr(f"interval {age}")))
    to = fresh_dir(spark)
    moved(old.join(known, "path", "left_anti").select(F.col("path").alias("file_location")), lambda name: f"{name}.old").write.parquet(to)
    return spark.read.parquet(to)


def prune(catalog: DataFrame, indexes: list[str] | None = None, low=None, high=None) -> DataFrame:
    """Catalog rows of files with events whose time range meets the (closed) range; open ends match all."""
    rows = catalog.where(F.col("record_count") > 0)
    rows = rows if indexes is None else rows.where(F.lower("index").isin([i.lower() for i in indexes]))
    time = lambda t: None if t is None else F.lit(t).cast("timestamp")
    return rows.where(overlaps(F.col("start_time"), F.col("end_time"), time(low), time(high)))


def read_files(spark: SparkSession, catalog: DataFrame, name: str | None = None) -> DataFrame:
    """All rows of a (pruned) catalog's files, whose fields may differ in names and types. Files whose fields agree, or which
    lack some, are read together with one schema, which the catalog has; only conflicting types need a frame of their own. Then all
    come to one schema. Names of indexes and buckets are text. name: a column for the file. An empty catalog is an error."""
    shape = F.to_json(F.array_sort(F.map_entries("fields")))
    base = F.regexp_extract("file_location", "^(.*?)/(?:_write=[^/]+/)?_index=", 1)
    files = catalog.select("fields", F.struct(F.xxhash64(shape).alias("shape"), base.alias("base"), F.col("file_location").rlike("/_write=[^/]+/_index=").alias("own")).alias("kind"), "file_location")
    kinds = files.groupBy("kind").agg(F.first("fields").alias("fields")).collect()
    if not kinds:
        raise ValueError("no files")
    group, types = {}, {}
    for place in sorted({(k["kind"]["base"], k["kind"]["own"]) for k in kinds}):
        here = [k for k in kinds if (k["kind"]["base"], k["kind"]["own"]) == place]
        for g, (merged, members) in enumerate(schema.agreeing([k["fields"] for k in here])):
            types[place, g] = merged
            group |= {here[i]["kind"]: (place, g) for i in members}
    names: dict = {g: [] for g in types}
    for r in files.select("kind", "file_location").toLocalIterator(prefetchPartitions=True):
        names[group[r["kind"]]].append(r["file_location"])
    frames = []
    for (place, g), merged in types.items():
        parts = (["_write"] * place[1] + ["_index", "bucket_start"]) * bool(place[0])  # single files stand in no folders of a store
        reader = spark.read.option("basePath", place[0]) if place[0] else spark.read
        if UNKNOWN not in merged.values():
            quoted = lambda n: "`" + n.replace("`", "``") + "`"
            reader = reader.schema(", ".join([*(f"{quoted(n)} {t}" for n, t in merged.items() if n not in parts), *(f"{p} string" for p in parts)]))
        frame = reader.parquet(*names[place, g])
        frame = frame.withColumn(name, F.col("_metadata.file_path")) if name else frame
        frames.append(frame.drop("_write").withColumns({c: F.col(c).cast("string") for c in parts if c != "_write"}))
    return frames[0] if len(frames) == 1 else schema.reconcile(frames)


def scan(spark: SparkSession, path: str, glob: str | None = None, index: str | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Rows of the store or of one index; a glob names files (.parquet is added). No match is an error."""
    rows = catalog if catalog is not None else Store(spark, path).catalog
    rows = rows if index is None else rows.where(F.lower("index") == index.lower())
    if glob:
        pattern = re.escape(glob if glob.endswith(".parquet") else f"{glob}.parquet").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        rows = rows.where(F.col("file_location").rlike(f"/{pattern}$"))
    return read_files(spark, rows)


class Store:
    """A store's path with its catalog: that of the newest snapshot, or of a number; of a folder without snapshots its files' footers."""

    def __init__(self, spark: SparkSession, path: str, catalog: DataFrame | None = None, number: int | None = None):
        self.spark, self.path = spark, path
        if catalog is None:
            table = catalog_of(spark, path)
            self.snapshot = table.snapshot(number)
            catalog = table.rows(self.snapshot) if self.snapshot.number else saved_catalog(spark, path)
        self.catalog = catalog

    def indexes(self, low=None, high=None) -> list[str]:
        """Names of the indexes with events in the range."""
        return sorted(r[0] for r in prune(self.catalog, None, low, high).select("index").distinct().collect())

    def rows(self, indexes: list[str] | None = None, low=None, high=None, strict: bool = False) -> DataFrame:
        """Rows of the files that meet the range; strict keeps rows within it only."""
        out = read_files(self.spark, prune(self.catalog, indexes, low, high))
        if strict:
            bounds = [F.col("_time") >= F.lit(low).cast("timestamp")] * (low is not None) + [F.col("_time") <= F.lit(high).cast("timestamp")] * (high is not None)
            for x in bounds:
                out = out.where(x)
        return out

    def meta(self, name: str, indexes: list[str] | None = None) -> DataFrame:
        rows = self.catalog if indexes is None else self.catalog.where(F.lower("index").isin([i.lower() for i in indexes]))
        return indexes_table(rows) if name == "_indexes" else schema_table(rows)


def indexes_table(catalog: DataFrame) -> DataFrame:
    """index, buckets, record_count, size, start_time, end_time of each index; partial summaries by bucket first."""
    part = catalog.groupBy("index", "bucket_start").agg(F.sum("record_count").alias("n"), F.sum("size").alias("size"), F.min("start_time").alias("lo"), F.max("end_time").alias("hi"))
    return merged_indexes(part.groupBy("index").agg(F.count("*").alias("buckets"), F.sum("n").alias("record_count"), F.sum("size").alias("size"), F.min("lo").alias("start_time"), F.max("hi").alias("end_time")))


def merged_indexes(parts: DataFrame) -> DataFrame:
    """One row per index of summaries made apart."""
    return parts.groupBy("index").agg(*[F.sum(c).alias(c) for c in ("buckets", "record_count", "size")], F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def schema_table(catalog: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A row per file: _bucket_id, _start, _end, _location, __index, _size, _count, and the type of each field."""
    long = catalog.select(F.col("bucket_start").alias("_bucket_id"), F.col("start_time").alias("_start"), F.col("end_time").alias("_end"), F.col("file_location").alias("_location"), F.col("index").alias("__index"), F.col("size").alias("_size"), F.col("record_count").alias("_count"), F.explode("fields").alias("field", "type"))
    keys = ["_bucket_id", "_start", "_end", "_location", "__index", "_size", "_count"]
    return long.groupBy(*keys).pivot("field", fields).agg(F.first("type")) if fields else long.groupBy(*keys).pivot("field").agg(F.first("type"))


def record_total(catalog: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """record_count over the catalog, or over a list of files (file_location)."""
    rows = catalog if files is None else catalog.join(files.select("file_location").distinct(), "file_location", "left_semi")
    return rows.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"))


def file_table(footers: DataFrame) -> DataFrame:
    """A row per file: file_location, index, record_count, mb on disk, raw_mb (both to 2 decimals), fault."""
    mb = lambda c: F.round(F.col(c) / 1e6, 2)
    return footers.select("file_location", "index", "record_count", mb("length").alias("mb"), mb("size").alias("raw_mb"), "fault")


def file_stats(footers: DataFrame, names: int = 100) -> DataFrame:
    """Files, rows, megabytes on disk and raw ones by index with a total row (null), the number of broken files, and the first `names` of them."""
    mb = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 1e6, 2)
    stats = footers.rollup("index").agg(F.count("*").alias("files"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), mb("length").alias("mb"), mb("size").alias("raw_mb"), F.count(F.when(~F.col("ok"), 1)).alias("broken"))
    bad = footers.where("not ok").orderBy("file_location").limit(names).groupBy().agg(F.sort_array(F.collect_list("file_location")).alias("broken_files"))
    return stats.join(F.broadcast(bad))


def overlaps(start: Column, end: Column, low: Column | None, high: Column | None) -> Column:
    """Closed overlap of a bucket with a range; open ends match all."""
    out = F.lit(True)
    if high is not None:
        out = out & (start <= high)
    return out & (end >= low) if low is not None else out


def in_range(time: Column, start: Column, end: Column) -> Column:
    return (time >= start) & (time <= end)


def in_window(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (low <= end) & (high > start)


def buckets_of(events: DataFrame, catalog: DataFrame, step: str = "DAY") -> DataFrame:
    """events with file_location of each bucket of their index that spans their time: an equal join on index and day (or
    step), to which each bucket is dealt, before the range is looked at."""
    every = F.sequence(F.date_trunc(step, "start_time"), F.date_trunc(step, "end_time"), F.expr(f"interval 1 {step.lower()}"))
    b = catalog.select(F.col("index").alias("_index"), "file_location", "start_time", "end_time", F.explode(every).alias("_step"))
    e = events.withColumn("_step", F.date_trunc(step, "_time"))
    return e.join(b, ["_index", "_step"]).where(in_range(F.col("_time"), F.col("start_time"), F.col("end_time"))).drop("_step", "start_time", "end_time")
