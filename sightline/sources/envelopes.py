"""Event batches as rows: plain row batches, row envelopes and columnar envelopes, in batch or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.times import time_by_format

STRINGS = "map<string,string>"
# Explicit time formats that a header may name, besides the named ones.
FORMATS = ["YYYY-MM-DD hh:mm:ss", "YYYY-MM-DD", "YYYYMMDD", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y%m%d", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d/%b/%Y:%H:%M:%S"]
ROW_BATCH = "array<struct<index:string,events:array<string>>>"


def merged(first, second):
    """Map with the keys of both; the second wins."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def row_batches(df: DataFrame, column: str = "payload") -> DataFrame:
    """(payload JSON) -> _index, event JSON; records without index or events are skipped."""
    one = df.select(F.explode(F.from_json(column, ROW_BATCH)).alias("r")).where("r.index is not null and r.index <> '' and size(r.events) > 0")
    return one.select(F.lower("r.index").alias("_index"), F.explode("r.events").alias("event"))


def reported_count(df: DataFrame, column: str = "payload") -> DataFrame:
    """Events of all records, skipped ones included."""
    r = df.select(F.explode(F.from_json(column, ROW_BATCH)).alias("r"))
    return r.agg(F.coalesce(F.sum(F.greatest(F.size("r.events"), F.lit(0))), F.lit(0)).cast("long").alias("n_events"))


def row_envelopes(df: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """header map, events array of JSON -> _index, _time, fields map. Header keys win; events without time are dropped."""
    e = df.where("header is not null and events is not null").select("header", F.explode("events").alias("raw"))
    e = e.withColumn("event", F.from_json("raw", STRINGS))
    field = F.coalesce(F.col("header")["timefield"], F.lit("_time"))
    e = e.withColumn("fields", merged(F.col("event"), F.col("header"))).withColumn("_time", time_by_format(F.element_at("event", field), F.col("header")["timeformat"], formats))
    return e.where(F.element_at("event", field).isNotNull()).select(F.lower(F.coalesce(F.col("header")["index"], F.lit("main"))).alias("_index"), "_time", "fields")


def column_envelopes(df: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """header map, columns, events (an array for each column) -> rows. Columns win over the header; the time comes
    from timefield, else _raw, else the batch is dropped. A time that can't be read is the last good one before it in the
    envelope, a leading one the time of ingestion."""
    n = F.size(F.col("events")[0])
    field, form = F.coalesce(F.col("header")["timefield"], F.lit("_time")), F.col("header")["timeformat"]
    column = lambda name: F.get("events", F.array_position("columns", name).cast("int") - 1)
    places = F.sequence(F.lit(0), n - 1)
    raw = times.bound(F.struct(column(field).alias("a"), column(F.lit("_raw")).alias("b")), lambda c: F.transform(places, lambda i: F.coalesce(F.get(c["a"], i), F.get(c["b"], i))))
    # the format is looked at once per envelope
    parsed = lambda x: times.by_format(lambda f: F.transform(x, lambda v: times.smart_time(v, f)), form, formats)
    timed = times.bound(raw, lambda x: F.when(F.exists(x, lambda v: v.isNotNull()), times.filled(parsed(x))))
    rows = F.transform(places, lambda i: F.map_from_arrays("columns", F.transform("events", lambda c: F.get(c, i))))
    e = df.where(F.col("header").isNotNull() & (F.size("events") > 0) & (n > 0)).select("header", timed.alias("t"), rows.alias("event")).where("t is not null")
    e = e.select("header", F.explode(F.arrays_zip("event", "t")).alias("z"))
    return e.select(F.lower(F.coalesce(F.col("header")["index"], F.lit("main"))).alias("_index"), F.coalesce("z.t", F.current_timestamp()).alias("_time"), merged(F.col("header"), F.col("z.event")).alias("fields"))


def landing_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files (gzip too) of a landing folder as they come."""
    return spark.readStream.schema(schema).json(path)
