"""Live streams: subscriptions, routing, replay, streaming ingest and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..sources import store
from ..sources.snapshots import Conflict, Snapshot, Snapshots

SUBSCRIPTION = "stream_id string, indexes array<string>, filters map<string,array<string>>"
SUBSCRIPTION_FIELDS = ["stream_id", "indexes", "filters"]
#: Subscriptions whose lists are broadcast, at most.
FEW = 100_000


def define(subscriptions: DataFrame) -> DataFrame:
    """One row for equal indexes and filters: the smallest stream_id."""
    return canonical(subscriptions).groupBy("key").agg(F.min_by(F.struct(*SUBSCRIPTION_FIELDS), "stream_id").alias("s")).select("s.*")


def row_map(df: DataFrame, fields: set[str]) -> Column:
    """The row's fields that subscriptions name, as text."""
    own = [c for c in df.columns if c in fields]
    return F.map_from_arrays(F.array(*[F.lit(c) for c in own]).cast("array<string>"), F.array(*[F.col(f"`{c}`").cast("string") for c in own]).cast("array<string>"))


def filter_fields(subscriptions: DataFrame) -> set[str]:
    """Names that filters use: at most the distinct columns that users filter by."""
    return {r[0] for r in subscriptions.select(F.explode(F.map_keys("filters"))).distinct().collect()}


def subscription_table(spark: SparkSession, folder: str) -> Snapshots:
    """Subscriptions as a table whose commits running streams follow."""
    return Snapshots(spark, folder, SUBSCRIPTION, ["stream_id"])


def canonical(subscriptions: DataFrame) -> DataFrame:
    """Adds `key`, equal for equal indexes and filters in any order."""
    entries = F.array_sort(F.transform(F.map_entries("filters"), lambda e: F.struct(e["key"].alias("k"), F.array_sort(F.array_distinct(e["value"])).alias("v"))))
    return subscriptions.withColumn("key", F.to_json(F.struct(F.array_sort(F.array_distinct("indexes")).alias("i"), entries.alias("f"))))


def subscribe(table: Snapshots, wanted: DataFrame, tries: int = 5) -> DataFrame:
    """Add subscriptions, those that are there already excepted. Returns stream_id and `existing`: the stream that each one has, its own or an equal one's."""
    names = SUBSCRIPTION_FIELDS
    for _ in range(tries):
        at = table.snapshot()
        have = canonical(table.rows(at)).groupBy("key").agg(F.min("stream_id").alias("existing"))
        one = canonical(wanted.select(names)).groupBy("key").agg(F.min_by(F.struct(*names), "stream_id").alias("s"))
        new = one.join(have, "key", "left_anti").select("s.*")

        def unchanged(now: Snapshot, seen: int = at.number) -> None:
            if now.number != seen:
                raise Conflict("subscriptions have changed")

        try:
            table.commit(new, check=unchanged)
        except Conflict:
            continue
        now = canonical(table.rows()).groupBy("key").agg(F.min("stream_id").alias("existing"))
        return canonical(wanted.select(names)).join(now, "key").select("stream_id", "existing")
    raise Conflict(f"{tries} others came first")


def unsubscribe(table: Snapshots, streams: DataFrame) -> Snapshot:
    """Remove streams (stream_id)."""
    at = table.snapshot()
    return table.commit(removed=table.rows(at).join(streams.select("stream_id"), "stream_id", "left_semi").select("stream_id", "version"), base=at)


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """stream_id and the rows of a batch or stream that each subscription wants; unknown fields pass. Subscriptions come to an
    event by an equal join on its index, which brings all that name it, and those over all indexes, as one list."""
    all_of_them = "\0"
    s = subscriptions.select(F.explode(F.when(F.size("indexes") == 0, F.array(F.lit(all_of_them))).otherwise(F.array_distinct("indexes"))).alias("_index"), F.struct("stream_id", "filters").alias("s"))
    lists = s.groupBy("_index").agg(F.collect_list("s").alias("_subs"))
    everywhere = lists.where(F.col("_index") == all_of_them).agg(F.flatten(F.collect_list("_subs")).alias("_all")).select(F.lit(1).alias("_one"), "_all")  # one row, with which every event is compared
    few = subscriptions.count() <= FEW
    deal = lambda t: F.broadcast(t) if few else t
    fits = lambda x: F.forall(F.map_entries(x["filters"]), lambda e: ~F.map_contains_key(F.col("_map"), e["key"]) | F.array_contains(e["value"], F.element_at(F.col("_map"), e["key"])))
    e = events.withColumns({"_map": row_map(events, filter_fields(subscriptions)), "_one": F.lit(1)})
    joined = e.join(deal(lists), "_index", "left").join(F.broadcast(everywhere), "_one")
    wanted = F.filter(F.concat(F.coalesce("_subs", F.array().cast("array<struct<stream_id:string,filters:map<string,array<string>>>>")), F.col("_all")), fits)
    return joined.select(F.explode(F.transform(wanted, lambda x: x["stream_id"])).alias("stream_id"), *[F.col(f"`{c}`") for c in events.columns])


def route_live(stream: DataFrame, table: Snapshots, to: str, checkpoint: str) -> None:
    """Route what has come in since the last call, each micro-batch by the subscriptions that there are at its time. A batch that
    runs again writes the same place."""

    def put(batch: DataFrame, number: int) -> None:
        route(batch, table.rows().select(SUBSCRIPTION_FIELDS)).write.mode("overwrite").parquet(f"{to}/batch={number}")

    drained(stream, checkpoint, put)


def drained(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    """Give `put` each micro-batch of what is there; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str, stamp: str = "yyyyMMddHH", name: str | None = None) -> None:
    """Bring a stream of events (_index, _time, fields) into the store: each micro-batch is one commit, which also notes the
    batch's number under the stream's name. A batch that runs again after its commit adds nothing; one that failed before
    it leaves files that no snapshot names."""
    drained(stream, checkpoint, lambda batch, number: put_batch(batch, path, name or checkpoint, number, stamp))


def put_batch(batch: DataFrame, path: str, name: str, number: int, stamp: str = "yyyyMMddHH") -> bool:
    """Commit a micro-batch once; False where it was."""
    key = f"stream {name}"

    def first(at: Snapshot) -> None:
        if at.notes.get(key, -1) >= number:
            raise Conflict("this batch is in the store")

    try:
        first(store.catalog_of(batch.sparkSession, path).snapshot())
        store.append(batch, path, stamp, notes={key: number}, check=first)
    except Conflict:
        return False
    return True


def index_sets(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with `set`, the text of their distinct indexes: streams of one set are seen by the same users."""
    return subscriptions.select("stream_id", F.array_sort(F.array_distinct("indexes")).alias("i")).withColumn("set", F.to_json("i"))


def visible_sets(sets: DataFrame, access: DataFrame) -> DataFrame:
    """user_id, set of the index sets (set, i) that each user of access (user_id, index_name, can_read) may see whole; the empty one is for all."""
    readable = access.where("can_read").select("user_id", "index_name").distinct()
    named = sets.where("size(i) > 0").select("set", F.size("i").alias("need"), F.explode("i").alias("index_name"))
    got = named.join(readable, "index_name").groupBy("user_id", "set", "need").agg(F.count("*").alias("n")).where("n = need")
    return got.select("user_id", "set").unionByName(access.select("user_id", F.lit("[]").alias("set")).distinct())


def visible(subscriptions: DataFrame, access: DataFrame) -> DataFrame:
    """user_id, stream_id of the streams that each user of access may see: all of a stream's indexes are readable, or it is over all."""
    s = index_sets(subscriptions)
    return visible_sets(s.select("set", "i").distinct(), access).join(s.select("stream_id", "set"), "set").select("user_id", "stream_id")


def visible_counts(subscriptions: DataFrame, access: DataFrame) -> DataFrame:
    """user_id and how many streams each may see; streams are counted by set first, so no pair of user and stream is made."""
    s = index_sets(subscriptions).groupBy("set").agg(F.count("*").alias("n"), F.first("i").alias("i"))
    return visible_sets(s, access).join(s.select("set", "n"), "set").groupBy("user_id").agg(F.sum("n").alias("streams"))


def replay(events: DataFrame, offset: str, order: list[str]) -> DataFrame:
    """Existing rows of a stream: none for LAST, all but the first n for digits, else all. order: columns of a total order; the
    n-th row of it is found by range partitions and their counts."""
    if offset == "LAST" or not offset.isdigit() or int(offset) == 0:
        return events.limit(0) if offset == "LAST" else events
    return ranks.skipped(events, [F.col(c) for c in order], int(offset))


def replay_then_tail(spark: SparkSession, existing: DataFrame, folder: str, offset: str, order: list[str], path: str, checkpoint: str) -> None:
    """Write the replayed rows once, then whatever has come into the Parquet folder of new events."""
    replay(existing, offset, order).write.mode("append").parquet(path)
    run_available(parquet_stream(spark, existing, folder), path, checkpoint)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition: list[str] | None = None) -> None:
    """Drain what is there into Parquet; a later call goes on from the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    (writer.partitionBy(*partition) if partition else writer).start().awaitTermination()


def summary(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per index and window, closed by the watermark."""
    return stream.withWatermark("_time", late).groupBy("_index", F.window("_time", window)).agg(F.count("*").alias("n")).select("_index", F.col("window.start").alias("bucket_start"), "n")


def parquet_stream(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)
