"""Packet tables (ts, link_type, data): header fields, protocol mix, TCP flags, payload removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number(data: Column, at, n: int) -> Column:
    """Unsigned big-endian integer at a byte offset from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast("bigint")


def headers(packets: DataFrame) -> DataFrame:
    """Adds src, dst, proto, src_port, dst_port, flags; frames that aren't IP are dropped."""
    link = F.when(F.col("link_type") == 1, 14).when(F.col("link_type") == 113, 16)
    d = packets.withColumn("ip", link).withColumn("kind", number(F.col("data"), F.col("ip") - 2, 2)).where("kind in (2048, 34525)")
    four = F.col("kind") == 2048
    head = F.when(four, (number(F.col("data"), F.col("ip"), 1) % 16) * 4).otherwise(40)
    d = d.withColumn("proto", F.when(four, number(F.col("data"), F.col("ip") + 9, 1)).otherwise(number(F.col("data"), F.col("ip") + 6, 1))).withColumn("l4", (F.col("ip") + head).cast("int"))
    dotted = lambda at: F.concat_ws(".", *[number(F.col("data"), F.col("ip") + at + i, 1).cast("string") for i in range(4)])
    colons = lambda at: F.concat_ws(":", *[F.lower(F.hex(F.substring(F.col("data"), F.col("ip") + at + 1 + 2 * i, F.lit(2)))) for i in range(8)])
    ported = F.col("proto").isin(6, 17)
    return d.withColumns({
        "src": F.when(four, dotted(12)).otherwise(colons(8)), "dst": F.when(four, dotted(16)).otherwise(colons(24)),
        "src_port": F.when(ported, number(F.col("data"), F.col("l4"), 2)), "dst_port": F.when(ported, number(F.col("data"), F.col("l4") + 2, 2)),
        "flags": F.when(F.col("proto") == 6, number(F.col("data"), F.col("l4") + 13, 1)),
    })


# Names of the flag bits, the lowest first.
FLAGS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG"]


def flag_names(flags: Column) -> Column:
    names = F.array_join(F.array_compact(F.array(*[F.when(flags.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(FLAGS)])), "|")
    return F.when(names == "", "None").otherwise(names)


def protocol_mix(parsed: DataFrame) -> DataFrame:
    name = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").when(F.col("proto") == 58, "ICMP").otherwise("other")
    counts = parsed.groupBy(name.alias("protocol")).agg(F.count("*").alias("packets"))
    return counts.withColumn("share", F.round(100 * F.col("packets") / F.sum("packets").over(W.partitionBy()), 2))


def without_payload(parsed: DataFrame) -> DataFrame:
    size = F.when(F.col("proto") == 6, (number(F.col("data"), F.col("l4") + 12, 1) / 16).cast("int") * 4).when(F.col("proto") == 17, 8).otherwise(8)
    return parsed.withColumn("data", F.substring("data", F.lit(1), (F.col("l4") + size).cast("int")))


def blank_arp(packets: DataFrame) -> DataFrame:
    arp = number(F.col("data"), 12, 2) == 0x0806
    zero = F.unhex(F.lit("00000000"))
    return packets.withColumn("data", F.when(arp, F.overlay(F.overlay("data", zero, 29), zero, 39)).otherwise(F.col("data")))
