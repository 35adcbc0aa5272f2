"""Time parsing, relative ranges and batch time columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Format tokens, longest first, and the pattern letters they stand for.
TOKENS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("hh", "HH"), ("mm", "mm"), ("ss", "ss")]
STRPTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "z": "XX", "j": "DDD", "a": "EEE", "A": "EEEE", "%": "%"}
NAMED = {"unix", "epoch", "unix_ms", "unixms", "iso8601", "iso", "rfc3339", "timestamp"}


def pattern_of(timeformat: str) -> str:
    """Spark pattern of a strptime or YYYY-MM-DD style format."""
    if timeformat.lower() in NAMED:
        return timeformat
    out, i = "", 0
    if "%" in timeformat:
        while i < len(timeformat):
            if timeformat[i] == "%" and i + 1 < len(timeformat):
                out, i = out + STRPTIME.get(timeformat[i + 1], ""), i + 2
            else:
                out, i = out + (f"'{timeformat[i]}'" if timeformat[i].isalpha() else timeformat[i]), i + 1
        return out
    while i < len(timeformat):
        token = next((t for t in TOKENS if timeformat.startswith(t[0], i)), None)
        out += token[1] if token else (f"'{timeformat[i]}'" if timeformat[i].isalpha() else timeformat[i])
        i += len(token[0]) if token else 1
    return out


def seconds_time(number: Column) -> Column:
    """Timestamp of epoch seconds; null for what isn't finite or lies outside the years 1 to 9999."""
    fine = (number >= -62135596800.0) & (number < 253402300800.0)  # false for NaN, which is greater than all
    return F.when(fine, F.timestamp_micros(F.round(F.when(fine, number).otherwise(0.0) * 1e6).cast("bigint")))


def smart_time(value: Column, timeformat: str | None = None) -> Column:
    """Timestamp of text: epoch seconds for numbers, milliseconds for unix_ms, ISO 8601, or the given format; else null. Values
    of a numeric type are numbers (20220101 is epoch seconds), texts of eight digits are dates; a text without a date is
    null. No value raises: NaN, infinite and out-of-range numbers give null."""
    kind = (timeformat or "").lower()
    numeric = F.typeof(value).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    if kind in ("unix_ms", "unixms"):
        return seconds_time(number / 1000)
    if kind in ("unix", "epoch"):
        return seconds_time(number)
    iso = F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^[+-]?\d{4,6}-\d{1,2}"), text)), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")), F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))), seconds_time(number))
    if not kind or kind in NAMED:
        return F.when(numeric, seconds_time(value.try_cast("double"))).otherwise(iso)
    return F.try_to_timestamp(text, F.lit(pattern_of(timeformat)))


def time_by_format(value: Column, timeformat: Column, formats: list[str]) -> Column:
    """smart_time by a format that stands in the row: a named one or one of `formats`; another gives null, none ISO 8601."""
    return by_format(lambda f: smart_time(value, f), timeformat, formats)


def by_format(parse: Callable[[str | None], Column], timeformat: Column, formats: list[str]) -> Column:
    """What `parse` makes with the format that stands in the row."""
    kind = F.lower(F.coalesce(timeformat, F.lit("")))
    out = F.when(kind.isin("unix_ms", "unixms"), parse("unix_ms")).when(kind.isin("unix", "epoch"), parse("unix"))
    out = out.when((kind == "") | kind.isin(*NAMED), parse(None))
    for f in formats:
        out = out.when(timeformat == f, parse(f))
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(times: Column) -> Column:
    """An array of times in which a null is the last good one before it; leading ones stay null. One pass: runs of equal times are as
    long as the way from one good position to the next."""

    def runs(t: Column, good: Column) -> Column:
        lead = F.array_repeat(F.lit(None).cast("timestamp"), F.coalesce(F.get(good, 0), F.size(t)))
        run = F.transform(good, lambda at, k: F.array_repeat(F.get(t, at), F.coalesce(F.get(good, k + 1), F.size(t)) - at))
        return F.concat(lead, F.flatten(run))

    good = lambda t: F.when(F.size(t) > 0, F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).isNotNull())).otherwise(F.array().cast("array<int>"))
    return bound(times, lambda t: bound(good(t), lambda g: runs(t, g)))


def filled_times(df: DataFrame, time: str, batch: str, position: str, ingest: Column) -> DataFrame:
    """Null times take the last good one before them in the batch, leading ones the ingestion time."""
    w = W.partitionBy(batch).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(time, F.coalesce(F.last(time, ignorenulls=True).over(w), ingest))


def batch_times(df: DataFrame, batch: str, time: str, position: str) -> DataFrame:
    return df.groupBy(batch).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.min_by(time, position).alias("first_time"), F.max_by(time, position).alias("last_time"))


def range_start(now: Column, name: str) -> Column:
    """Start of a relative range such as 6h, 7d, 3m (months), 1y or ytd that ends now."""
    if name == "ytd":
        return F.date_trunc("YEAR", now)
    n, unit = int(name[:-1]), name[-1]
    return now - F.make_interval(**{{"h": "hours", "d": "days", "m": "months", "y": "years"}[unit]: F.lit(n)})
