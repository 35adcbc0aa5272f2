"""URL filters in DataFrame functions alone: host and path rules first, then a character language-model ratio.

Accepted and rejected URLs (those that a rule decides) train a variable-order Markov model each, with Witten-Bell
smoothing from the longest context seen down to single characters. The score is the difference of log-likelihoods per
character; the cut is calibrated on rule-decided URLs of a fold left out of the counts. The score is a sum over the
longest grams, so grams are scored once and joined to the URLs' grams."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, written

ORDER = 5  # characters of context
ALPHABET = 128.0
#: Share of accepted calibration URLs that the cut may reject; so many are needed, else the cut is 0.
LOSS, LEAST = 0.01, 20
# Host and path prefix, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
START = "\u0002"
#: Tables of short grams up to so many rows are broadcast; grams in more than one of HOT places are looked up apart.
BROADCAST_ROWS, HOT = 1_000_000, 1000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(len, rule, verdict), or null. Rules are a short list in the plan."""
    hits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def kth_smallest(df: DataFrame, column: str, k: int) -> float:
    """The k-th smallest value, from 1, of a column of values rounded to nine digits: counts of ever narrower ranges, some thousand at
    a time, lead to it."""
    rows = df.select(F.col(column).alias("v"), F.round(F.col(column) * 10**9).cast("long").alias("key"))
    for width in (10**7, 10**4, 1):
        low = F.col("key") - F.pmod("key", F.lit(width))
        for r in rows.groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.min("v").alias("v")).orderBy("low").collect():
            if k <= r["n"]:
                break
            k -= r["n"]
        rows = rows.where(low == r["low"])
    return r["v"]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER, loss: float = LOSS) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, score.

    A null url has empty host and path and no characters; a url without characters scores 0 and is allowed unless the
    cut is above 0. Repeated rows are judged alike. Without accepted or rejected URLs the scores are 0. An empty table
    gives no rows."""
    width = order + 1
    d = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    d = d.withColumns({"host": host, "path": path}).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    body = F.substring(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", ""), 1, 1 << 30)
    d = d.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), body.alias("body"), fold("page_id", 5).alias("fold"))
    urls = d.withColumn("padded", F.concat(F.lit(START * order), "body"))
    size = F.char_length("body")
    grams = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("padded"), i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
    urls = urls.withColumn("grams", grams)

    side = F.when((F.col("ruled") == "allow") & (F.coalesce("fold", F.lit(1)) != 0), "a").when((F.col("ruled") == "block") & (F.coalesce("fold", F.lit(1)) != 0), "b")
    taught = urls.select(side.alias("side"), F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "b", 1).otherwise(0)).alias("b"), F.count("*").alias("n"))
    full = written(taught)

    scored = full.select("gram").withColumns({"pa": F.lit(1 / ALPHABET), "pb": F.lit(1 / ALPHABET)})
    for n in range(1, width + 1):
        part = full.groupBy(F.substring("gram", width - n + 1, n).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
        base = part.groupBy(context.alias("c")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), seen("a").alias("ta"), seen("b").alias("tb"))
        step = part.withColumn("c", context).join(base, "c")
        if n <= 3:  # few grams, each the end of very many longer ones
            step = written(step)
            step = F.broadcast(step) if step.count() <= BROADCAST_ROWS else step
        scored = scored.withColumn("g", F.substring("gram", width - n + 1, n)).join(step, "g")
        mixed = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}"))  # noqa: E731,B023
        scored = scored.select("gram", mixed("a").alias("pa"), mixed("b").alias("pb"))
    model = written(scored.select("gram", (F.log("pa") - F.log("pb")).alias("ratio")))
    places = full.agg(F.sum("n")).first()[0] or 0
    hot = written(full.where(F.col("n") * HOT > places).select("gram").join(model, "gram"))  # fewer than HOT rows

    distinct = urls.select("body", "grams").dropDuplicates(["body"]).select("body", F.explode("grams").alias("gram"))
    seldom = distinct.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(model, "gram")
    ratios = distinct.join(F.broadcast(hot), "gram").unionByName(seldom).select("body", "ratio")
    sums = ratios.groupBy(F.col("body").alias("of")).agg(F.avg("ratio").alias("score"))
    judged = written(d.join(sums, d["body"] == sums["of"], "left").select("page_id", "host", "path", "rule", "ruled", "fold", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score")))
    held = judged.where("fold = 0 and ruled = 'allow'")
    n = held.count()
    cut = min(kth_smallest(held, "score", math.ceil(Fraction(str(loss)) * n)), 0.0) if n >= LEAST else 0.0
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
