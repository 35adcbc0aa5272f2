"""Detection rules as columns: one scan evaluates all rules of an index."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store
from ..sources.snapshots import Conflict, Snapshot

RULE = "id string, title string, level string, fields array<struct<field:string,op:string,values:array<string>>>"
SCHEDULE = "*/10 * * * *"


def load_rules(texts: DataFrame) -> DataFrame:
    """(value: YAML text, and path where known) -> rules; texts without id and texts that aren't YAML are skipped, of
    equal ids the last path wins (without paths the last text in order)."""

    def parse(batches):
        import pandas as pd
        import yaml

        for b in batches:
            rows = []
            for path, t in zip(b["path"], b["value"], strict=True):
                try:
                    rule = yaml.safe_load(t)
                except yaml.YAMLError:
                    continue
                if isinstance(rule, dict) and rule.get("id"):
                    picked = (rule.get("detection") or {}).get("selection") or {}
                    fields = [{"field": k.split("|")[0], "op": (k.split("|") + ["equals"])[1], "values": [str(x) for x in (v if isinstance(v, list) else [v])]} for k, v in picked.items()]
                    rows.append((path, str(rule["id"]), rule.get("title"), rule.get("level"), fields))
            yield pd.DataFrame(rows, columns=["path", "id", "title", "level", "fields"])

    path = F.col("path") if "path" in texts.columns else F.col("value")
    all_rules = texts.select(path.alias("path"), "value").mapInPandas(parse, f"path string, {RULE}")
    return all_rules.groupBy("id").agg(F.max_by(F.struct("title", "level", "fields"), "path").alias("r")).select("id", "r.*")


def bind(rules: DataFrame, indexes: DataFrame, schedule: str = SCHEDULE) -> DataFrame:
    """Rules (id) and (rule_id, index_id) pairs -> rule_index: rule_id, index_id, schedule, enabled; pairs of unknown rules
    are left out, a pair given twice is one."""
    known = rules.select(F.col("id").alias("rule_id"))
    return indexes.select("rule_id", F.lower("index_id").alias("index_id")).distinct().join(known, "rule_id", "left_semi").select("*", F.lit(schedule).alias("schedule"), F.lit(True).alias("enabled"))


def mappings(field_map: DataFrame) -> dict[str, dict[str, str]]:
    """field_map (rule_id, rule_field, index_field), a table made by hand, by rule."""
    out: dict[str, dict[str, str]] = {}
    for r in field_map.collect():
        out.setdefault(r["rule_id"], {})[r["rule_field"]] = r["index_field"]
    return out


def match_bound(df: DataFrame, rules: list, maps: dict[str, dict[str, str]], rule_index: DataFrame) -> DataFrame:
    """match, each rule on the indexes it is bound to, where the binding is enabled."""
    pairs = rule_index.where("enabled").select("rule_id", F.col("index_id").alias("_index"))
    return match(df, rules, maps).join(F.broadcast(pairs) if pairs.count() <= 100_000 else pairs, ["rule_id", "_index"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def predicate(df: DataFrame, fields: list, mapping: dict[str, str]) -> Column | None:
    """AND over mapped fields, OR over a field's values; unmapped ones are dropped; none mapped gives None."""
    kinds, parts = dict(df.dtypes), []
    for f in fields:
        name = mapping.get(f["field"])
        if name is None:
            continue
        c = F.col(f"`{name}`")
        text = c.cast("string")
        tests = {"contains": text.contains, "startswith": text.startswith, "endswith": text.endswith}
        test = tests.get(f["op"], lambda v, c=c, kind=kinds[name]: c == F.lit(v).try_cast(kind))
        parts.append(reduce(lambda a, b: a | b, [test(v) for v in f["values"]], F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def match(df: DataFrame, rules: list, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of df with rule_id, once for each rule that fits; a rule without mapped fields matches nothing."""
    found = [(r["id"], predicate(df, r["fields"], mappings.get(r["id"], {}))) for r in rules]
    hits = [F.when(p, F.lit(i)) for i, p in found if p is not None]
    ids = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return df.select("*", F.explode(ids).alias("rule_id"))


def executions(matches: DataFrame, shown: list[str], order: list, sample: int = 5) -> DataFrame:
    """rule_id, num_rows and the shown columns of the first rows as JSON lines. Counts are plain partial sums; only a
    partition's first rows of each rule are ranked."""
    body = F.to_json(F.struct(*shown))
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("num_rows"))
    first = matches.withColumn("_json", body).withColumn("_rank", F.row_number().over(W.partitionBy("rule_id").orderBy(*order))).where(F.col("_rank") <= sample)
    lines = first.groupBy("rule_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_json"))), lambda x: x["_json"]), "\n").alias("result_data"))
    return counts.join(lines, "rule_id")


def not_yet_run(due: DataFrame, log: DataFrame) -> DataFrame:
    return due.join(log, ["rule_id", "run_at"], "left_anti")


def described(rule: dict, mapping: dict[str, str]) -> str:
    """A rule's condition as text."""
    return " AND ".join(f"{mapping[f['field']]} {f['op']} {' | '.join(f['values'])}" for f in rule["fields"] if f["field"] in mapping)


def alerts(matches: DataFrame, rules: list, maps: dict[str, dict[str, str]]) -> DataFrame:
    """Alert events: _index, _time, rule_id, index_id, query, matched_fields, raw_event, message, alert_type."""
    body = [c for c in matches.columns if c != "rule_id"]
    text = {r["id"]: (described(r, maps.get(r["id"], {})), r["title"] or "", sorted({maps[r["id"]][f["field"]] for f in r["fields"] if f["field"] in maps.get(r["id"], {})})) for r in rules}
    pick = lambda f, kind: reduce(lambda out, i: F.when(F.col("rule_id") == i, f(text[i])).otherwise(out), text, F.lit(None).cast(kind))
    fields = pick(lambda x: F.map_from_arrays(F.array(*[F.lit(c) for c in x[2]]).cast("array<string>"), F.array(*[F.col(f"`{c}`").cast("string") for c in x[2]]).cast("array<string>")), "map<string,string>")
    return matches.select(
        F.concat(F.lit("alerts_rule_"), "rule_id").alias("_index"), "_time", "rule_id", F.col("_index").alias("index_id"), pick(lambda x: F.lit(x[0]), "string").alias("query"), fields.alias("matched_fields"),
        F.to_json(F.struct(*body)).alias("raw_event"), F.concat(F.lit("Rule matched: "), pick(lambda x: F.lit(x[1]), "string")).alias("message"), F.lit("rule").alias("alert_type"),
    )


def summaries(matches: DataFrame, rules: list, maps: dict[str, dict[str, str]], shown: list[str], order: list, sample: int = 5) -> DataFrame:
    """One alert per rule and index with matches: _index, _time (of the last match), rule_id, index_id, query, num_rows, sample (the first rows as JSON lines)."""
    both = matches.withColumn("rule_id", F.to_json(F.struct(F.col("rule_id").alias("r"), F.col("_index").alias("i"))))
    runs = executions(both, shown, order, sample).join(both.groupBy("rule_id").agg(F.max("_time").alias("_time")), "rule_id")
    runs = runs.select(F.from_json("rule_id", "r string, i string").alias("k"), "_time", "num_rows", "result_data")
    query = reduce(lambda out, r: F.when(F.col("k.r") == r["id"], F.lit(described(r, maps.get(r["id"], {})))).otherwise(out), rules, F.lit(None).cast("string"))
    return runs.select(F.concat(F.lit("alerts_rule_"), "k.r").alias("_index"), "_time", F.col("k.r").alias("rule_id"), F.col("k.i").alias("index_id"), query.alias("query"), "num_rows", F.col("result_data").alias("sample"))


def detect(spark: SparkSession, source: str, to: str, rules: list, maps: dict[str, dict[str, str]], rule_index: DataFrame) -> Snapshot:
    """Run each enabled rule on what has come into its indexes of the store `source` since its last run, and append its alerts to the
    store `to`. How far each pair of rule and index has come is noted in the commit of the alerts itself, so each event
    is looked at once per pair: a run that fails before its commit has happened not at all, of two at once one is a Conflict.
    Only files of later snapshots are opened; files that compaction made count as what they were made of, provided
    that it takes files that all rules have seen (compact's upto: see seen_upto)."""
    source_table, table = store.catalog_of(spark, source), store.catalog_of(spark, to)
    at, before = source_table.snapshot(), table.snapshot()
    marks = before.notes.get("marks", {})
    pairs = [(r["rule_id"], r["index_id"]) for r in rule_index.where("enabled").select("rule_id", "index_id").distinct().collect()]  # made by hand
    by_mark: dict[int, list[tuple[str, str]]] = {}
    for p in pairs:
        by_mark.setdefault(marks.get(json.dumps(p), 0), []).append(p)
    catalog, found = source_table.rows(at), None
    for mark, due in by_mark.items():
        new = store.prune(catalog.where(F.coalesce("since", "version") > mark), [i for _, i in due])
        if mark >= at.number or new.isEmpty():
            continue
        rows = match_bound(store.read_files(spark, new), rules, maps, rule_index.join(spark.createDataFrame(due, "rule_id string, index_id string"), ["rule_id", "index_id"], "left_semi"))
        one = alerts(rows, rules, maps)
        found = one if found is None else found.unionByName(one)
    notes = {"marks": marks | {json.dumps(p): max(at.number, marks.get(json.dumps(p), 0)) for p in pairs}}

    def alone(now: Snapshot) -> None:
        if now.notes.get("marks", {}) != marks:
            raise Conflict("another run came first")

    if found is None:
        return table.commit(notes=notes, check=alone)
    return store.append(found, to, stamp="yyyyMMdd", notes=notes, check=alone)


def seen_upto(spark: SparkSession, to: str) -> int:
    """The snapshot that all rules whose alerts go to a store have seen, so that files up to it may be put together."""
    return min(store.catalog_of(spark, to).snapshot().notes.get("marks", {}).values(), default=0)
