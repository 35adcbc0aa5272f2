"""Schema reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unified_schema(schemas: list[T.StructType]) -> T.StructType:
    """Fields by name in order; a field with conflicting types becomes a string; null types give way."""
    kinds: dict[str, set] = {}
    for s in schemas:
        for f in s.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    out = []
    for name in sorted(kinds):
        real = [k for k in kinds[name] if not isinstance(k, T.NullType)]
        zoned = {type(k) for k in real} == {T.TimestampType, T.TimestampNTZType}
        out.append(T.StructField(name, T.TimestampType() if zoned else real[0] if len(real) == 1 else T.StringType()))
    return T.StructType(out)


def agreeing(fields: list[dict[str, str]]) -> list[tuple[dict[str, str], list[int]]]:
    """Sets of fields (name to type) put together where no field has two types: merged fields and the positions of the sets. Only
    fields that conflict somewhere can part sets; a set goes to the first that it agrees with."""
    kinds: dict[str, set[str]] = {}
    for x in fields:
        for name, kind in x.items():
            kinds.setdefault(name, set()).add(kind)
    disputed = {name for name, k in kinds.items() if len(k) > 1}
    out: list[tuple[dict[str, str], list[int]]] = []
    for i, x in enumerate(fields):
        own = {n: x[n] for n in disputed & x.keys()}
        fits = next((o for o in out if all(o[0].get(n, t) == t for n, t in own.items())), None)
        if fits is None:
            out.append(({}, []))
            fits = out[-1]
        fits[0].update(x)
        fits[1].append(i)
    return [(dict(sorted(m.items())), members) for m, members in out]


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {f.name for f in df.schema.fields}
    return df.select([(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def reconcile(frames: list[DataFrame]) -> DataFrame:
    """Conflict-tolerant union by name."""
    schema = unified_schema([f.schema for f in frames])
    return reduce(DataFrame.unionByName, [cast_to(f, schema) for f in frames])


def promote_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def align_to_first(frames: list[DataFrame]) -> DataFrame:
    first = frames[0].schema
    for f in frames[1:]:
        if set(f.columns) != set(first.names):
            raise ValueError(f"columns differ: {sorted(set(f.columns) ^ set(first.names))}")
    return reduce(DataFrame.union, [f.select([F.col(f"`{x.name}`").cast(x.dataType) for x in first.fields]) for f in frames])


def field_list(catalog: DataFrame) -> DataFrame:
    """(field, type) rows of a catalog's files, as their footers have them."""
    return catalog.select(F.explode("fields").alias("field", "type")).distinct()


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, field, type) of fields that only one of two (field, type) lists has."""
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def without_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Frame without the columns that are null in every row, and their names; one pass."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    gone = [c for c in df.columns if n[c] == 0]
    return df.drop(*gone), gone
