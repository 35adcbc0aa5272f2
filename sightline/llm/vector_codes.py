"""Vector code compression: each of a vector's parts becomes the index of its nearest entry in that part's codebook, and
exact ball k-means on integers fits the codebooks.

The parts assigned to an entry are its ball. Half the way to the nearest other entry bounds a stable core, whose parts
can't change. Other entries are neighbours of a ball if half the way to them is below the ball's radius; sorted by
distance, they cut the ball into rings, and a part in a ring is compared with the neighbours within its reach only. A
ball is skipped when neither its entry nor a neighbour has moved. All comparisons are of squared distances as integers,
so ties go to the lower index exactly. A round is one narrow pass over a table of vectors and codes: tasks write the new
codes and the changes of their sums, which Spark adds up; only sums and radii, as many as entries, come to the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, new_folder, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond are cut here, so that sums stay within 64 bits in a task and 38 digits over all.
CLAMP = 1 << 40
#: Up to here, squared distances fit 64 bits; beyond, they are Python integers.
NARROW = 1 << 24
#: Rows after which a task writes down its sums, and rows that are compared at once.
FLUSH, CHUNK = 1 << 20, 8192
#: Labels whose errors are broadcast; more come by a join.
BROADCAST_LABELS = 100_000
LONG = (1 << 63) - 1


@dataclass
class Balls:
    """Entries (part, entry, component) and for each ball its sorted neighbours."""

    book: np.ndarray
    near: np.ndarray  # (part, entry, rank): neighbours by distance
    reach: np.ndarray  # (part, entry, rank): their squared distances, LONG where there is none
    still: np.ndarray  # (part, entry): neither the entry nor a neighbour has moved

    @classmethod
    def of(cls, book: np.ndarray, radius: list[list[int]] | None, moved: np.ndarray) -> Balls:
        """radius: squared radii of the balls round these entries, None where unknown."""
        parts, n, _ = book.shape
        wide = book.astype(object)
        near, reach = np.zeros((parts, n, max(n - 1, 0)), np.int64), np.full((parts, n, max(n - 1, 0)), LONG, object)
        still = np.zeros((parts, n), bool)
        for p in range(parts):
            for i in range(n):
                far = sorted((int(((wide[p, i] - wide[p, j]) ** 2).sum()), j) for j in range(n) if j != i)
                inside = [x for x in far if radius is None or x[0] <= 4 * radius[p][i]]
                for k, (d, j) in enumerate(inside):
                    near[p, i, k], reach[p, i, k] = j, min(d, LONG - 1)
                still[p, i] = radius is not None and not moved[p, i] and not any(moved[p, j] for _, j in inside)
        return cls(book, near, reach, still)


def assign(x: np.ndarray, own: np.ndarray | None, balls: Balls, part: int, distances: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row of a part; own: the entries before. Without `distances`, those of
    skipped balls are -1. Rows of wide components are object arrays."""
    book, kind = balls.book[part].astype(x.dtype), object if x.dtype == object else np.int64
    far = lambda rows, entry: ((x[rows] - book[entry]) ** 2).sum(1) if x.shape[1] else np.zeros(len(rows), kind)
    every = np.arange(len(x))
    if own is None:
        best, code = far(every, np.zeros(len(x), np.int64)), np.zeros(len(x), np.int64)
        for j in range(1, len(book)):
            d = far(every, np.full(len(x), j))
            less = np.asarray(d < best, bool)
            best[less], code[less] = d[less], j
        return code, best
    code, best = own.copy(), np.full(len(x), -1, kind)
    skipped = balls.still[part, own]
    live = every if distances else np.flatnonzero(~skipped)
    best[live] = far(live, own[live])
    live = live[~skipped[live]]
    reach, first = balls.reach[part].astype(kind), best.copy()
    for rank in range(reach.shape[1]):
        # rings shrink from the core outwards: a part goes on while its distance reaches half the way to the next neighbour
        live = live[np.asarray(reach[own[live], rank] <= 4 * first[live], bool) & (balls.reach[part][own[live], rank] < LONG)]
        if not len(live):
            break
        j = balls.near[part, own[live], rank]
        d = far(live, j)
        less = np.asarray((d < best[live]) | ((d == best[live]) & (j < code[live])), bool)
        best[live[less]], code[live[less]] = d[less], j[less]
    return code, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _codes(x: np.ndarray, old: np.ndarray | None, balls: Balls, distances: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (row, part)."""
    parts, size = balls.book.shape[0], balls.book.shape[2]
    wide = bool(len(x)) and max(int(np.abs(x).max(initial=0)), int(np.abs(balls.book).max(initial=0))) > NARROW or size > 500
    x = x.astype(object) if wide else x
    code, far = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), object if wide else np.int64)
    for p in range(parts):
        code[:, p], far[:, p] = assign(x[:, p * size : (p + 1) * size], None if old is None else old[:, p].astype(np.int64), balls, p, distances)
    return code, far


def _round(balls: Balls, width: int, label: pa.DataType, first: bool):
    """vec_id, label, v, (code) -> the same rows with new codes; rows with `s` hold part, entry, change of count, radius, changes of sums."""
    form = pa.schema([("vec_id", pa.int64()), ("label", label), ("v", pa.list_(pa.int64())), ("code", pa.binary()), ("s", pa.list_(pa.int64()))])
    parts, n, size = balls.book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cleared():
            return np.zeros((parts, n), np.int64), np.full((parts, n), -1, object), np.zeros((parts, n, size), np.int64), 0

        def sums():
            s = [[p, i, int(count[p, i]), min(int(radius[p, i]), LONG), *total[p, i].tolist()] for p in range(parts) for i in range(n)]
            none = [None] * len(s)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([none, none, none, none, s], form, strict=True)], schema=form)

        count, radius, total, rows = cleared()
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                x = _matrix(b.column("v"), width)
                old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                code, far = _codes(x, old, balls, False)
                for p in range(parts):
                    piece = x[:, p * size : (p + 1) * size]
                    changed = np.arange(len(x)) if first else np.flatnonzero(code[:, p] != old[:, p])
                    np.add.at(count[p], code[changed, p], 1)
                    np.add.at(total[p], code[changed, p], piece[changed])
                    if not first:
                        np.add.at(count[p], old[changed, p], -1)
                        np.add.at(total[p], old[changed, p], -piece[changed])
                    for i in np.unique(code[:, p]).tolist():
                        radius[p, i] = max(radius[p, i], far[code[:, p] == i, p].max())
                packed = pa.array([r.tobytes() for r in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), packed, pa.nulls(len(x), form.field("s").type)], schema=form)
                rows += len(x)
                if rows >= FLUSH:
                    yield sums()
                    count, radius, total, rows = cleared()
        yield sums()

    return run


def _final(balls: Balls, width: int, label: pa.DataType, first: bool):
    form = pa.schema([("vec_id", pa.int64()), ("label", label), ("code", pa.binary()), ("error", pa.int64())])
    parts = balls.book.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                code, far = _codes(_matrix(b.column("v"), width), old, balls, True)
                error = [min(int(e), LONG) for e in far.sum(1)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error, pa.int64())], schema=form)

    return run


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """vec_id, label, v of the kept rows, and the common length. Where lengths differ or don't divide, zeros follow."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(fine)
    least, most = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    width = -(-(most or 0) // parts) * parts
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(CLAMP))), F.lit(-float(CLAMP)))).cast("long")
    v = F.transform("embedding", whole)
    v = v if least == width else F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("embedding")))
    return kept.select("vec_id", "label", v.alias("v")), width


def first_book(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the smallest ids' vectors; of rows with one id the smallest vector."""
    ids = [r[0] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 1, width // parts), np.int64)  # no vector has an id: one entry of zeros
    some = rows.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    return np.array([r["v"] for r in some], np.int64).reshape(len(some), parts, -1).transpose(1, 0, 2)


def moved_book(book: np.ndarray, count: dict, total: dict) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floor of their parts' mean, and which have moved; unused ones stay."""
    out = book.copy()
    for (p, i), n in count.items():
        if n:
            out[p, i] = [t // n for t in total[p, i]]
    return out, (out != book).any(2)


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding, label) -> vec_id, label, code (an index a part), error (squared distances over parts);
    and the codebooks (part, entry, component).

    Rows whose vector is null or holds null or non-finite components are left out; no rows left give no rows. Empty
    vectors have code 0 and error 0. Equal rows get equal codes; an id that comes twice is one entry at the start, rows
    without id are encoded but never start an entry. Beyond CLAMP, components are cut; an error beyond 64 bits is the largest."""
    spark = vectors.sparkSession
    rows, width = integer_vectors(vectors, parts, scale)
    label = rows.schema["label"].dataType
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label)])
    arrow = pa.null() if isinstance(label, T.NullType) else _arrow(spark, label)
    book = first_book(rows, width, parts, entries)
    balls, first, folder = Balls.of(book, None, np.ones(book.shape[:2], bool)), True, None
    count: dict = {}
    total: dict = {}
    radius: dict = {}
    form = T.StructType([*kind, T.StructField("v", T.ArrayType(T.LongType())), T.StructField("code", T.BinaryType()), T.StructField("s", T.ArrayType(T.LongType()))])
    for _ in range(rounds):
        old, folder = folder, new_folder(spark)
        state = written(rows.mapInArrow(_round(balls, width, arrow, first), form), folder)
        if old:
            discard(spark, old)
        changes = state.where("s is not null").select(F.col("s")[0].alias("p"), F.col("s")[1].alias("i"), F.posexplode("s").alias("k", "x")).where("k > 1")
        got = changes.groupBy("p", "i", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("sum"), F.max("x").alias("max")).collect()
        seen = {}
        for r in got:
            at = (r["p"], r["i"])
            if r["k"] == 2:
                count[at] = count.get(at, 0) + int(r["sum"])
            elif r["k"] == 3:
                seen[at] = int(r["max"])
            else:
                total.setdefault(at, [0] * (width // parts))[r["k"] - 4] += int(r["sum"])
        rows, first = state.where("s is null").drop("s"), False
        new, moved = moved_book(book, count, total) if width else (book, np.zeros(book.shape[:2], bool))
        # round an entry that moved, the ball reaches as far as before and the entry's way
        held = {(p, i): max(seen.get((p, i), -1), radius.get((p, i), -1) if balls.still[p, i] else -1, 0) for p in range(parts) for i in range(book.shape[1])}
        for (p, i), r in held.items():
            way = int(((new[p, i].astype(object) - book[p, i].astype(object)) ** 2).sum()) if moved[p, i] else 0
            radius[p, i] = (isqrt(r) + isqrt(way) + 2) ** 2 if way else r
            if r >= LONG:
                radius[p, i] = 1 << 200
        book = new
        balls = Balls.of(book, [[radius[p, i] for i in range(book.shape[1])] for p in range(parts)], moved)
        if not moved.any():
            break
    out = written(rows.mapInArrow(_final(balls, width, arrow, first), T.StructType([*kind, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])))
    if folder:
        discard(spark, folder)
    return out, book


def _arrow(spark: SparkSession, kind: T.DataType) -> pa.DataType:
    return spark.createDataFrame([], T.StructType([T.StructField("x", kind)])).toArrow().schema.field("x").type


def code_text(code: str):
    return F.lower(F.hex(code))


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels, nulls together."""
    sums = written(codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "_label")
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
