"""Embedding near-dedup by an inverted multi-index.

Each half of the unit vectors has its own codebook; a vector lies in the cell (i, j) of the product grid. A vector
visits the cells of its label in the order of its squared distance to them (multi-sequence order), up to the distance
at which a target share of partners just at the threshold is reached, and is compared exactly with what lies there.

Equal vectors are one class. Cells and their visitors come in blocks, and a task compares two blocks by one matrix
product: it returns counts of links and the edges of spanning trees, never the pairs. A pair that lies in different
cells may be met from both sides; it counts there where the visitor is, and for the visited one only if that doesn't
visit back, which its own vector tells. So counts are exact for the pairs met and no connection between them is lost."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, table, written
from .components import components

#: The codebooks and the visiting distance are fitted on so many vectors for each centre, and at least so many, those
#: whose hash is smallest. The number of centres grows with the root of the vectors, so that a cell holds about OCCUPIED.
TRAIN_CENTRE, TRAIN_ROWS, TARGET, ROUNDS = 32, 4000, 0.998, 10
OCCUPIED, BLOCK = 128, 256
#: Blocks of a cell that one task compares with as many others.
SIDE = 32


def centres(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def margins(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centre's cell, seen from its own cell."""
    d = distances(x, c)
    own = d.argmin(1)
    gap = np.sqrt(distances(c, c))[own]
    return np.where(gap > 1e-9, (d - d.min(1, keepdims=True)) / (2 * np.maximum(gap, 1e-9)), 0) ** 2


class Grid:
    def __init__(self, sample: np.ndarray, k: int, cosine: float):
        self.cut = sample.shape[1] // 2
        self.books = [centres(half, k) for half in self.halves(sample)]
        rng = np.random.default_rng(9)
        x = sample[rng.integers(0, len(sample), 2000)]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine**2) * noise
        i, j = self.cells(y)
        a, b = (margins(h, c) for h, c in zip(self.halves(x), self.books, strict=True))
        at = np.arange(len(x))
        self.reach = float(np.quantile(a[at, i] + b[at, j], TARGET)) + 1e-9

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = (distances(h, c).argmin(1) for h, c in zip(self.halves(x), self.books, strict=True))
        return i, j

    def near_cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(margins(h, c) for h, c in zip(self.halves(x), self.books, strict=True))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within reach: for each near part of the first half, the near ones of the second."""
        a, b = self.near_cells(x)
        row, i = np.nonzero(a <= self.reach)
        of, j = np.nonzero(b <= self.reach)
        n = np.bincount(of, minlength=len(x))
        first = np.cumsum(n) - n
        other = ragged(first[row], n[row])
        row, i, j = np.repeat(row, n[row]), np.repeat(i, n[row]), j[other]
        ok = a[row, i] + b[row, j] <= self.reach
        return row[ok], i[ok] * len(self.books[1]) + j[ok]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), float).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Vectors compare when labels are equal and not null and lengths are equal. Null or zero vectors and those with null
    or non-finite components link with nothing. A repeated vec_id counts as another vector with the same name; a null
    vec_id links with nothing. An empty table gives no rows."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
    fine = F.coalesce(fine & ~bad & F.exists("x", lambda c: c != 0), F.lit(False))
    key = lambda seed: F.when(fine, F.xxhash64(F.lit(seed), "label", "x"))  # noqa: E731  two make 128 bits
    named = v.select("vec_id", "label", "x", key(1).alias("k1"), key(2).alias("k2"))
    cls = named.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("x").alias("x"))
    cls = written(cls.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("x")))
    found = [links(cls.where(F.col("dim") == r["dim"]), r["dim"], r["n"], cosine) for r in cls.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()]
    met = written(reduce(DataFrame.unionByName, found)) if found else v.sparkSession.createDataFrame([], "a long, b long, n long")
    others = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    comp = components(met.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    ids = cls.select("id", "k1", "k2", "rep", "copies").join(comp, "id", "left").join(others, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = written(ids)
    first = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = ids.join(first, "component").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = named.select("vec_id", "k1", "k2").join(done, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def spanning(linked: np.ndarray, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links of two blocks join: every node with the first one of its group."""
    far = len(q) + len(p)
    a, b = np.arange(len(q)), np.arange(len(q), far)
    while True:
        down = np.minimum(b, np.where(linked, a[:, None], far).min(0, initial=far))
        up = np.minimum(a, np.where(linked, down[None, :], far).min(1, initial=far))
        if (down == b).all() and (up == a).all():
            break
        a, b = up, down
    node, top = np.concatenate([q, p]), np.concatenate([q, p])[np.concatenate([a, b])]
    differ = node != top
    return node[differ], top[differ]


def links(cls: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """cls (id, label, x, copies), vectors of one length, n at most of a label -> rows (a, null, n): n links of a more,
    and (a, b, null): an edge."""
    spark = cls.sparkSession
    k = max(2, int((n / OCCUPIED) ** 0.5))
    sample = cls.orderBy(F.xxhash64("id"), "id").limit(max(TRAIN_ROWS, TRAIN_CENTRE * k)).select("x").toArrow()
    grid = spark.sparkContext.broadcast(Grid(unit(matrix(sample.column("x"), dim)), k, cosine))
    form = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("home", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("x", pa.binary())])

    def place(batches):
        """A row for each cell that a vector visits, its home among them."""
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                x = unit(matrix(part.column("x"), dim))
                one, two = grid.value.cells(x)
                home = one * len(grid.value.books[1]) + two
                row, cell = grid.value.visits(x)
                away = cell != home[row]
                row, cell = np.concatenate([np.arange(len(x)), row[away]]), np.concatenate([home, cell[away]])
                at = pa.array(row)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(row), [None, pa.py_buffer(np.ascontiguousarray(x[row]))])
                yield pa.RecordBatch.from_arrays([part.column("label").take(at), pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()), part.column("id").take(at), part.column("copies").take(at), packed.cast(pa.binary())], schema=form)

    placed = written(cls.select("label", "id", "copies", "x").mapInArrow(place, "label string, cell int, home int, id long, copies long, x binary"))
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("own")).where("own > 0")
    sizes = written(sizes.select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).withColumn("sides", F.ceil(F.col("blocks") / SIDE).cast("int")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    visitors = placed.join(F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes, ["label", "cell"]).withColumn("block", block)
    blocks = lambda df, *c: df.groupBy("label", "cell", "block", "sides").agg(F.collect_list(F.struct(*c)).alias("v"))  # noqa: E731  BLOCK or a little more each
    # a dense cell is a square of tasks: a block goes to all tasks of its row or column
    own, every = F.pmod(F.col("block"), F.col("sides")), F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    held = blocks(visitors.where("home = cell"), "id", "copies", "x").select("label", "cell", F.col("v").alias("p"), own.alias("across"), every.alias("down"))
    asks = blocks(visitors, "id", "copies", "home", "x").select("label", "cell", F.col("v").alias("q"), own.alias("down"), every.alias("across"))
    to = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def side(column: pa.ListArray, i: int):
        v = column.slice(i, 1).flatten()
        get = lambda c: v.field(c).to_numpy(zero_copy_only=False)
        return get("id"), get("copies"), np.frombuffer(b"".join(v.field("x").to_pylist()), float).reshape(-1, dim), v

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                (p, p_copies, x, _), (q, q_copies, y, v) = side(b.column("p"), i), side(b.column("q"), i)
                home, cell = v.field("home").to_numpy(zero_copy_only=False), b.column("cell")[i].as_py()
                linked = (y @ x.T >= cosine) & (q[:, None] != p[None, :])
                if not linked.any():
                    continue
                count = linked @ p_copies
                away = linked & (home != cell)[:, None]
                extra = np.zeros(len(p), np.int64)
                if away.any():
                    one, two = grid.value.near_cells(x)
                    width = len(grid.value.books[1])
                    back = one[:, home // width].T + two[:, home % width].T <= grid.value.reach
                    extra = (away & ~back).T @ q_copies
                left, right = spanning(linked, q, p)
                ids, n = np.concatenate([q[count > 0], p[extra > 0]]), np.concatenate([count[count > 0], extra[extra > 0]])
                none = lambda m: pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, left])), pa.concat_arrays([none(len(ids)), pa.array(right)]), pa.concat_arrays([pa.array(n), none(len(left))])], schema=to)

    return asks.join(held, ["label", "cell", "down", "across"]).select("cell", "p", "q").mapInArrow(compare, "a long, b long, n long")
