"""N-gram Jaccard join by a pigeonhole over partitions of the shingle universe.

Sets fall into size bands, so that linked sets lie in one band or in neighbouring ones. For a band, at most H
elements can differ between linked sets. The universe is hashed into segments and each set's part of a segment
becomes a signature. Two allocations keep every link:

* exact: H + 1 + E segments. At most H of them differ, so at least E + 1 agree; a set that has at most E parts of
  fewer than two elements leaves those out, as one of the larger parts must agree.
* one deletion: (H + 1) / 2 segments; one of them differs by one element at most, so a part and the part without any
  one of its elements are signatures.

The cheaper one is chosen for each band from the number of sets in it. Candidates are verified exactly on texts.

Disk: the sets' ids travel with their signatures, sorted and packed in some four bytes for each, so that a bucket finds
the sets of a signature by itself, whatever their number. Sketches and texts go to cells and pairs in turns, each of a
bounded number for a set, and the files of a turn go before the next.

Large groups: the sets of a signature make a cell, or cells of blocks that share one set where they are many; equal
cells are one. A task compares the parity sketches of a cell's sets: only pairs whose sketches differ in no more bits
than linked sets can differ in elements may link. At first each set leaves a cell with its first such partner only;
these pairs are verified and components formed. Then, of the cells that had a pair and are of several components, all such pairs of different
components leave, of different blocks too. While they are many, a few for each set are verified and pairs within a component dropped; what is left is
verified whole. So a linked group never makes all of its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, lower_ascii, mix, new_folder, ragged, swept, table, text_slices, word_hashes, word_spans, written
from .components import components

BROADCAST_ROWS = 2_000_000
#: Bytes of signatures in a bucket, signatures that are packed together, and bits of a packed one beyond those of their number.
BUCKET_BYTES, PACKED, SPARE_BITS = 16 << 20, 2_000_000, 9
#: In a turn: places in cells and pairs for each set, or as many as here if that is more.
CELLS_A_SET, LINKS_A_SET, LEAST_ROWS = 16, 0.25, 1 << 20
#: Sets in a block of a large signature, and pairs that a task compares at a time.
BLOCK, PAIRS_AT_ONCE = 2048, 1 << 16
#: Rounds of a few pairs for each set at most, and candidates for each set at which all are verified.
ROUNDS, PAIRS_A_SET = 7, 1.5
#: Bits of a set's parity sketch, as powers of two: above twice its size, between these.
LEAST_LEVEL, TOP_LEVEL = 6, 13
SHARE = 0.02  # assumed chance that two elements of unlike sets are the same
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, row of each element, element: the distinct k-word shingles, sorted within a row."""
    for first, end, data, offsets in text_slices(column):
        data = lower_ascii(data)
        starts, ends, row = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        n = np.bincount(row, minlength=end - first)
        at = np.cumsum(n) - n
        rows, values = [], []
        if len(h) >= k:
            s = reduce(lambda x, j: x + h[j : len(h) - k + 1 + j] * _ODD[j], range(1, k), h[: len(h) - k + 1] * _ODD[0])
            whole = row[: len(row) - k + 1] == row[k - 1 :]
            rows.append(row[: len(row) - k + 1][whole])
            values.append(mix(s[whole]))
        for r in np.flatnonzero((n > 0) & (n < k)):
            part = h[at[r] : at[r] + n[r]]
            rows.append(np.array([r]))
            values.append(mix(np.array([(part * _ODD[: len(part)]).sum() + _ODD[63 - len(part)]], np.uint64)))
        rows, values = (np.concatenate(rows), np.concatenate(values)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        yield first, end, rows[fresh], values[fresh]


class Bands:
    """Size bands of sets with Jaccard similarity num/den or more, and the allocation of each."""

    def __init__(self, num: int, den: int, counts: dict[int, int] | None = None, largest: int = 1 << 40):
        self.num, self.den, low = num, den, [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low)
        self.exact, self.segments, self.slack = [], [], []
        for k in range(len(low) - 1):
            top = low[k + 1] - 1
            differ = (den - num) * (top + top * den // num) // (den + num)
            size = max(1.0, (low[k] + top) / 2)
            slack = 0 if differ == 0 else max(1, math.ceil(0.3 * (differ + 1)))
            plans = [(True, differ + 1 + slack, slack), (False, (differ + 2) // 2, 0)]
            self.choose(plans[0] if differ == 0 else min(plans, key=lambda p: self.cost(p, size, (counts or {}).get(k, 0))))

    def made(self, k: int) -> float:
        """Signatures of a set in a band, under this band alone."""
        return self.segments[k] + (0 if self.exact[k] else float(self.low[k + 1]))

    @staticmethod
    def cost(plan: tuple[bool, int, int], size: float, sets: int) -> float:
        """Signatures that a band's sets make, and pairs of unlike sets that meet, of which each costs ten."""
        exact, m, _ = plan
        mean = size / m
        chance = [math.exp(-mean) * mean**j / math.factorial(j) for j in range(12)]
        if exact:
            made, meet = m, sum((chance[j] * SHARE ** (j / 2)) ** 2 for j in range(2, 12))
        else:
            made, meet = m + size, (chance[0] + chance[1]) ** 2 + sum((chance[j] * SHARE ** ((j - 1) / 2)) ** 2 for j in range(2, 12))
        return sets * made + 10 * sets * sets / 2 * m * meet

    def choose(self, plan: tuple[bool, int, int]) -> None:
        for to, x in zip((self.exact, self.segments, self.slack), plan, strict=True):
            to.append(x)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def signatures(self, row: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, signature) of sets given as sorted rows; each set under its own band and under the one below."""
        out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        exact, segments, slack = np.array(self.exact), np.array(self.segments), np.array(self.slack)
        own = self.of(np.maximum(n, 1))
        for down in (0, 1):
            band = own - down
            use = (n > 0) & (band >= 0)
            m = np.where(use, segments[np.maximum(band, 0)], 0)
            base = np.cumsum(m) - m
            keep = use[row]
            r, v = row[keep], value[keep]
            cell = base[r] + ((v >> np.uint64(32)) * m[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            mixed = mix(v + np.uint64(0x5851F42D4C957F2D))
            sums, count = np.zeros(int(m.sum()), np.uint64), np.bincount(cell, minlength=int(m.sum()))
            np.add.at(sums, cell, mixed)
            cell_row = np.repeat(np.arange(len(n)), m)
            name = mix((np.arange(len(sums)) - base[cell_row]).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + band[cell_row].astype(np.uint64))
            is_exact = exact[np.maximum(band, 0)]
            few = (count < 2) & is_exact[cell_row]
            must = np.bincount(cell_row, few, len(n)) > slack[np.maximum(band, 0)]
            emit = ~few | must[cell_row]
            out_row.append(cell_row[emit])
            out_sig.append(mix(sums[emit] + name[emit]))
            less = ~is_exact[r]
            out_row.append(r[less])
            out_sig.append(mix(sums[cell[less]] - mixed[less] + name[cell[less]]))
        return np.concatenate(out_row), np.concatenate(out_sig)


def _profile(k: int):
    """Size, keys and parity sketch of each text's set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for b in batches:
            ids = np.array(b.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            for first, end, row, value in shingle_sets(b.column("text"), k):
                n = np.bincount(row, minlength=end - first)
                a, c = np.zeros(end - first, np.uint64), np.zeros(end - first, np.uint64)
                np.add.at(a, row, mix(value + np.uint64(1)))
                np.add.at(c, row, mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                yield table({"doc_id": ids[first:end], "n_shingles": n, "key_a": a.view(np.int64), "key_b": c.view(np.int64), "sketch": sketches(row, value, n)}, schema)

    return run, "doc_id long, n_shingles long, key_a long, key_b long, sketch binary"


def to_bits(x: np.ndarray) -> tuple[int, bytes]:
    """Width and bits of numbers, each in as many bits as the largest needs."""
    width = int(x.max()).bit_length()
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return width, np.packbits(bits[:, :width], bitorder="little").tobytes()


def from_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def pack(sig: np.ndarray, ids: np.ndarray) -> bytes:
    """Signatures, which are in order, with the ids of their sets: a head, the signatures' steps and the ids' distances from the least."""
    least = ids.min()
    parts = [to_bits(np.diff(sig, prepend=sig[:1])), to_bits((ids - least).view(np.uint64))]
    head = [len(sig), parts[0][0], parts[1][0], int(sig[0]), int(least.view(np.uint64))]
    return np.array(head, "<u8").tobytes() + parts[0][1] + parts[1][1]


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *widths, first, least = np.frombuffer(raw, "<u8", 5).tolist()
    data = np.frombuffer(raw, np.uint8, offset=40)
    cut = (n * widths[0] + 7) // 8
    sig, ids = from_bits(data[:cut], n, widths[0]), from_bits(data[cut:], n, widths[1])
    return np.cumsum(sig, dtype=np.uint64) + np.uint64(first), (ids + np.uint64(least)).view(np.int64)


def _packed(k: int, bands: Bands, buckets: int, bits: int):
    """Signatures of many texts, their first bits, with the ids: one value for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary())])

    def packed(sig, ids):
        sig, ids = np.concatenate(sig), np.concatenate(ids)
        order = np.argsort(sig)
        sig, ids = sig[order], ids[order]
        to = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        sig >>= np.uint64(64 - bits)
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cut[1:], len(sig))
        return pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array([pack(sig[x:y], ids[x:y]) for x, y in zip(cut, ends, strict=True)], pa.binary())], schema=schema)

    def run(batches):
        sigs, owners, held = [], [], 0
        for b in batches:
            ids = np.array(b.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            for first, end, row, value in shingle_sets(b.column("text"), k):
                at, sig = bands.signatures(row, value, np.bincount(row, minlength=end - first))
                sigs.append(sig)
                owners.append(ids[first + at])
                held += len(sig)
                if held >= PACKED:
                    yield packed(sigs, owners)
                    sigs, owners, held = [], [], 0
        if held:
            yield packed(sigs, owners)

    return run, "bucket int, sigs binary"


def _groups():
    """Buckets (sorted) -> the sets of each signature that several have, in blocks of BLOCK or fewer; the leader is in every block of its signature."""
    schema = pa.schema([("sig", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("leader", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        bucket, held = None, []
        for b in batches:
            for to, raw in zip(b.column("bucket").to_pylist(), b.column("sigs"), strict=True):
                if to != bucket and held:
                    yield from groups(held)
                    held = []
                bucket = to
                held.append(unpack(raw.as_buffer()))
        if held:
            yield from groups(held)

    def groups(held):
        sig, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[fresh], ids[fresh]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        n = np.diff(first, append=len(sig))
        small = (n > 1) & (n <= BLOCK)
        if small.any():
            yield rows(sig[first[small]], 1, 0, ids[first[small]], ids[ragged(first[small], n[small])], n[small])
        for at, count in zip(first[n > BLOCK].tolist(), n[n > BLOCK].tolist(), strict=True):
            mine = ids[at : at + count]
            mine = mine[np.argsort(mix(mine.view(np.uint64)), kind="stable")]
            blocks = -(-count // BLOCK)
            for j, own in enumerate(np.array_split(mine, blocks)):
                own = np.sort(own if j == 0 else np.append(own, mine[0]))
                yield rows(sig[at : at + 1], blocks, j, mine[:1], own, np.array([len(own)]))

    def rows(sig, blocks, block, leader, members, n):
        members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(members))
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(n), blocks, np.int64)), pa.array(np.full(len(n), block, np.int64)), pa.array(leader), members], schema=schema)

    return run, "sig long, blocks long, block long, leader long, members array<long>"


def _verify(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sides = []
                for c in ("text_a", "text_b"):
                    rows, values = [], []
                    for first, _, row, value in shingle_sets(part.column(c), k):
                        rows.append(row + first)
                        values.append(value)
                    sides.append((np.concatenate(rows), np.concatenate(values)))
                size = [np.bincount(r, minlength=part.num_rows) for r, _ in sides]
                row, value = np.concatenate([r for r, _ in sides]), np.concatenate([v for _, v in sides])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=part.num_rows)
                ok = (den * same >= num * (size[0] + size[1] - same)) & (same > 0)
                yield table({c: part.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("a", "b")}, schema)

    return run, "a long, b long"


def sketches(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketch of each set."""
    words = np.int64(1) << (levels(n) - 6)
    base = np.cumsum(words) - words
    bit = mix(value + np.uint64(0xD1B54A32D192ED03)) & (words[row] * 64 - 1).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, base[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [out[i : i + w].tobytes() for i, w in zip(base.tolist(), words.tolist(), strict=True)]


def levels(n: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(4.0 * np.maximum(n, 1))).astype(np.int64), LEAST_LEVEL, TOP_LEVEL)


def _near(num: int, den: int, first_only: bool):
    """Cells (sorted; cell, doc_id, n, component, sketch) -> pairs of different components that the sketches don't rule
    out (cell 0), or the first of a cell for each of its sets, with the cell. Half a sketch laid over the other half is the sketch of the next lower level."""
    schema = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(cell, ids, n, comp, ends, sketches):
        level = levels(n)
        order = np.argsort(level, kind="stable")
        place = np.empty(len(n), np.int64)
        full = {}
        for p in np.unique(level).tolist():
            mine = order[level[order] == p]
            place[mine] = np.arange(len(mine))
            full[p, p] = np.frombuffer(b"".join(sketches[i] for i in mine.tolist()), np.uint64).reshape(len(mine), -1)

        def at_level(p, q):
            """Sketches of level p as those of level q, p or lower."""
            if (p, q) not in full:
                up = at_level(p, q + 1)
                w = up.shape[1] // 2
                full[p, q] = up[:, :w] ^ up[:, w:]
            return full[p, q]

        after = ends - np.arange(len(n)) - 1
        done = np.cumsum(after)
        first, kept, has_partner = 0, [], np.zeros(len(n), bool)
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(np.arange(first, last), after[first:last])
            y = ragged(np.arange(first + 1, last + 1), after[first:last])
            ok = (comp[x] != comp[y]) & (np.maximum(n[x], n[y]) * num <= np.minimum(n[x], n[y]) * den) & ~has_partner[y]
            x, y = x[ok], y[ok]
            low = np.minimum(level[x], level[y])
            for p in np.unique(low).tolist():
                at = np.flatnonzero(low == p)
                sides = []
                for side in (x[at], y[at]):
                    s = np.empty((len(side), 1 << (p - 6)), np.uint64)
                    for own in np.unique(level[side]).tolist():
                        of = level[side] == own
                        s[of] = at_level(own, p)[place[side[of]]]
                    sides.append(s)
                differ = np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64)
                at = at[differ * (den + num) <= (n[x[at]] + n[y[at]]) * (den - num)]
                kept.append(np.stack([x[at], y[at]], 1))
            if first_only and kept:
                has_partner[kept[-1][:, 1]] = True
            first = last
        if not kept:
            return np.zeros((0, 3), np.int64)
        x, y = np.concatenate(kept).T
        if first_only:
            order = np.lexsort((x, y))
            x, y = x[order], y[order]
            fresh = np.diff(y, prepend=-1) > 0
            x, y = x[fresh], y[fresh]
        return np.unique(np.stack([cell[x] if first_only else np.zeros(len(x), np.int64), np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0)

    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cell = held.column("cell").to_numpy()
            end = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if end:
                yield from_cells(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from_cells(held)

    def from_cells(t: pa.Table) -> pa.RecordBatch:
        cell, ids, n, comp = (t.column(c).to_numpy() for c in ("cell", "doc_id", "n", "component"))
        cut = np.flatnonzero(np.append(cell[1:] != cell[:-1], True)) + 1
        found = compare(cell, ids, n, comp, np.repeat(cut, np.diff(cut, prepend=0)), t.column("sketch").to_pylist())
        return table({"cell": found[:, 0], "a": found[:, 1], "b": found[:, 2]}, schema)

    return run, "cell long, a long, b long"


def _single(docs: DataFrame) -> bool:
    """Whether no doc_id is repeated; nulls don't count."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for Jaccard similarity num/den or more of k-word shingles.

    Null or empty texts have no shingles and link with nothing. Texts with equal sets are one class. A repeated doc_id
    is one node with the links of all its texts and gives a row each; rows with a null doc_id get a null component. An
    empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _single(texts):
        return _classes(texts, k, num, den)
    rows = written(texts.withColumn("row", F.monotonically_increasing_id()))
    found = written(_classes(rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), k, num, den))
    of = rows.select("row", F.col("doc_id").alias("id")).join(found.withColumnRenamed("doc_id", "row"), "row")
    least = of.groupBy("component_id").agg(F.min("id").alias("least"))
    same = components(of.join(least, "component_id").select(F.col("id").alias("a"), F.col("least").alias("b")))
    done = of.join(same, of["id"] == same["node"], "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return done.unionByName(_unnamed(rows.where("doc_id is null"), k))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs without those that near-duplicate another that stays: of each group the row with the smallest
    doc_id does. Rows with a repeated or null doc_id are rows of their own, so that of repeated rows one stays. Texts
    without words stay."""
    if docs.where("doc_id is null").isEmpty() and _single(docs):
        spare = jaccard_components(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        spare = written(spare)
        return docs.join(F.broadcast(spare) if spare.count() <= BROADCAST_ROWS else spare, docs["doc_id"] == spare["_gone"], "left_anti").select(docs.columns)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), k, num, den)
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("_row").alias("z"))
    group = rows.select("_row", "doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    stays = group.groupBy("component_id").agg(F.min_by("_row", rank).alias("_row")).select("_row")
    return rows.join(stays, "_row", "left_semi").select(docs.columns)


def _unnamed(texts: DataFrame, k: int) -> DataFrame:
    run, shape = _profile(k)
    return texts.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(run, shape).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))


def _classes(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """jaccard_components of texts in which no doc_id is repeated."""
    spark = texts.sparkSession
    run, shape = _profile(k)
    unnamed = texts.where("doc_id is null")
    texts = texts.where("doc_id is not null")
    profile = written(texts.mapInArrow(run, shape))
    filled = profile.where("n_shingles > 0")
    cls = checkpointed(filled.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    probe = Bands(num, den)
    lows = F.array(*[F.lit(x) for x in probe.low.tolist()])
    band = F.size(F.filter(lows, lambda x: x <= F.col("n_shingles"))) - 1
    counts = {r["band"]: r["n"] for r in cls.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    bands = Bands(num, den, counts)

    def among(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)

    sigs = max(1, round(sum(c * sum(bands.made(i) for i in (j, j - 1) if i >= 0) for j, c in counts.items())))
    buckets = max(8, math.ceil(8 * sigs / BUCKET_BYTES))
    copies = checkpointed(filled.select("doc_id").join(cls.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    run, shape = _packed(k, bands, buckets, min(64, max(32, sigs.bit_length() + SPARE_BITS)))
    find, form = _groups()
    groups = written(among(texts, copies, "left_anti").mapInArrow(run, shape).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(find, form))
    swept(spark)

    def cells_of(members: DataFrame) -> DataFrame:
        return written(members.select("members").distinct().select(F.xxhash64("members").alias("cell"), F.explode("members").alias("doc_id")))

    cells = cells_of(groups)
    sets = cells.select("doc_id").distinct().count()
    sketch = filled.select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    swept(spark)

    def in_turns(rows: DataFrame, key: Column, a_set: float, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """step's results of all rows, a share of the keys at a time."""
        turns = math.ceil(rows.count() / max(LEAST_ROWS, a_set * sets)) or 1
        folder = new_folder(spark)
        for turn in range(turns):
            written(step(rows.where(F.pmod(key, F.lit(turns)) == turn)), f"{folder}/{turn}")
            swept(spark)
        return spark.read.parquet(*[f"{folder}/{turn}" for turn in range(turns)])

    def near(cells: DataFrame, component: DataFrame | None) -> DataFrame:
        """cells (cell, doc_id) -> all pairs (cell, a, b) of different components that may link; without components, a few of
        each cell that has any. A pair may be there more than once."""
        node = sketch.withColumn("component", F.col("doc_id")) if component is None else sketch.join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        run, shape = _near(num, den, component is None)
        return in_turns(cells, F.col("cell"), CELLS_A_SET, lambda some: some.join(node, "doc_id").select("cell", "doc_id", "n", "component", "sketch").repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(run, shape).distinct())

    def links(pairs: DataFrame) -> DataFrame:
        check, form = _verify(k, num, den)

        def verified(some: DataFrame) -> DataFrame:
            ids = checkpointed(some.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
            found = written(among(texts, ids, "left_semi"), folder := new_folder(spark))
            done = written(some.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(check, form))
            discard(spark, folder)
            return done

        return in_turns(pairs, F.xxhash64("a", "b"), LINKS_A_SET, verified)

    some = near(cells, None)
    found_links = links(written(some.select("a", "b").distinct()))
    component = components(found_links).withColumnRenamed("node", "doc_id")
    own = F.coalesce("component", "doc_id")
    apart = cells.join(component, "doc_id", "left").groupBy("cell").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y")
    cells = written(cells.join(apart, "cell", "left_semi").join(some.select("cell").distinct(), "cell", "left_semi"))
    large = groups.where("blocks > 1")
    if not large.isEmpty():
        label = large.select("sig", "blocks", "block", "leader", F.explode("members").alias("doc_id")).where("block = 0 or doc_id <> leader")
        label = label.join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        label = written(label.select("sig", "doc_id", "component", "blocks", "block"))
        apart = label.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        across = label.join(apart, "sig", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> other")
        across = across.groupBy("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.sort_array(F.collect_set("doc_id")).alias("members"))
        cells = cells.unionByName(cells_of(across))
    left = written(near(cells, component).select("a", "b").distinct())
    for turn in range(1, ROUNDS + 1):
        some = left
        if turn < ROUNDS and left.count() > PAIRS_A_SET * sets:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            some = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("b"))
            some = checkpointed(some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        more = links(some)
        found_links = found_links.unionByName(more)
        final = components(found_links)
        if some is left:
            break
        of = lambda x: final.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        left = left.join(some, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = written(left.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))

    named = cls.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    done = profile.join(named, ["key_a", "key_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return done.unionByName(_unnamed(unnamed, k))
