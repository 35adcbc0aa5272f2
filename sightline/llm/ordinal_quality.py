"""Quality classifier: ordinal cumulative-link regression, P(grade <= k) = sigmoid(threshold_k - weights . features).

All grades share the weights of hashed text features; the thresholds are ordered. Expected grade and the chance of the
highest grade come from the same fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, mix, table, text_slices, word_hashes, word_spans

BITS = 14
#: The fit uses at most so many labelled rows, those whose hashed id is smallest; one in FOLDS sets the cut.
TRAIN_ROWS, FOLDS, STEPS = 6000, 4, 150
#: Share of the best-graded held-out rows that the cut may reject.
LOSS = 0.002
DENSE = 8
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[44, 46, 59, 58, 63, 39, 34, 40, 41, 45]] = 6


def features(column: pa.Array):
    """first row, end row, row, index, value: hashed words, hashed word shapes and dense shares of whole texts."""
    size = 1 << BITS
    for first, end, data, offsets in text_slices(column):
        rows = end - first
        starts, ends, row = word_spans(data, offsets)
        low = lower_ascii(data)
        h = word_hashes(low, starts, ends)
        kind = _CLASS[data]
        shape = np.zeros(len(starts), np.uint64)
        for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 3, starts), np.maximum(ends - 2, starts), ends - 1):
            shape = shape * np.uint64(8) + (kind[at] if len(data) else np.zeros(0, np.uint8)).astype(np.uint64)
        n = np.bincount(row, minlength=rows)
        same = np.zeros(len(row), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        key = np.concatenate([row.astype(np.uint64) << np.uint64(32) | h & np.uint64(size - 1), row.astype(np.uint64) << np.uint64(32) | mix(shape + np.uint64(99)) & np.uint64(size - 1)])
        cell, count = np.unique(key, return_counts=True)
        at_row = (cell >> np.uint64(32)).astype(np.int64)
        value = np.sqrt(count / np.maximum(n[at_row], 1) / 2)
        part = lambda mask, of: np.bincount(of[mask], minlength=rows)
        byte_row = np.repeat(np.arange(rows), np.diff(offsets))
        total = np.maximum(np.diff(offsets), 1)
        word_cell = np.unique(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        distinct = np.bincount((word_cell >> np.uint64(40)).astype(np.int64), minlength=rows)
        dense = np.stack([
            part(kind == 2, byte_row) / total, part(kind == 5, byte_row) / total * 0.5, part(kind == 3, byte_row) / total, part(kind == 6, byte_row) / total,
            part(same, row) / np.maximum(n, 1), np.sqrt(distinct / np.maximum(n, 1)), np.log1p(n) / 10, total / np.maximum(n, 1) / 20,
        ], 1)
        dense = np.minimum(dense, 3.0)
        yield first, end, np.concatenate([at_row, np.repeat(np.arange(rows), DENSE)]), np.concatenate([(cell & np.uint64(0xFFFFFFFF)).astype(np.int64), np.tile(size + np.arange(DENSE), rows)]), np.concatenate([value, dense.ravel()])


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood. grade: 0 to grades - 1."""
    size, n = (1 << BITS) + DENSE, len(grade)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate([np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, s = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, gaps = free[:size], np.exp(free[size + 1 :])
        th = free[size] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, value * w[index], minlength=n)
        upper = np.where(grade < grades - 1, sigmoid(th[np.minimum(grade, grades - 2)] - z), 1.0)
        lower = np.where(grade > 0, sigmoid(th[np.maximum(grade - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        g_th = -np.bincount(np.minimum(grade, grades - 2), du * (grade < grades - 1), grades - 1) + np.bincount(np.maximum(grade - 1, 0), dl * (grade > 0), grades - 1)
        g = np.concatenate([np.bincount(index, value * (du - dl)[rows], minlength=size) + decay * w, [g_th.sum()], np.cumsum(g_th[::-1])[::-1][1:] * gaps])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        free = free - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return free[:size], free[size] + np.concatenate([[0], np.cumsum(np.exp(free[size + 1 :]))])


def predict(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold: rows by thresholds."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, grade: str = "quality", train_rows: int = TRAIN_ROWS, loss: float = LOSS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, grade) -> all columns of docs, expected_grade, tail_probability, keep.

    tail_probability is that of the highest grade; keep is false below a cut, at most 1/2, that rejects at most `loss`
    of the best-graded held-out rows of the sample. Null text is empty. Null grades and ids don't count; of repeated
    labels the highest does. With fewer than two grades nothing is rejected and the scores are null. Own columns named
    expected_grade, tail_probability or keep are replaced. An empty table gives no rows."""
    docs = docs.drop("expected_grade", "tail_probability", "keep")
    rated = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("long").alias("grade"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    schema = pa.schema([("at", pa.int64()), ("grade", pa.int64()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def gather(batches):
        for b in batches:
            grades, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grade", "at"))
            for first, end, row, index, value in features(b.column("text")):
                order = np.argsort(row, kind="stable")
                cuts = np.cumsum(np.bincount(row, minlength=end - first))[:-1]
                yield table({"at": at[first:end], "grade": grades[first:end], "index": np.split(index[order].astype(np.int32), cuts), "value": np.split(value[order].astype(np.float32), cuts)}, schema)

    once = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # a repeated id teaches once
    got = once.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("at"), "grade", "text").mapInArrow(gather, "at long, grade long, index array<int>, value array<float>").toArrow()
    known = np.unique(got.column("grade").to_numpy()) if got.num_rows else np.zeros(0, np.int64)
    shape = T.StructType(docs.schema.fields + [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    if len(known) < 2:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(None).cast("double"), "keep": F.lit(True)})
    got = got.sort_by("at")
    lists = got.combine_chunks()
    size = np.array([len(x) for x in lists.column("index")])
    index = np.concatenate([np.asarray(x) for c in lists.column("index").chunks for x in [c.flatten()]]).astype(np.int64)
    value = np.concatenate([np.asarray(x) for c in lists.column("value").chunks for x in [c.flatten()]]).astype(float)
    rank = np.searchsorted(known, lists.column("grade").to_numpy())
    row = np.repeat(np.arange(len(rank)), size)
    held = np.arange(len(rank)) % FOLDS == 0
    fits = lambda use: fit((np.cumsum(use) - 1)[row[use[row]]], index[use[row]], value[use[row]], rank[use], len(known))
    cut = 0.5
    if len(np.unique(rank[~held])) == len(known):
        w, th = fits(~held)
        z = np.bincount(row, value * w[index], minlength=len(rank))
        best = predict(z[held & (rank == len(known) - 1)], th)[:, -1]
        cut = min(cut, float(np.quantile(best, loss))) if len(best) else cut
    w, th = fits(np.ones(len(rank), bool))
    model = docs.sparkSession.sparkContext.broadcast((w, th, known, cut))

    def score(batches):
        w, th, known, cut = model.value
        for b in batches:
            tails = []
            for first, end, row, index, value in features(b.column("text").cast(pa.string())):
                tails.append(predict(np.bincount(row, value * w[index], minlength=end - first), th))
            tail = np.concatenate(tails) if tails else np.zeros((0, len(th)))
            expected = known[0] + tail @ np.diff(known).astype(float)
            more = [pa.array(expected, pa.float64()), pa.array(tail[:, -1], pa.float64()), pa.array(tail[:, -1] >= cut, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "expected_grade", "tail_probability", "keep"])

    return docs.mapInArrow(score, shape)
