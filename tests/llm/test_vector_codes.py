import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.vector_codes import Balls, assign, book_digest, code_text, encode_vectors, with_label_errors

FORM = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd's algorithm on integers, all entries compared: {(id, label, vector): (code, error)} and the codebooks."""
    kept = [(i, x, y) for i, x, y in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    width = -(-max(len(x) for _, x, _ in kept) // parts) * parts
    size = width // parts
    whole = [[math.floor(c * scale) for c in x] + [0] * (width - len(x)) for _, x, _ in kept]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    start = [min(v for (j, _, _), v in zip(kept, whole, strict=True) if j == i) for i in ids] or [[0] * width]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    book = [[cut(v, p) for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, p: min((far(a, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        codes = [[nearest(cut(v, p), p)[1] for p in range(parts)] for v in whole]
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [cut(v, p) for v, c in zip(whole, codes, strict=True) if c[p] == k]
                if mine:
                    book[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (i, _, y), v in zip(kept, whole, strict=True):
        near = [nearest(cut(v, p), p) for p in range(parts)]
        out.append((i, y, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    return out, book


def compare(spark, rows, **k):
    got, book = encode_vectors(spark.createDataFrame([(*r, "z") for r in rows], FORM).repartition(3), **k)
    want, plain_book = plain(rows, **k)
    assert sorted([(r.vec_id, r.label, r.text, r.error) for r in got.select("vec_id", "label", code_text("code").alias("text"), "error").collect()], key=str) == sorted(want, key=str)
    assert book.tolist() == plain_book
    return got, want


def test_against_lloyd(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(24)] for _ in range(9)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)], i % 4 or None) for i in range(400)]
    compare(spark, rows)
    compare(spark, rows, parts=3, entries=5, rounds=20)
    got, want = compare(spark, [(i, [float(r.randint(-2, 2)) / 4096 for _ in range(16)], 0) for i in range(300)])  # many ties
    both = {}
    for _, y, _, e in want:
        both[y] = both.get(y, 0) + e
    assert {r.label: r.label_error for r in with_label_errors(got).collect()} == both


def test_edges(spark):
    """Rows left out, few, repeated and missing ids, repeated vectors, lengths that differ, components out of range."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 0.0], 1), (5, [0.5] * 8, None), (5, [0.25] * 8, 1), (6, [-0.3] * 8, None), (None, [0.1] * 8, 2), (7, [0.5] * 8, 2), (7, [0.5] * 8, 2), (8, [0.9, -0.9, 0.2], 3), (9, [], 3)]
    got, want = compare(spark, rows)
    sums = {r.label: r.label_error for r in with_label_errors(got).collect()}
    assert sums[None] == sum(e for _, y, _, e in want if y is None)
    compare(spark, [(i, [1e5 * (i % 7) + i / 8] * 8, 0) for i in range(60)])  # beyond NARROW
    assert encode_vectors(spark.createDataFrame([(1, [1e300, 1.0], 0, "z"), (2, [-1e300, 2.0], 0, "z")], FORM))[0].count() == 2
    assert encode_vectors(spark.createDataFrame([(1, None, 0, "z")], FORM))[0].count() == 0 == encode_vectors(spark.createDataFrame([], FORM))[0].count()
    assert encode_vectors(spark.createDataFrame([(None, [0.5] * 8, 0, "z")], FORM))[0].first().error == 0


@pytest.mark.parametrize("seed", range(6))
def test_rings_and_cores(seed):
    """Restricted candidates find what all candidates do, after entries have moved a little."""
    r = np.random.default_rng(seed)
    x = r.integers(-50, 50, (3000, 2))
    book = r.integers(-50, 50, (1, 16, 2))
    code, far = assign(x, None, Balls.of(book, None, np.ones((1, 16), bool)), 0, True)
    new = book + r.integers(-3, 4, book.shape) * (r.random((1, 16, 1)) < 0.3)
    radius = [[(math.isqrt(int(far[code == i].max(initial=0))) + 8) ** 2 for i in range(16)]]
    balls = Balls.of(new, radius, (new != book).any(2))
    want = assign(x, None, Balls.of(new, None, np.ones((1, 16), bool)), 0, True)
    got = assign(x, code, balls, 0, True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and (assign(x, code, balls, 0, False)[0] == want[0]).all()
    few = Balls.of(book * 100, [[1] * 16], np.zeros((1, 16), bool))
    assert few.still.any() and (few.reach[0, :, 0] > 4).all()


def test_digest():
    assert book_digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
