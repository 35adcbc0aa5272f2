"""Classifiers and codecs against plain loops, with repeated rows and long texts."""

import math

import numpy as np
import pytest

from sightline.llm import ordinal_quality, toxicity
from sightline.llm.sentencepiece_codec import encode_texts
from sightline.llm.toxicity import EXCEPTIONS, Matcher, folded, score_toxicity


def loss(weights, thresholds, rows, decay=1e-4):
    """Mean negative log-likelihood of the cumulative-link model, row by row, with the penalty."""
    total = 0.0
    for x, grade in rows:
        z = sum(weights[i] * v for i, v in x)
        up = 1 / (1 + math.exp(-(thresholds[grade] - z))) if grade < len(thresholds) else 1.0
        low = 1 / (1 + math.exp(-(thresholds[grade - 1] - z))) if grade else 0.0
        total -= math.log(max(up - low, 1e-9))
    return total / len(rows) + decay / 2 * sum(w * w for w in weights)


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_fit_is_at_the_least_loss(grades):
    r = np.random.default_rng(grades)
    x = r.normal(size=(300, 3))
    grade = np.digitize(x @ [1.0, -0.5, 0.2] + r.logistic(size=300), np.linspace(-1, 1, grades - 1))
    w, th = ordinal_quality.fit(np.repeat(np.arange(300), 3), np.tile([1, 5, 8], 300), x.ravel(), grade, grades, steps=1500)
    rows = [(list(zip((1, 5, 8), v.tolist(), strict=True)), int(g)) for v, g in zip(x, grade, strict=True)]
    best = loss(w, th, rows)
    assert (np.diff(th) > 0).all()
    for k in (1, 5, 8):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, th, rows) > best - 1e-5
    for k in range(len(th)):
        for step in (-0.05, 0.05):
            moved = th.copy()
            moved[k] += step
            assert not (np.diff(moved) > 0).all() or loss(w, moved, rows) > best - 1e-5
    z = x @ w[[1, 5, 8]]
    assert np.allclose(ordinal_quality.predict(z, th), [[1 - 1 / (1 + math.exp(-(t - v))) for t in th] for v in z])


def test_entries_by_plain_search():
    weights = {" idiot ": 3.0, " idio": 1.0, " sham": 2.0, " zeb": 1.5, " zebra ": 0.5, " trash ": 3.0}
    match = Matcher(weights)
    for text in ["You id1ot, zebra zebras shameless", "trash can trash", "Trash cans and tr@sh", "", "...", "idiot" * 3, "an idiotic shame " * 50, "a trash can, trash collection; trash"]:
        t = folded(text)
        excused = [(i, i + len(p) + 2) for p in EXCEPTIONS for i in range(len(t)) if t.startswith(f" {p} ", i)]
        best = {}
        for entry, w in weights.items():
            for i in range(len(t)):
                if t.startswith(entry, i) and not any(a <= i < b - 1 for a, b in excused):
                    best[i] = max(best.get(i, 0), w)
        words, total = max(1, t.count(" ") - 1), sum(best.values())
        assert match.features(text) == pytest.approx((math.log1p(10 * total / math.sqrt(words + 20)), 10 * total / (words + 20), max(best.values(), default=0.0), 10 * len(best) / (words + 20)))


def test_repeated_rows_teach_once_and_score_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs)
    for score, name in ((lambda d: ordinal_quality.score_quality(d, labels).select("doc_id", "tail_probability"), "quality"), (lambda d: score_toxicity(d, labels).select("doc_id", "score"), "toxic")):
        one, two = sorted(tuple(r) for r in score(docs).collect()), sorted(tuple(r) for r in score(twice).collect())
        assert [r[0] for r in two[::2]] == [r[0] for r in one] and two[::2] == two[1::2], name
        assert np.allclose([r[1] for r in two[::2]], [r[1] for r in one], atol=1e-9), name
    assert toxicity.CUT == 0.7


def test_long_and_repeated_texts_of_pieces(spark):
    text = "Some words é中 and\nmore  spaces " * 8000
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, None, 3), (3, "x", 4)], "doc_id long, text string, n_tokens int")
    got = encode_texts(docs).orderBy("doc_id", "n_tokens").collect()
    assert got[0] == got[1] and got[0].n_tokens > 50_000 and got[0].n_bytes >= 8000 and all(r.decoded for r in got) and got[2].n_tokens == 0
