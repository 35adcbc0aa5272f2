import math
import re
import zlib
from collections import Counter

import numpy as np

from sightline.llm import lm_score, ordinal_quality
from sightline.llm.lm_score import score_texts
from sightline.llm.ordinal_quality import score_quality

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_recovers_three_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    grade = np.digitize(2 * x[:, 0] - x[:, 1] + rng.logistic(size=4000) * 0.5, [-1, 1])
    w, th = ordinal_quality.fit(np.repeat(np.arange(4000), 2), np.tile([3, 9], 4000), x.ravel(), grade, 3)
    tail = ordinal_quality.predict(x[:, 0] * w[3] + x[:, 1] * w[9], th)
    assert th[0] < th[1] and w[3] > 0 > w[9] and (tail[:, 0] >= tail[:, 1]).all()
    assert np.corrcoef(tail.sum(1), grade)[0, 1] > 0.8


def test_quality_separates_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = score_quality(docs, learn).join(test, "doc_id").collect()
    good, bad = [r.tail_probability for r in rows if r.quality == 1], [r.tail_probability for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (4, "a " * 50000, "w")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, None)], "doc_id long, quality int")
    assert len(score_quality(docs, labels).collect()) == 4
    assert all(r.keep for r in score_quality(docs, labels.limit(0)).collect())
    assert score_quality(docs.limit(0), labels).collect() == []


def base(rows, folds):
    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = {d: zlib.crc32(str(d).encode()) % folds == 0 for d, _ in rows}
    c = Counter(w for d, t in rows if not held[d] for w in toks(t))
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))) for d, t in rows}


def test_lm_base_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as n", "2 as uid")
    want = base([(r.doc_id, r.text) for r in docs.collect()], 10)
    got = score_texts(docs).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == {d: x[:4] for d, x in want.items()}
    assert all(abs(r.base_score - want[r.doc_id][4]) < 1e-6 * abs(r.base_score) for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [d for d, x in want.items() if x[0]]
    assert sum(score[d] for d in held) > sum(want[d][4] for d in held)


def test_lm_is_normalised_and_edges(spark):
    n = np.arange(900, 0, -1)
    for words in (0, 5, 127, 300, 900):
        items = lm_score.Items.of(n[:words].astype(np.uint64), n[:words], 7, np.ones(64), np.ones(64))
        p, all_items = lm_score.initial(items), np.arange(words + 65)
        p = {k: x + np.random.default_rng(1).normal(0, 0.5, x.shape) for k, x in p.items()}
        for two, one in ((0, 1), (words + 65, words), (words + 65, words + 65)):
            logs = lm_score.log_probabilities(p, items, np.full(words + 65, two), np.full(words + 65, one), all_items)
            assert abs(np.exp(logs).sum() - 1) < 1e-4
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "a " * 5000), (4, "a b"), (5, "A\x0bé")], "doc_id long, text string")
    rows = score_texts(docs).collect()
    assert len(rows) == 6 and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    assert score_texts(docs.limit(0)).collect() == []


def plain_log(p, items, two, one, item):
    """Natural log of an item's probability after its two items, by loops."""
    q = [sum(float(p["r"][w][i]) * float(p["c"][k][i][j]) for k, w in enumerate((two, one)) for i in range(lm_score.DIM)) for j in range(lm_score.DIM)]

    def choose(right, among):
        z = [sum(a * float(b) for a, b in zip(q, row[:-1], strict=True)) + float(row[-1]) for row in among]
        return z[right] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))

    group = items.group[item]
    inside = np.flatnonzero(items.group == group)
    return choose(group, p["t"]) + (choose(item - inside[0], p["u"][inside]) if group < len(items.edges) - 1 else 0)


def test_lm_tables_equal_plain_loops(monkeypatch):
    n = np.arange(900, 0, -1)
    items = lm_score.Items.of(n.astype(np.uint64), n, 7, np.ones(64), np.ones(64))
    rng = np.random.default_rng(2)
    two, one, item = (np.concatenate([[963, 964, 965], rng.integers(0, 966, 60)]) for _ in range(3))
    item = np.minimum(item, 964)
    for spread in (0.5, 20):  # the second: choices so far apart that products of exponentials vanish
        p = {k: (x + rng.normal(0, spread, x.shape)).astype(np.float32) for k, x in lm_score.initial(items).items()}
        want = np.array([plain_log(p, items, *x) for x in zip(two, one, item, strict=True)])
        for size in (0, 200_000, 32 << 20):  # no words, some and all in the tables
            monkeypatch.setattr(lm_score, "TABLE_BYTES", size)
            scorer = lm_score.Scorer(p, items)
            assert (scorer.held == 900) == (size > 200_000) and (scorer.held > 0) == (size > 0)
            assert np.allclose(scorer(two, one, item), want, rtol=1e-4, atol=1e-3 * spread)


def test_lm_scores_in_one_pass_equal_plain_loops(spark, monkeypatch):
    seen, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda learn, items: seen.append((fit(learn, items), items)) or seen[0][0])
    words = [f"{a}{b}" for a in ("x", "Yy", "z9", "é") for b in range(200)]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(words[int(k)] for k in rng.zipf(1.3, 40) % len(words))) for i in range(60)] + [(60, ""), (61, None), (62, "new new x1")]
    scored = score_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    (p, items), got, held = seen[0], {r.doc_id: r.score for r in scored.collect()}, {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    toks = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() for i, t in rows}
    count = Counter(w for i, ws in toks.items() if i not in held for w in ws)

    def shape(w):
        return min(len(w), 16) - 1 + 16 * any(b >= 128 for b in w) + 32 * any(b < 97 or 122 < b < 128 for b in w)

    item_of = {int(k): int(i) for k, i in zip(items.keys, items.item, strict=True)}
    rare = [w for w in count if lm_score.hash_word(w) not in item_of]
    mass = Counter()
    for w in rare:
        mass[shape(w)] += count[w] + 0.1
    assert len(item_of) and rare
    for i, ws in toks.items():
        total, two, one = 0.0, items.words + 65, items.words + 65
        for w in [*ws, None]:
            item = items.words + 64 if w is None else item_of.get(lm_score.hash_word(w), items.words + shape(w))
            total += plain_log(p, items, two, one, item)
            if items.words <= item < items.words + 64:
                total += math.log((count[w] + 0.1) / (mass[shape(w)] + 0.1))
            two, one = one, item
        assert abs(got[i] - total / math.log(10)) < 1e-4 * abs(got[i]), i


def test_lm_learns_words_after_words():
    items = lm_score.Items.of(np.arange(400, dtype=np.uint64), np.full(400, 100), 1, np.zeros(64), np.zeros(64))
    rng = np.random.default_rng(0)
    one = rng.integers(0, 400, 100_000)
    two, word = rng.integers(0, 400, 100_000), (one + 200) % 400
    trainer = lm_score.Trainer(lm_score.initial(items), items, lm_score.RATE, 0)
    loss = lambda p: -lm_score.log_probabilities(p, items, two, one, word).mean()
    before = loss(trainer.p)
    for _ in range(8):
        trainer.learn(two, one, word)
    assert before > 5.9 and loss(trainer.p) < before - 1
