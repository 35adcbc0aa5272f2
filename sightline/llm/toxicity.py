"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are lower-cased, homoglyphs and digit substitutions inside words are folded and all but letters becomes one
space. Entries are words and word beginnings, given by hand and learned from labelled texts, each with a weight.
Hits inside an exception phrase don't count. The sum of weights, normalised by length, and the largest weight give
the score by a logistic fit."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, fold_of, table

# The lexicon's words by weight, and the phrases that excuse them.
WORDS = {
    4.0: "asshole bastard bitch cretin cunt dickhead dumbass fuck fucker motherfucker retard scumbag shithead slut subhuman whore",
    3.5: "bullshit degenerate imbecile moron parasite scum shit twat vermin wanker worthless",
    3.0: "clown crap disgusting filth fool garbage idiot idiotic jerk loser pathetic shitty stupid trash",
    2.0: "damn despicable dimwit dumb hateful imbecilic nasty pig repulsive sicko weirdo",
}
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "garbage collection", "garbage collector", "garbage truck", "clown fish", "pathetic fallacy", "fool proof", "guinea pig", "pig iron", "damn good"]
# Characters that look like a letter, and digits or signs that stand for one inside a word.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһνωαορκτιβ", "aeopcyxijsdhvwaopktib", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: The fit uses at most so many labelled rows, those whose hashed id is smallest. Entries are learned from these alone.
TRAIN_ROWS, LEAST, ODDS = 20_000, 4, 2.5
CUT = 0.7
_FOLD = str.maketrans(HOMOGLYPHS)
_SIGNED = re.compile(r"[^\W_]*(?:[@$!][^\W_]+|[^\W_]+)(?:[@$!]+[^\W_]+)*")
_HAS_SIGN = re.compile(r"[0134578@$!]")
_OTHER = re.compile(r"[\W\d_]+")
_MARK = re.compile(r"[\u0300-\u036f]+")
_BEYOND = re.compile(r"[^\W\d_]*[^\x00-\x7f\W\d_][^\W\d_]*")
_BY_HAND = frozenset(" ".join(WORDS.values()).split())


def _unmarked(m: re.Match) -> str:
    """A word without its accents, where that is a word of the lexicon; other languages' words keep theirs."""
    plain = _MARK.sub("", unicodedata.normalize("NFKD", m[0]))
    return plain if plain in _BY_HAND else m[0]


def _read(m: re.Match) -> str:
    """A word's signs and digits as letters, where letters are most of it or it begins with one sign; else it stays."""
    word = m[0]
    if not _HAS_SIGN.search(word) or 2 * sum(c.isalpha() for c in word) <= len(word):
        return word
    return "".join(SIGNS.get(c, c) for c in word)


def folded(text: str | None) -> str:
    """Letters alone, lower-cased, words apart by a space: wide forms, accents on words of the lexicon, homoglyphs, and signs and digits in
    words or at their edges are the letters that they stand for."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
        text = _BEYOND.sub(_unmarked, text)
    text = _SIGNED.sub(_read, text) if _HAS_SIGN.search(text) else text
    return f" {_OTHER.sub(' ', text).strip()} "


def candidates(words: set[str]) -> set[str]:
    """Whole words, and their beginnings of 4 to 7 letters; a space marks a word's edge."""
    out = {f" {w} " for w in words if len(w) > 2}
    for n in range(4, 8):
        out.update(" " + w[:n] for w in words if len(w) >= n)
    return out


class Matcher:
    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.automaton.add_word(entry, (len(entry), w))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float, float]:
        """log of the sum of weights by root of length, that sum by word, the largest weight, hits by word. A word counts once, with
        its heaviest entry."""
        t = folded(text)
        hits, excused = {}, []
        for end, (n, w) in self.automaton.iter(t):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > hits.get(start, 0):
                hits[start] = w
        if excused:
            begins, reach = [], []  # the phrases' begins in order, and how far those so far reach
            for a, b in sorted(excused):
                begins.append(a)
                reach.append(max(b, reach[-1] if reach else b))
            hits = {s: w for s, w in hits.items() if not (k := bisect_right(begins, s)) or s >= reach[k - 1]}
        words, total = max(1, t.count(" ") - 1), sum(hits.values())
        return math.log1p(10 * total / math.sqrt(words + 20)), 10 * total / (words + 20), max(hits.values(), default=0.0), 10 * len(hits) / (words + 20)


def learn_weights(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of the entries that toxic texts hold; an entry that a shorter one covers as well is left out."""
    weights = {f" {w} ": weight for weight, words in WORDS.items() for w in words.split()}
    good = []
    for entry, p, n in counts:
        w = math.log((p + 0.1) / (toxic + 1)) - math.log((n + 0.1) / (clean + 1))
        if w >= ODDS and p >= 10 * n:
            good.append((entry, min(w, 8.0)))
    have = {}
    for entry, w in sorted(good, key=lambda x: (len(x[0]), x[0])):
        if not any(entry[:n] in have and have[entry[:n]] >= w - 2 for n in range(5, len(entry))):
            have[entry] = w
    return weights | have


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 600) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w[-1] = -2.0
    for step in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + 1e-4 * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    Labels of ids whose crc32 modulo folds is `held` are never used. For the logistic fit, each half of the
    training rows is measured with the entries of the other half. Null text is empty and scores as a text without hits; a null doc_id is
    held out; repeated rows score alike; of repeated labels the highest counts; without labels of both kinds the
    hand-written weights alone give the score. An empty table gives no rows."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    once = d.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # a repeated id teaches once
    sample = once.join(F.broadcast(known), "doc_id").withColumn("half", F.crc32(F.concat(F.lit("half"), F.col("doc_id")).cast("binary")) % 2).withColumn("half", F.col("half").cast("int"))

    def entries(batches):
        form = pa.schema([("entry", pa.string()), ("half", pa.int32()), ("p", pa.int64()), ("n", pa.int64())])
        for b in batches:
            both = (Counter(), Counter())
            for text, toxic, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                both[toxic <= 0].update((c, half) for c in candidates(set(folded(text).split())))
            keys = list(both[0].keys() | both[1].keys())
            yield table({"entry": [k for k, _ in keys], "half": [h for _, h in keys], "p": [both[0][k] for k in keys], "n": [both[1][k] for k in keys]}, form)

    counted = checkpointed(sample.select("text", "toxic", "half").mapInArrow(entries, "entry string, half int, p long, n long").groupBy("entry", "half").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    sizes = {r["half"]: (r["p"], r["n"]) for r in sample.groupBy("half").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).collect()}

    def weights_of(halves: list[int]) -> dict[str, float]:
        toxic, clean = (sum(sizes.get(h, (0, 0))[i] for h in halves) for i in (0, 1))
        least = max(LEAST, toxic // 150)
        rows = counted.where(F.col("half").isin(halves)).groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        rows = rows.where((F.col("p") >= least) & (F.col("p") >= 10 * F.col("n"))).orderBy("entry").collect()  # bounded by the sample
        return learn_weights([tuple(r) for r in rows], toxic, clean)

    other = {0: weights_of([1]), 1: weights_of([0])}
    weights = weights_of([0, 1])

    def measured(batches):
        form = pa.schema([("at", pa.int64()), ("toxic", pa.int32()), ("f", pa.list_(pa.float64()))])
        matcher = {h: Matcher(w) for h, w in other.items()}
        for b in batches:
            f = [matcher[h].features(t) for h, t in zip(b.column("half").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield table({"at": b.column("at").to_numpy(zero_copy_only=False), "toxic": b.column("toxic").to_numpy(zero_copy_only=False), "f": f}, form)

    got = sample.select(F.col("doc_id").alias("at"), "toxic", "text", "half").mapInArrow(measured, "at long, toxic int, f array<double>").orderBy("at").toPandas()
    if len(got) and got["toxic"].nunique() > 1:
        model = logistic(np.array(got["f"].tolist()), got["toxic"].to_numpy(float))
    else:
        model = np.array([0.5, 1.0, 1.0, 0.5, -3.0])
    state = spark.sparkContext.broadcast((weights, model))

    def score(batches):
        form = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        weights, model = state.value
        matcher = Matcher(weights)
        for b in batches:
            valid = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            x = np.array([matcher.features(t) for t in b.column("text").to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -30, 30)))
            held_out = (fold_of(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), folds) == held) | ~valid
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held_out), pa.array(p), pa.array((p >= CUT).astype(np.int32))], schema=form)

    return d.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
