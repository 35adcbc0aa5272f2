"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Outputs are items: frequent words, the end mark, and shapes (length and letters) for all other words. The number of words that
are items grows with the root of the vocabulary. The most frequent words and the end mark are groups of their own, the other
words make groups of near frequency (bands), the shapes one more; a word of a shape goes by its count in the shape:
P(word | context) = P(group | two items before) * P(item | group, two items before) * P(word | item). Each factor is
normalised, so the products are. Counts are taken over all training texts, and every token of every training text is an
example: the texts are dealt to ROUNDS parts, tasks pass over their texts of a part and their parameters are averaged.
Where a task has few tokens its batches are smaller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORD, checkpoint_dir, fold, hash_word, lower_ascii, table, text_slices, word_hashes, word_spans, written

SINGLE = 63  # most frequent words, groups of their own
BANDS = 63  # at least
SHAPES = 64
DIM, NOISE, BAND_NOISE, BATCH, STEPS, ROUNDS, RATE = 15, 24, 1, 2048, 60, 3, 0.1
PAST = 10.0  # squared gradient that every row starts with
CHUNK = 4096  # parameters in a row of the average
SCORE_BYTES = 1 << 19  # of text at a time: arrays that stay near the processor
TABLE_BYTES = 32 << 20  # of a scorer's tables in a task, more or less
END = hash_word(b"\n end of text \n")
_MARKS = np.array([16 * (b >= 128) + 32 * (b < 97 or 122 < b < 128) for b in range(256)], np.uint8) * WORD


def tokens(column: pa.Array, limit: int = SLICE_BYTES):
    """first row, end row, row, word hash, shape of every token in order; each text closes with an end mark."""
    for first, end, data, offsets in text_slices(column, limit):
        data = lower_ascii(data)
        starts, ends, row = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        shape = np.minimum(ends - starts, 16) - 1
        if len(starts):  # white space has no marks, so a word may be taken up to the next one
            shape += np.bitwise_or.reduceat(_MARKS[data], starts)
        n = np.bincount(row, minlength=end - first)
        at = np.arange(len(row)) + row
        total = len(row) + end - first
        out_row, out_h, out_shape = np.repeat(np.arange(end - first), n + 1), np.full(total, END, np.uint64), np.zeros(total, np.int64)
        out_h[at], out_shape[at] = h, shape
        yield first, end, out_row, out_h, out_shape


@dataclass
class Items:
    """Items are the words by falling count, then the shapes, then the end mark; the number after them stands before a text."""

    keys: np.ndarray  # sorted hashes of the words
    item: np.ndarray  # item of each key
    count: np.ndarray  # training count of every item
    group: np.ndarray  # group of every item: bands, shapes, single words, end mark
    edges: np.ndarray  # first item of each band, of the shapes, and of what follows them
    mass: np.ndarray  # smoothed count of each shape

    @classmethod
    def of(cls, h: np.ndarray, n: np.ndarray, n_end: int, n_shape: np.ndarray, v_shape: np.ndarray) -> Items:
        words, single = len(h), min(SINGLE, len(h))
        bands = min(max(BANDS, int(np.sqrt(words))), words - single)
        edges = np.append(single + np.arange(bands + 1) * (words - single) // max(bands, 1), words + SHAPES)
        group = np.concatenate([np.arange(single) + bands + 1, np.repeat(np.arange(bands + 1), np.diff(edges)), [bands + 1 + single]])
        order = np.argsort(h)
        return cls(h[order], order, np.concatenate([n, n_shape, [n_end]]).astype(float), group, edges, n_shape + 0.1 * (v_shape + 1))

    @property
    def words(self) -> int:
        return len(self.keys)

    @property
    def groups(self) -> int:
        return len(self.edges) + min(SINGLE, self.words)

    def is_shape(self, item: np.ndarray) -> np.ndarray:
        return (item >= self.words) & (item < self.words + SHAPES)

    def choices(self, group: np.ndarray) -> np.ndarray:
        """Positions of the items that are chosen inside their group."""
        return np.flatnonzero(group < len(self.edges) - 1)

    def find(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        other = np.where(h == END, self.words + SHAPES, self.words + shape)
        if not self.words:
            return other
        at = np.minimum(np.searchsorted(self.keys, h), self.words - 1)
        return np.where(self.keys[at] == h, self.item[at], other)

    def contexts(self, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items two before and one before each token."""
        pad = len(self.group)
        one, two = np.full(len(item), pad), np.full(len(item), pad)
        one[1:] = np.where(row[1:] == row[:-1], item[:-1], pad)
        two[2:] = np.where(row[2:] == row[:-2], item[:-2], pad)
        return two, one


def initial(items: Items) -> dict[str, np.ndarray]:
    """r: of context items, c: of the two places, t: of groups, u: of items in their groups; the last column of t and u is a
    bias that starts as the log frequency."""
    rng = np.random.default_rng(3)
    n = items.count + 0.1
    by_group = np.bincount(items.group, n, items.groups)
    out = lambda log: np.column_stack([rng.normal(0, 0.1, (len(log), DIM)), log])
    p = {"r": rng.normal(0, 0.1, (len(n) + 1, DIM)), "c": np.stack([np.eye(DIM)] * 2), "t": out(np.log(by_group / n.sum())), "u": out(np.log(n / by_group[items.group]))}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    z -= top[:, None]
    return top + np.log(np.exp(z, out=z).sum(1))


class Scorer:
    """Natural log of each item's probability after its two items.

    The groups and the shapes are chosen at most tokens. The sum over their choices' exponentials is a product of two rows, that of the
    item two before and that of the one before, of tables (items by choices) that are made once for a model. They hold the shapes,
    the marks and the most frequent words, as many as TABLE_BYTES takes; after other words the exponentials are summed for the token."""

    def __init__(self, p: dict[str, np.ndarray], items: Items):
        self.p, self.items = p, items
        self.places = [p["r"] @ c for c in p["c"]]
        self.held = int(np.clip(TABLE_BYTES // (8 * (items.groups + SHAPES)) - SHAPES - 2, 0, items.words))
        self.of_groups, self.of_shapes = self._tables(p["t"]), self._tables(p["u"][items.words : items.words + SHAPES])

    def _tables(self, among: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place the exponentials of its part of the choices' sums, and the log of what each row is divided by."""
        out = []
        for place, bias in zip(self.places, (among[:, DIM], 0), strict=True):
            z = np.concatenate([place[: self.held], place[self.items.words :]]) @ among[:, :DIM].T
            z += bias
            top = z.max(1)
            z -= top[:, None]
            out.append((np.exp(z, out=z), top))
        return out

    def _choose(self, some: np.ndarray | slice, q: np.ndarray, rows: tuple, right: np.ndarray, among: np.ndarray, tables: list) -> np.ndarray:
        two, one, out_of = (x[some] for x in rows)
        (a, top_a), (b, top_b) = tables
        sums = np.empty(len(q), a.dtype)
        for at in range(0, len(q), 512):
            part = slice(at, at + 512)
            sums[part] = np.einsum("nd,nd->n", a.take(two[part], axis=0), b.take(one[part], axis=0))
        plain = np.flatnonzero(out_of | (sums < 1e-20))  # or two rows so far apart that the product may have lost the choices
        sums[plain] = 1
        chosen = among.take(right, axis=0)
        out = np.einsum("nd,nd->n", q, chosen[:, :DIM]) + chosen[:, DIM] - (np.log(sums) + top_a[two] + top_b[one])
        for at in range(0, len(plain), 1 << 10):
            part = plain[at : at + (1 << 10)]
            out[part] = _plain(q[part], right[part], among)
        return out

    def __call__(self, two: np.ndarray, one: np.ndarray, item: np.ndarray) -> np.ndarray:
        p, items = self.p, self.items
        q, group = self.places[0].take(two, axis=0), items.group[item]
        q += self.places[1].take(one, axis=0)
        lo = items.words
        rows = [np.where(x < lo, np.minimum(x, max(self.held - 1, 0)), x - (lo - self.held)) for x in (two, one)]
        rows.append((two >= self.held) & (two < lo) | (one >= self.held) & (one < lo))
        out = self._choose(slice(None), q, rows, group, p["t"], self.of_groups).astype(float)
        shaped = items.is_shape(item)
        some = np.flatnonzero(shaped)
        out[some] += self._choose(some, q[some], rows, item[some] - lo, p["u"][lo : lo + SHAPES], self.of_shapes)
        inner = np.flatnonzero((group < len(items.edges) - 1) & ~shaped)
        inner = inner[np.argsort(_short(group[inner]), kind="stable")]
        for some in np.split(inner, np.flatnonzero(np.diff(group[inner])) + 1) if len(inner) else ():
            lo, hi = items.edges[group[some[0]] : group[some[0]] + 2]
            for at in range(0, len(some), 1 << 10):
                part = some[at : at + (1 << 10)]
                out[part] += _plain(q.take(part, axis=0), item[part] - lo, p["u"][lo:hi])
        return out


def _plain(q: np.ndarray, right: np.ndarray, among: np.ndarray) -> np.ndarray:
    z = q @ among[:, :DIM].T
    z += among[:, DIM]
    return z[np.arange(len(z)), right] - _log_sum(z)


def log_probabilities(p: dict[str, np.ndarray], items: Items, two: np.ndarray, one: np.ndarray, item: np.ndarray) -> np.ndarray:
    return Scorer(p, items)(two, one, item)


def _short(x: np.ndarray) -> np.ndarray:
    """Small numbers in a type that sorts faster."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


class Trainer:
    """Noise-contrastive steps with AdaGrad, one rate a row, on the rows that a batch touches."""

    def __init__(self, p: dict[str, np.ndarray], items: Items, rate: float, seed: int):
        self.p, self.items, self.rate, self.rng = {k: x.copy() for k, x in p.items()}, items, np.float32(rate), np.random.default_rng(seed)
        self.past = {k: np.full(len(x), PAST, np.float32) for k, x in p.items()}
        by_group = np.bincount(items.group, items.count + 0.1, items.groups)
        self.up_to = np.cumsum(by_group) / by_group.sum()
        self.log_noise = np.log(NOISE * by_group / by_group.sum()).astype(np.float32)
        self.size = np.diff(items.edges)
        self.level = np.log(BAND_NOISE / np.maximum(self.size, 1)).astype(np.float32)

    def change(self, k: str, at: np.ndarray, g: np.ndarray) -> None:
        """Take a step on rows at by the sums of their gradients, DIM + 1 numbers each, which are added up two at a time."""
        order = np.argsort(_short(at), kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at = at[first]
        g = np.add.reduceat(g.take(order, axis=0).view(np.complex64), first).view(np.float32)[:, : self.p[k].shape[1]]
        past = self.past[k][at] + np.einsum("nd,nd->n", g, g) / g.shape[1]
        self.past[k][at] = past
        g *= (self.rate / np.sqrt(past))[:, None]
        self.p[k][at] = self.p[k].take(at, axis=0) - g

    def step(self, context: np.ndarray, item: np.ndarray) -> None:
        """context: the items two before and one before each item."""
        p, items, n = self.p, self.items, len(item)
        group, noise = items.group[item], np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE), "right"), items.groups - 1)
        before, places = p["r"].take(context.ravel(), axis=0).reshape(n, 2 * DIM), p["c"].reshape(2 * DIM, DIM)
        x = np.ones((n, DIM + 1), np.float32)
        x[:, :DIM] = before @ places
        right, wrong = p["t"].take(group, axis=0), p["t"].take(noise, axis=0)
        good = _sigmoid(self.log_noise[group] - np.einsum("nd,nd->n", x, right)) - 1
        level = -wrong
        level[:, DIM] += self.log_noise[noise]
        bad = _sigmoid(x @ level.T)
        dx = bad @ wrong
        dx += good[:, None] * right
        self.change("t", np.concatenate([group, noise]), np.concatenate([good[:, None] * x, bad.T @ x]))
        inner = items.choices(group)
        if len(inner):
            some, g = x.take(inner, axis=0), group[inner]
            drawn = items.edges[g] + (self.rng.random((BAND_NOISE, len(inner)), np.float32) * self.size[g]).astype(np.int64)
            word = np.concatenate([item[inner][None], drawn])
            rows = p["u"].take(word, axis=0)
            s = _sigmoid(self.level[g] - np.einsum("nd,ind->in", some, rows))
            s[0] -= 1
            rows *= s[:, :, None]
            dx[inner] = dx.take(inner, axis=0) + rows.sum(0)
            self.change("u", word.ravel(), (s[:, :, None] * some).reshape(-1, DIM + 1))
        dq = dx[:, :DIM]
        back = np.zeros((2, DIM + 1, DIM), np.float32)
        back[:, :DIM] = p["c"]
        moves, g = (dq @ back.reshape(-1, DIM).T).reshape(2 * n, DIM + 1), (before.T @ dq).reshape(2, DIM, DIM)
        self.past["c"] += (g * g).mean((1, 2))
        p["c"] -= g * (self.rate / np.sqrt(self.past["c"]))[:, None, None]
        self.change("r", context.ravel(), moves)

    def learn(self, two: np.ndarray, one: np.ndarray, item: np.ndarray) -> None:
        """A pass over the examples in random order, in STEPS batches or more."""
        order, batch = self.rng.permutation(len(item)), min(BATCH, -(-len(item) // STEPS))
        context, item = np.column_stack([two, one])[order], item[order]
        for at in range(0, len(item), batch):
            self.step(context[at : at + batch], item[at : at + batch])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of the negative of x, in place."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(like.items(), np.split(x, ends[:-1]), strict=True)}


def fit(learn: DataFrame, items: Items) -> dict[str, np.ndarray]:
    """A pass over all texts (doc_id, text): in each round every task learns from its texts of one part, and the
    parameters of the tasks are averaged, weighted by tokens. The averages are sums by chunk in tasks."""
    spark, p = learn.sparkSession, initial(items)
    form = pa.schema([("chunk", pa.int32()), ("weight", pa.float64()), ("p", pa.binary())])
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((p, items))

        def run(batches, state=state, turn=turn):
            p, items = state.value
            trainer, seen = Trainer(p, items, RATE / (1 + turn), turn), 0
            for examples in _examples(batches, items):
                trainer.learn(*examples)
                seen += len(examples[0])
            if seen:
                flat = _flat(trainer.p)
                for chunk, at in enumerate(range(0, len(flat), CHUNK)):
                    yield table({"chunk": [chunk], "weight": [float(seen)], "p": [flat[at : at + CHUNK].tobytes()]}, form)

        def mean(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for chunk, weight, raw in zip(*(b.column(x).to_pylist() for x in ("chunk", "weight", "p")), strict=True):
                    s = sums.setdefault(chunk, [0.0, 0.0])
                    s[0], s[1] = s[0] + weight, s[1] + weight * np.frombuffer(raw, np.float32).astype(float)
            for chunk, (weight, x) in sums.items():
                yield table({"chunk": [chunk], "weight": [weight], "p": [(x / weight).astype(np.float32).tobytes()]}, form)

        part = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("text")
        kind = "chunk int, weight double, p binary"
        got = part.mapInArrow(run, kind).repartition("chunk").mapInArrow(mean, kind).orderBy("chunk").toArrow()
        if got.num_rows:
            p = _unflat(np.concatenate([np.frombuffer(x, np.float32) for x in got.column("p").to_pylist()]), p)
    return p


def _examples(batches, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """two, one, item of STEPS batches or more at a time, and of what is left."""
    held, n = [], 0
    for b in batches:
        for _, _, row, h, shape in tokens(b.column("text")):
            item = items.find(h, shape)
            held.append((*items.contexts(row, item), item))
            n += len(item)
            if n >= STEPS * BATCH:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Texts whose id's crc32 modulo folds is 0 are held out of the training. Null text is empty; a null doc_id is held
    out; repeated rows count and score each; without training texts all words are unknown. No rows give no rows."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = d.where(fold("doc_id", folds) != 0)
    counted = pa.schema([("h", pa.int64()), ("shape", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            for _, _, _, h, shape in tokens(b.column("text")):
                order = np.argsort(h)
                h = h[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                yield table({"h": h[new].view(np.int64), "shape": shape[order[new]].astype(np.int32), "n": np.diff(np.append(new, len(h)))}, counted)

    counts = written(learn.mapInArrow(count, "h long, shape int, n long").groupBy("h", "shape").agg(F.sum("n").alias("n")))
    end = int(np.uint64(END).astype(np.int64))
    n_shape, v_shape, n_end = np.zeros(SHAPES), np.zeros(SHAPES), 0
    for r in counts.groupBy((F.col("h") == end).alias("end"), "shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        if r["end"]:
            n_end = r["n"]
        else:
            n_shape[r["shape"]], v_shape[r["shape"]] = r["n"], r["v"]
    total, kinds = int(n_shape.sum()) + n_end, int(v_shape.sum()) + (n_end > 0)
    heavy = counts.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(max(3 * SINGLE, int(4 * kinds**0.5))).toArrow()
    heavy_h, heavy_n, heavy_shape = (heavy.column(x).to_numpy() for x in ("h", "n", "shape"))
    n_shape -= np.bincount(heavy_shape, heavy_n, SHAPES)
    v_shape -= np.bincount(heavy_shape, minlength=SHAPES)
    items = Items.of(heavy_h.view(np.uint64), heavy_n, n_end, n_shape, v_shape)
    model = fit(learn, items)
    state = spark.sparkContext.broadcast((model, items))
    text = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    form = pa.schema([("uid", pa.int64()), ("h", pa.int64()), ("tf", pa.int64()), ("text", text)])

    def score(batches):
        """A row a text with the sums over its tokens, and a row for each of its words that aren't items: their counts are left to
        the join. They are rare, so no key of the join is hot; rows of texts are dealt by uid, and have no occurrences of a word."""
        model, items = state.value
        scorer, inside = Scorer(model, items), np.log10((total + 0.1 * (kinds + 1)) / items.mass)
        for b in batches:
            ids, uid = b.column("doc_id"), b.column("uid").to_numpy(zero_copy_only=False)
            for first, last, row, h, shape in tokens(b.column("text"), SCORE_BYTES):
                item = items.find(h, shape)
                value = scorer(*items.contexts(row, item), item) / np.log(10)
                n, c = last - first, items.count[item]
                base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
                other = np.flatnonzero(items.is_shape(item))
                base[other], c[other] = 0, 0
                value[other] += inside[shape[other]]
                sums = [np.bincount(row, x, n) for x in (base, value)]
                known = np.bincount(row, c > 0, n).astype(np.int64)
                columns = (ids.slice(first, n), np.bincount(row, minlength=n), known, *sums)
                texts = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, text, strict=True)], fields=list(text))
                yield table({"uid": uid[first:last], "h": uid[first:last], "tf": np.zeros(n, np.int64), "text": texts}, form)
                if len(other):
                    row, h = row[other], h[other]
                    bits = np.uint64(int(n).bit_length())
                    order = np.argsort(row.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits)
                    row, h = row[order], h[order]
                    # words that agree in the bits compared may lie mixed: their rows are more, the sums the same
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
                    yield table({"uid": uid[first + row[new]], "h": h[new].view(np.int64), "tf": np.diff(np.append(new, len(row))), "text": pa.nulls(len(new), text)}, form)

    d = written(d.withColumn("uid", F.monotonically_increasing_id()))
    rows = d.mapInArrow(score, "uid long, h long, tf long, text struct<doc_id: long, n_tokens: long, n_known: long, base_score: double, score: double>")
    c, zero = F.coalesce("n", F.lit(0)), F.lit(0)
    rare = F.col("tf") * F.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    known = F.when(c > 0, F.col("tf")).otherwise(0)
    sums = {"n_tokens": F.col("text.n_tokens"), "n_known": F.coalesce("text.n_known", zero) + known}
    sums |= {x: F.coalesce(f"text.{x}", zero) + rare for x in ("base_score", "score")}
    scored = rows.join(counts.select("h", "n"), "h", "left").groupBy("uid").agg(F.max("text.doc_id").alias("doc_id"), *(F.sum(x).alias(k) for k, x in sums.items()))
    held = F.col("doc_id").isNull() | (fold("doc_id", folds) == 0)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
