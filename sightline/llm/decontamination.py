"""Benchmark decontamination: texts stream through a generalised suffix automaton of the test items' words.

The automaton knows every run of words of every item. Its state after a word of a text is the longest run of items that
ends there; a run of WINDOW words (or a whole item that is shorter) marks its words as hit. Items are cut into overlapping
segments and dealt over automata of a bounded number of words, each built in one task. Texts pass through one automaton
after another; there is one pass for most benchmarks. A task streams many stretches of its texts side by side, each
started WINDOW - 1 words early, so that every step is a few array operations."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, discard, hash_word, lower_ascii, new_folder, ragged, text_slices, word_hashes, word_spans, written

WINDOW = 10
#: Words of an automaton, about; its arrays take some 60 bytes a word in a task and on their way to it.
PART_WORDS = 250_000
#: Words of a segment of an item; neighbours share WINDOW - 1 words.
SEGMENT_WORDS = 5_000
#: Texts of a slice, and steps of a stretch.
SLICE, STEPS = 4 << 20, 96
SPAN = "array<struct<first:int,end:int,byte_first:int,byte_end:int>>"
_SPANS = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "end", "byte_first", "byte_end")]))


# ---- building


def segments(window: int):
    """(item_id, text) -> item_id, words (of a segment), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("item_id").to_pylist(), []
            for first, end, data, offsets in text_slices(b.column("text")):
                low = lower_ascii(data)
                starts, ends, row = word_spans(low, offsets, ALNUM)
                raw = low.tobytes()
                edge = np.searchsorted(row, np.arange(end - first + 1))
                for i in range(end - first):
                    a, z = int(edge[i]), int(edge[i + 1])
                    for at in range(a, max(z - window + 1, a + (a < z)), SEGMENT_WORDS):
                        some = slice(at, min(at + SEGMENT_WORDS + window - 1, z))
                        out.append((ids[first + i], [raw[x:y] for x, y in zip(starts[some], ends[some], strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.binary())), pa.array([len(x[1]) for x in out], pa.int64())], names=["item_id", "words", "n"])

    return run, "item_id string, words array<binary>, n long"


class Automaton:
    """Arrays of a generalised suffix automaton over segments of items, given as (item, words)."""

    FIELDS = ("hashes", "bytes", "offsets", "link", "length", "keys", "to", "root", "short", "reach", "next_short", "window_state", "item_at", "item_of", "items", "window")

    def __init__(self, **arrays: np.ndarray):
        for k, v in arrays.items():
            setattr(self, k, v)
        self.least = int(self.window) if not self.short.any() else int(self.short[self.short > 0].min())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Automaton:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{k: z[k] for k in cls.FIELDS})

    @classmethod
    def build(cls, parts: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        words = sorted({w for _, x in parts for w in x}, key=hash_word)
        code = {w: i for i, w in enumerate(words)}
        after: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def copy_of(p: int, c: int, q: int) -> int:
            """The state q reached from p by c, split if it also stands for longer runs."""
            if length[q] == length[p] + 1:
                return q
            after.append(dict(after[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new = len(link) - 1
            while p >= 0 and after[p].get(c) == q:
                after[p][c] = new
                p = link[p]
            return new

        def add(last: int, c: int) -> int:
            if c in after[last]:
                return copy_of(last, c, after[last][c])
            after.append({})
            link.append(0)
            length.append(length[last] + 1)
            new, p = len(link) - 1, last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = copy_of(p, c, after[p][c])
            return new

        coded = [(item, [code[w] for w in x]) for item, x in parts]
        for _, x in coded:
            last = 0
            for c in x:
                last = add(last, c)
        n = len(link)
        up, size = np.array(link, np.int64), np.array(length, np.int64)
        short, reach, next_short, window_state = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        names = sorted({item for item, _ in parts if item is not None})
        name = {x: i for i, x in enumerate(names)}
        found: set[tuple[int, int]] = set()
        ends: list[tuple[str | None, list[int]]] = []
        for item, x in coded:
            at, walk = 0, []
            for c in x:
                at = after[at][c]
                walk.append(at)
            ends.append((item, walk))
            if len(x) < window:
                short[walk[-1]] = len(x)
        for v in np.argsort(size, kind="stable")[1:].tolist():
            p = link[v]
            reach[v] = max(reach[p], short[p], window if size[p] >= window else 0)
            next_short[v] = p if short[p] else next_short[p]
            if size[v] >= window:
                window_state[v] = v if size[p] < window else window_state[p]
        for item, walk in ends:
            if item is not None:
                found.update((int(window_state[v]), name[item]) for v in walk[window - 1 :])
                if len(walk) < window:
                    found.add((walk[-1], name[item]))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        edges = sorted((s * len(words) + c, t) for s, d in enumerate(after) if s for c, t in d.items())
        root = np.full(max(len(words), 1), -1)
        for c, t in after[0].items():
            root[c] = t
        return cls(
            hashes=np.array([hash_word(w) for w in words], np.uint64), bytes=np.frombuffer(b"".join(words), np.uint8), offsets=np.cumsum([0, *map(len, words)]), link=up, length=size,
            keys=np.array([e[0] for e in edges], np.int64), to=np.array([e[1] for e in edges], np.int64), root=root, short=short, reach=reach, next_short=next_short, window_state=window_state,
            item_at=pairs[:, 0], item_of=pairs[:, 1], items=np.array(names, np.str_), window=np.array(window),
        )

    # ---- streaming

    def words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code of each word, -1 for those in no item, by hash alone."""
        if not len(starts) or not len(self.hashes):
            return np.full(len(starts), -1)
        h = word_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def differ(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which words aren't the ones that their codes stand for."""
        size = ends - starts
        bad = size != self.offsets[code + 1] - self.offsets[code]
        ok = np.flatnonzero(~bad)
        same = low[ragged(starts[ok], size[ok])] == self.bytes[ragged(self.offsets[code[ok]], size[ok])]
        off = np.bincount(np.repeat(np.arange(len(ok)), size[ok])[~same], minlength=len(ok)) > 0
        bad[ok[off]] = True
        return bad

    def stream(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, state and matched length (cut at a stretch's start, never below the window) wherever a window or a short item ends."""
        if not len(self.hashes) or not len(seq):
            return (np.zeros(0, np.int64),) * 3
        warm, v = int(self.window) - 1, len(self.hashes)
        begin = np.arange(0, len(seq), STEPS)
        state, depth, out = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), []
        marked = np.maximum(self.short, self.reach) > 0
        padded = np.concatenate([np.full(warm, -1), seq, np.full(STEPS, -1)])
        for t in range(STEPS + warm):
            w = padded[begin + t]
            gone = w < 0
            state[gone], depth[gone] = 0, 0
            live = np.flatnonzero(~gone)
            while len(live):
                s, c = state[live], w[live]
                to = np.where(s == 0, self.root[c], -1)
                deep = np.flatnonzero(s)
                if len(deep) and len(self.keys):
                    key = s[deep] * v + c[deep]
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    to[deep] = np.where(self.keys[at] == key, self.to[at], -1)
                got = to >= 0
                state[live[got]] = to[got]
                depth[live[got]] += 1
                live = live[~got]
                back = self.link[state[live]]
                state[live], depth[live] = back, self.length[back]
            if t >= warm:
                hit = np.flatnonzero((depth >= self.window) | marked[state])
                if len(hit):
                    out.append((begin[hit] + t - warm, state[hit], depth[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        pos, state, depth = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = self.size(state, depth) > 0
        return pos[keep], state[keep], depth[keep]

    def size(self, state: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the longest window or short item that ends in a state."""
        own = np.where(depth == self.length[state], self.short[state], 0)
        return np.maximum(np.maximum(self.reach[state], own), np.where(depth >= self.window, self.window, 0))

    def names(self, state: int, depth: int) -> list[str]:
        """Items whose windows, or which themselves, end in a state."""
        at = [int(self.window_state[state])] * bool(depth >= self.window) + [state] * bool(self.short[state] and depth == self.length[state])
        nxt = int(self.next_short[state])
        while nxt >= 0:
            at.append(nxt)
            nxt = int(self.next_short[nxt])
        out = []
        for x in at:
            a, z = np.searchsorted(self.item_at, [x, x + 1])
            out += self.items[self.item_of[a:z]].tolist()
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Of the texts of a slice: words' starts, ends and rows, which words are hit, first word of each row, items of each row."""
        low = lower_ascii(data)
        starts, ends, row = word_spans(low, offsets, ALNUM)
        rows = len(offsets) - 1
        edge = np.searchsorted(row, np.arange(rows + 1))
        code = self.words(low, starts, ends)
        while True:
            seq = np.full(len(code) + rows, -1)
            seq[np.arange(len(code)) + row] = code  # a gap after each row
            pos, state, depth = self.stream(seq)
            of = np.searchsorted(edge + np.arange(rows + 1), pos, "right") - 1
            last, n = pos - of, self.size(state, depth)
            turn = np.zeros(len(code) + 1, np.int64)
            np.add.at(turn, last - n + 1, 1)
            np.add.at(turn, last + 1, -1)
            hit = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
            bad = hit[self.differ(low, starts[hit], ends[hit], code[hit])] if len(hit) else hit
            if not len(bad):
                break
            code[bad] = -1  # another word with the hash of an item's word
        items: list[set[str]] = [set() for _ in range(rows)]
        known: dict[tuple[int, int], list[str]] = {}
        if len(of):
            for i, s, d in np.unique(np.stack([of, state, np.minimum(depth, np.where(depth == self.length[state], depth, self.window))], 1), axis=0).tolist():
                if (s, d) not in known:
                    known[s, d] = self.names(s, d)
                items[i].update(known[s, d])
        covered = np.zeros(len(code), bool)
        covered[hit] = True
        return starts, ends, row, covered, edge, items


def automata(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """benchmark (item_id, text) -> part, automaton: as many as its words need."""
    run, form = segments(window)
    cut = written(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, form))
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_words))

    def build(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        made = Automaton.build([(i, [bytes(w) for w in x]) for i, x in zip(some["item_id"], some["words"], strict=True)], window)
        return pd.DataFrame({"part": [key[0]], "automaton": [made.dump()]})

    dealt = cut.dropDuplicates(["item_id", "words"]).withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).cast("int"))
    return written(dealt.groupBy("part").applyInPandas(build, "part int, automaton binary"))


def _pass(raw, more: bool, text: bool):
    """One pass of texts through one automaton. more: spans and items of earlier passes are in the batch."""
    form = pa.schema([("doc_id", pa.int64()), *[("text", pa.string())] * text, ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton.load(raw.value)
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text"), SLICE):
                starts, ends, row, hit, edge, items = made.scan(data, offsets)
                part = b.slice(first, end - first)
                if more:
                    for i, (spans, old) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        items[i].update(old)
                        for s in spans:
                            hit[edge[i] + s["first"] : edge[i] + s["end"]] = True
                at = np.flatnonzero(hit)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
                a = at[new]
                z = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] if len(at) else at
                of = row[a]
                values = [a - edge[of], z + 1 - edge[of], starts[a] - offsets[of], ends[z] - offsets[of]] if len(a) else [np.zeros(0)] * 4
                list_at = np.searchsorted(of, np.arange(end - first + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(list_at, pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in values], fields=list(_SPANS.value_type)))
                n_hit = np.bincount(row[at], minlength=end - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column("text")] * text, pa.array(np.diff(edge), pa.int64()), pa.array(n_hit, pa.int64()), spans.cast(_SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=form)

    return run, "doc_id long, " + "text string, " * text + f"n_words long, n_hit long, spans {SPAN}, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, text: bool = False) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, (text,) n_words, n_hit, spans, items: runs of hit words as
    words and bytes from 0, and ids (as text) of the items with a window in the text.

    Words are letters, digits and characters beyond ASCII, A-Z in lower case. Null and empty texts have no words and no
    hits; items without words match nothing; windows of items without id are hit but named by none; repeated rows
    give equal rows; a repeated item is one; an empty table of items hits nothing, one of documents gives no rows."""
    spark = docs.sparkSession
    made = automata(benchmark, window, part_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [r[0] for r in made.select("part").orderBy("part").collect()]
    folder = None
    for i, part in enumerate(parts or [-1]):
        one = made.where(F.col("part") == part).first()  # an automaton of bounded size, one at a time
        raw = spark.sparkContext.broadcast(bytes(one["automaton"]) if one else Automaton.build([], window).dump())
        last = i >= len(parts) - 1
        run, form = _pass(raw, i > 0, text or not last)
        rows = rows.mapInArrow(run, form)
        if not last:
            old, folder = folder, new_folder(spark)
            rows = written(rows, folder)
            raw.unpersist()
            if old:
                discard(spark, old)
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = WINDOW, most_share: float = 0.5) -> DataFrame:
    """doc_id, text of the documents without their spans of most_words hit words or more; documents of which more than
    most_share of the words is hit are left out. Edge cases as in contamination; a null text stays null."""
    found = contamination(docs, benchmark, window, text=True).where(F.col("n_hit") <= most_share * F.col("n_words"))
    cut = F.filter("spans", lambda s: s["end"] - s["first"] >= most_words)
    raw = F.col("text").cast("binary")

    def piece(i: Column) -> Column:
        start = F.coalesce(F.get("cut", i - 1)["byte_end"], F.lit(0))
        return F.substring(raw, start + 1, F.coalesce(F.get("cut", i)["byte_first"], F.octet_length("text")) - start)

    pieces = F.transform(F.sequence(F.lit(0), F.size("cut")), piece)
    joined = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x))
    return found.withColumn("cut", cut).select("doc_id", F.when(F.size("cut") == 0, F.col("text")).otherwise(joined.cast("string")).alias("text"))
