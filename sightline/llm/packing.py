"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens in table order. A window takes from each queue what its share of the window and the
deficit that it carries allow. In closed form: token j of a queue with weight q is due at virtual time (j + p) / q (the
phases p in 0 to 1 differ, so that equal queues don't fall due at once), and windows are cut from the order of those times, so that after any number of windows each queue has had its share to
within a token. A window's part of each queue thus follows from the window's number alone: tasks pack windows on their
own, and deficits carry over windows and partitions exactly. A queue that runs dry leaves its share to the others.

Sources that a mixture names, and all sources where there are few, are queues of their own. Many other sources are
dealt by hash into about as many queues as each of these has sources, and such a queue takes from its sources in the
same way, by the order of due times within it: no source is without a queue, at one token's deviation more."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, ragged, text_slices, word_hashes, written

#: Up to so many sources, each is a queue of the first level.
QUEUES = 256
#: Parts of texts whose ids a task keeps, and slots of its direct look-up.
CACHE, SLOTS = 1_000_000, 1 << 21
#: Rows of queue starts (queues times blocks) that are broadcast; with more, they come by a join.
BROADCAST_ROWS = 1_000_000
_worker: dict = {}
# Classes of bytes: white space, letter, digit, sign, beyond ASCII, apostrophe; and where a text may be cut in front of
# a byte, by the classes before and after. Nothing is cut beside an apostrophe or a byte beyond ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[39] = 1, 1, 2, 4, 5
_CUT = np.array([[(a == 0) != (b == 0) or (a and b and max(a, b) < 4 and (a != b or a == 2)) for b in range(6)] for a in range(6)], bool).ravel()
CASES = "The THE the tHe A a B b Of OF Xy ABCDEFGHIJKLMNOPQRSTUVWXYZ A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"
PROBE = "Don't cut rock'n'roll, (it's 12.5% Été-2024's)... a_b@c.d #x1y2 ''s 'Ll x'S İI é中1² ***.!! we'd"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PartEncoder:
    """Ids of whole texts from ids of their parts, which are kept for later texts. Texts are cut at white space and
    where letters, digits and signs meet; for tokenizers that drop white space and never join across such places this
    equals encoding the text at once. Others are found out by a probe and encode whole texts, as do texts that hold a
    special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or "\n"
        vocabulary = self.tokenizer.get_vocab()
        self.type = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Letters' case makes no difference, so parts that differ in it only share their ids.
        self.folds = self.tokenizer.encode(CASES, add_special_tokens=False).ids == self.tokenizer.encode(CASES.lower(), add_special_tokens=False).ids
        self.clear()
        self.cuts = True
        data = np.frombuffer(PROBE.encode(), np.uint8)
        self.cuts = self.parts(data, np.array([0, len(data)]))[0].tolist() == self.tokenizer.encode(PROBE, add_special_tokens=False).ids

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.slot_key, self.slot_at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.type)

    def code(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words of letters alone are encoded side by side, each up to its word end."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for a in range(0, len(plain), 1000):
            some = plain[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids, self.type)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                for i, x in zip(some, np.split(ids, last[:-1]), strict=True):
                    out[i] = x
            else:
                rest += some
        for a in range(0, len(rest), 20_000):
            some = rest[a : a + 20_000]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, self.type)
        return out

    def places(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each part's ids are kept; parts not met before are encoded."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at = np.where(self.slot_key[slot] == h, self.slot_at[slot], -1).astype(np.int64)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            word, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = np.minimum(np.searchsorted(self.keys, word), max(len(self.keys) - 1, 0))
            known = self.keys[where] == word if len(self.keys) else np.zeros(len(word), bool)
            place = np.where(known, self.at[where] if len(self.at) else 0, -1)
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                ids = self.code([raw[starts[i] : ends[i]].decode() for i in miss[first[new]].tolist()])
                size = np.array([len(x) for x in ids], np.int64)
                place[new] = len(self.start) + np.arange(len(new))
                self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.pool = np.concatenate([self.pool, *ids])
                to = np.searchsorted(self.keys, word[new])
                self.keys, self.at = np.insert(self.keys, to, word[new]), np.insert(self.at, to, place[new])
                free = (word[new] & np.uint64(SLOTS - 1)).astype(np.int64)
                use = self.slot_key[free] == 0
                self.slot_key[free[use]], self.slot_at[free[use]] = word[new][use], place[new][use]
                self.slot_at[free[use]] = self.at[np.searchsorted(self.keys, self.slot_key[free[use]])]  # the last of equal slots stays
            at[miss] = place[back]
        return at

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and their number in each row."""
        if len(self.keys) > CACHE:
            self.clear()
        kind = _KIND[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]] if len(data) else False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        some = kind[starts] != 0
        starts, ends = starts[some], ends[some]
        at = self.places(word_hashes(lower_ascii(data) if self.folds else data, starts, ends), data, starts, ends)
        size = self.size[at] if len(at) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        edge = total[np.searchsorted(starts, offsets)]
        return self.pool[ragged(self.start[at], size)] if len(at) else np.zeros(0, self.type), np.diff(edge)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by end_id, and their number in each row."""
        raw, rows = data.tobytes(), len(offsets) - 1
        whole = [] if self.cuts and not any(x in raw for x in self.specials) else [i for i in range(rows) if not self.cuts or any(x in raw[offsets[i] : offsets[i + 1]] for x in self.specials)]
        ids, n = self.parts(data, offsets) if self.cuts else (np.zeros(0, self.type), np.zeros(rows, np.int64))
        if whole:
            split = np.split(ids, np.cumsum(n)[:-1])
            for i in whole:
                split[i] = np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, self.type)
            ids, n = np.concatenate(split), np.array([len(x) for x in split])
        out = np.full(len(ids) + rows, end_id, self.type)
        body = np.ones(len(out), bool)
        body[np.cumsum(n + 1) - 1] = False
        out[body] = ids
        return out, n + 1


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after another, of so many items each."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.int32()), ("member", pa.int32()), ("block", pa.int64()), ("lead", pa.int64()), ("n", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _worker.get(path) or _worker.setdefault(path, PartEncoder(path))
        block, ahead = TaskContext.get().partitionId(), {}
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                part = b.slice(first, end - first)
                ids, n = encode(data, offsets, end_id)
                key = part.column("queue").to_numpy().astype(np.int64) << 32 | part.column("member").to_numpy()
                lead = np.empty(len(n), np.int64)
                order = np.argsort(key, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                cut = np.flatnonzero(np.diff(key[order], prepend=-1))
                for k, a, z in zip(key[order][cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(n)], strict=True):
                    lead[order[a:z]] = ahead.get(k, 0) + before[a:z] - before[a]
                    ahead[k] = ahead.get(k, 0) + int(n[order[a:z]].sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("queue"), part.column("member"), pa.array(np.full(len(n), block)), pa.array(lead), pa.array(n, pa.int64()), pa.array(np.full(len(n), encode.type == np.uint32)), _binary(ids, n)], schema=schema)

    return run, "doc_id long, queue int, member int, block long, lead long, n long, wide boolean, ids binary"


def taken(want: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens that each queue has given when all have given `want`: rows are wants, columns queues."""
    want = np.minimum(want, totals.sum())
    phase = np.arange(1, len(totals) + 1) * 0.6180339887498949 % 1
    at = lambda v: np.minimum(totals, np.floor(weights * v[:, None] + 1 - phase).astype(np.int64))
    low, high = np.zeros(len(want)), np.full(len(want), ((totals + 1) / weights).max())
    for _ in range(90):
        mid = (low + high) / 2
        under = at(mid).sum(1) <= want
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    given = at(low)
    while len(short := np.flatnonzero(given.sum(1) < want)):
        due = np.where(given[short] < totals, (given[short] + phase) / weights, np.inf)
        given[short, due.argmin(1)] += 1
    return given


def _rank(token: np.ndarray, queue: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """About how many tokens all queues have given when a queue gives this token."""
    return np.minimum(totals, weights * (token / weights[queue])[:, None]).sum(1)


def _pieces(size: int, totals: np.ndarray, weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])

    def one_queue(q: int, first: np.ndarray, n: np.ndarray, member: np.ndarray, sources):
        """For each piece of these texts: row, start, length, window, offset."""
        low, high = first.astype(float), (first + n + 1).astype(float)
        mine, slack = np.zeros(len(n), np.int64), len(totals) + 1
        if sources is not None:
            t, w = sources
            low, high = (_rank(x, member, t, w) + d for x, d in ((low, -2 * len(t) - 2), (high, 2 * len(t) + 2)))
        mine += q
        low = np.maximum(0, (_rank(np.maximum(low, 0), mine, totals, weights) - 2 * slack) // size).astype(np.int64)
        high = ((_rank(high, mine, totals, weights) + 2 * slack) // size).astype(np.int64) + 2
        windows = np.unique(ragged(low, high - low))
        given = taken(windows * size, totals, weights)
        before = np.cumsum(given, 1)[:, q] - given[:, q]
        edges = given[:, [q]] if sources is None else taken(given[:, q], *sources)
        inner = np.cumsum(edges, 1) - edges
        out = []
        for m in np.unique(member):
            rows = np.flatnonzero(member == m)
            edge = edges[:, m]
            a = np.searchsorted(edge, first[rows], "right") - 1
            z = np.searchsorted(edge, first[rows] + n[rows] - 1, "right") - 1
            cell, row = ragged(a, z - a + 1), np.repeat(rows, z - a + 1)
            lo, hi = np.maximum(edge[cell], first[row]), np.minimum(edge[cell + 1], first[row] + n[row])
            some = hi > lo
            row, cell, lo, hi = row[some], cell[some], lo[some], hi[some]
            offset = (before[cell + 1] - before[cell]) + (inner[cell + 1, m] - inner[cell, m]) + lo - edge[cell]
            out.append(np.stack([row, lo - first[row], hi - lo, windows[cell], offset]))
        return np.concatenate(out, 1)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                queue, member, first, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "member", "first", "n"))
                found = []
                for q in np.unique(queue):
                    rows = np.flatnonzero(queue == q)
                    held = part.column("sources")[int(rows[0])].as_py()
                    sources = None if held is None else (np.array([x["m"] for x in held], np.int64), np.array([x["share"] for x in held], float))
                    got = one_queue(int(q), first[rows], n[rows], member[rows], sources)
                    got[0] = rows[got[0]]
                    found.append(got)
                row, start, length, window, offset = np.concatenate(found, 1)
                order = np.lexsort((start, row))
                row, start, length, window, offset = (x[order] for x in (row, start, length, window, offset))
                wide = part.column("wide").to_pylist()
                ids = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32 if w else np.uint16) for x, w in zip(part.column("ids"), wide, strict=True)]).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (start, length, n[row], window, offset)], _binary(ids, length)], schema=schema)

    return run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _queues(sources: DataFrame, named: list[str]) -> DataFrame:
    """(source) distinct -> source, queue, member: named sources and few ones in queues of their own, others by hash."""
    n = sources.count()
    own = F.coalesce(F.col("source").isin(named), F.lit(False)) if named else F.lit(False)
    if n <= QUEUES:
        number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("source")) - 1  # at most QUEUES rows
        return sources.select("source", number.cast("int").alias("queue"), F.lit(0).alias("member"))
    groups = math.isqrt(n - 1) + 1
    place: Column = F.lit(None).cast("int")
    for i, s in enumerate(named):
        place = F.when(F.col("source") == s, F.lit(groups + i)).otherwise(place)
    group = F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int")
    placed = sources.select("source", F.when(own, place).otherwise(group).alias("queue"))
    return placed.withColumn("member", (F.row_number().over(W.partitionBy("queue").orderBy("source")) - 1).cast("int"))


def pack(docs: DataFrame, size: int = 2048, mixture: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, source) -> pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, the
    piece's ids as little-endian unsigned 32-bit).

    Every sequence but the last is full. mixture gives target shares by source ('' for null); by default each source's
    share of all tokens. Sources that a mixture doesn't name come when the named ones have run dry. No row is left out.
    A null or empty text is its end token alone; rows with a null doc_id are packed under null; a repeated doc_id is
    packed once a row; an empty table gives no rows."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    named = sorted(mixture) if mixture else []
    queues = written(_queues(texts.select("source").distinct(), named))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    run, shape = _encode(tokenizer or default_tokenizer(), end_id)
    coded = written(texts.join(few(queues), "source").select("doc_id", "text", "queue", "member").mapInArrow(run, shape))

    sums = written(coded.groupBy("queue", "member", "block").agg(F.sum("n").alias("m")))
    share = F.col("m").cast("double")
    if mixture:
        target = F.lit(0.0)
        for s in named:
            target = F.when(F.col("source") == s, F.lit(float(mixture[s]))).otherwise(target)
        share = F.when(target > 0, target).otherwise(share / F.lit(1e6) / F.sum("m").over(W.partitionBy()))
    whole = sums.groupBy("queue", "member").agg(F.sum("m").alias("m")).join(queues, ["queue", "member"])
    whole = written(whole.select("queue", "member", "m", share.alias("share")))
    tops = {r["queue"]: r for r in whole.groupBy("queue").agg(F.sum("m").alias("m"), F.sum("share").alias("share")).collect()}  # about the root of the number of sources
    width = max(tops, default=0) + 1
    totals, weights = np.zeros(width, np.int64), np.full(width, 1e-12)
    for q, r in tops.items():
        totals[q], weights[q] = r["m"], r["share"]
    weights = np.maximum(weights / weights.sum(), 1e-12)

    part = F.struct("member", "m", (F.col("share") / F.sum("share").over(W.partitionBy("queue"))).alias("share"))
    inner = whole.select("queue", part.alias("s")).groupBy("queue").agg(F.sort_array(F.collect_list("s")).alias("sources")).select("queue", F.when(F.size("sources") > 1, F.col("sources")).alias("sources"))
    ahead = W.partitionBy("queue", "member").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("queue", "member", "block", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("base"))
    placed = coded.join(few(written(base)), ["queue", "member", "block"]).join(few(written(inner)), "queue")
    run, shape = _pieces(size, totals, weights)
    return placed.select("doc_id", "queue", "member", (F.col("base") + F.col("lead")).alias("first"), "n", "wide", "ids", "sources").mapInArrow(run, shape)
