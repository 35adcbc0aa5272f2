"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text's spaces become whitespace markers, one more goes before it. No piece holds a marker after another character,
so runs of markers with what follows are segmented on their own; equal segments of a slice are segmented once, all of
them together, position by position. Characters without a piece become byte pieces."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, word_hashes

MARK = "▁".encode()
PENALTY = 10.0
SLICE = 4 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


def read_model(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces, log scores and kinds (1 normal, 6 byte, others special). Models of merge ranks get Zipf's log scores,
    as their scores are no probabilities."""
    pieces, scores, kinds, merges = [], [], [], False
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append(piece[1])
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, 1))
        elif number == 2:
            merges = dict(fields(value)).get(3, 1) == 2
    kinds, scores = np.array(kinds), np.array(scores, np.float32)
    if merges:
        rank = np.maximum(-scores, 0)
        scores = np.where(kinds == 1, -np.log(rank + 1) - np.log(np.log(len(pieces) + 1)), 0).astype(np.float32)
    return pieces, scores, kinds


class DoubleArray:
    """check[base[s] + byte + 1] == s leads on; value is the piece that ends in a state, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys:
            s = 0
            for b in key:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][b]
            ends[s] = value
        size = sum(max(c) - min(c) + 2 for c in children if len(c) > 1) + len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used = bytearray(size)
        used[0] = 1
        place, free, top = {0: 0}, 257, 0
        self.value[0] = ends[0]
        queue = [0]
        for s in queue:
            codes = sorted(children[s])
            if not codes:
                continue
            while used[free]:
                free += 1
            if len(codes) == 1:  # fills a gap
                b = max(free - codes[0] - 1, 0)
                while used[b + codes[0] + 1]:
                    b += 1
            else:  # goes behind all others
                b = max(top - codes[0], 0)
            top = max(top, b + codes[-1] + 1)
            self.base[place[s]] = b
            for c in codes:
                to = b + c + 1
                used[to] = 1
                self.check[to], self.value[to] = place[s], ends[children[s][c]]
                place[children[s][c]] = to
                queue.append(children[s][c])


class Codec:
    def __init__(self, path: str | None = None, data: bytes | None = None):
        if data is None:
            with open(path or default_model(), "rb") as f:
                data = f.read()
        self.pieces, self.scores, kinds = read_model(data)
        normal = np.flatnonzero(kinds == 1)
        self.trie = DoubleArray([(self.pieces[i], int(i)) for i in normal])
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == 6):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.out = [bytes([int(p[3:5], 16)]) if k == 6 else p if k == 1 else b"" for p, k in zip(self.pieces, kinds.tolist(), strict=True)]
        self.is_byte = kinds == 6
        self.unknown = np.float32(self.scores[normal].min() - PENALTY)
        self.apart = all(MARK not in p.lstrip(MARK) or p.lstrip(MARK).find(MARK) < 0 for p in (self.pieces[i] for i in normal))

    def segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of the segments data[offsets[u]:offsets[u + 1]]: ids, and their number by segment."""
        count, length = len(offsets) - 1, np.diff(offsets)
        owner = np.repeat(np.arange(count), length)
        rel = np.arange(len(data)) - offsets[owner]
        slot = offsets[:-1] + np.arange(count)  # a segment has a place for each byte, and one for its end
        starts = np.flatnonzero(data & 0xC0 != 0x80)
        lead = data[starts]
        chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        end = offsets[1:][owner]
        at, state, k = starts, np.zeros(len(starts), np.int64), 0
        found = [[], [], []]
        while len(at):
            to = self.trie.base[state] + data[at + k] + 1
            ok = self.trie.check[to] == state
            at, state, k = at[ok], to[ok], k + 1
            hit = self.trie.value[state] >= 0
            for x, y in zip(found, (at[hit], np.full(int(hit.sum()), k), self.trie.value[state[hit]]), strict=True):
                x.append(y)
            more = at + k < end[at]
            at, state = at[more], state[more]
        m_at, m_len, m_id = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        single = np.zeros(len(data), bool)
        char_at = np.zeros(len(data), np.int64)
        char_at[starts] = chars
        single[m_at[m_len == char_at[m_at]]] = True
        lost = ~single[starts]
        u_at = starts[lost]
        m_at, m_len, m_id = np.concatenate([m_at, u_at]), np.concatenate([m_len, chars[lost]]), np.concatenate([m_id, np.full(len(u_at), -1)])
        order = np.lexsort((m_id < 0, rel[m_at]))
        m_at, m_len, m_id = m_at[order], m_len[order], m_id[order]
        score = np.where(m_id >= 0, self.scores[m_id], self.unknown).astype(np.float32)
        best = np.full(len(data) + count, -np.inf, np.float32)
        came, with_id = np.zeros(len(best), np.int64), np.full(len(best), -2, np.int64)
        best[slot] = 0
        source = m_at + owner[m_at]
        for a, z in zip(*_runs(rel[m_at]), strict=True):
            s, t = source[a:z], source[a:z] + m_len[a:z]
            new = best[s] + score[a:z]
            wins = new > best[t]
            t = t[wins]
            best[t], came[t], with_id[t] = new[wins], s[wins], m_id[a:z][wins]
        seg, cur = np.arange(count), slot + length
        active = length > 0
        seg, cur = seg[active], cur[active]
        got = [[], [], [], []]
        while len(seg):
            before = came[cur]
            for x, y in zip(got, (seg, before, with_id[cur], cur - before), strict=True):
                x.append(y)
            on = before > slot[seg]
            seg, cur = seg[on], before[on]
        g_seg, g_at, g_id, g_len = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
        order = np.argsort(g_at)
        g_seg, g_at, g_id, g_len = g_seg[order], g_at[order], g_id[order], g_len[order]
        times = np.where(g_id < 0, g_len, 1)
        ids = np.repeat(g_id, times)
        from_bytes = ids < 0
        raw = ragged(g_at[g_id < 0] - g_seg[g_id < 0], g_len[g_id < 0])
        ids[from_bytes] = self.byte_ids[data[raw]]
        return ids, np.bincount(g_seg, times, count).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [MARK + t.encode().replace(b" ", MARK) if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in marked])]).astype(np.int64)
        if not len(data):
            return [np.zeros(0, np.int64) for _ in texts]
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.apart:
            mark = np.zeros(len(data) + 3, bool)
            mark[3:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
            first |= mark[3:] & ~mark[:-3]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        _, kept, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[kept]
        ids, n = self.segment(data[ragged(starts[kept], size)], np.concatenate([[0], np.cumsum(size)]))
        at = np.cumsum(n) - n
        flat = ids[ragged(at[back], n[back])]
        owner = np.searchsorted(offsets, starts, "right") - 1
        per = np.bincount(owner, n[back], len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per)[:-1])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.out[i] for i in ids])
        return raw.removeprefix(MARK).replace(MARK, b" ").decode("utf-8", "replace")


def _runs(keys: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    if not len(keys):
        return [], []
    return [0, *edge.tolist()], [*edge.tolist(), len(keys)]


_codecs: dict = {}


def encode_texts(docs: DataFrame, model: str | None = None, ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_bytes (byte pieces), ids_crc32 (unsigned 32-bit ids, little-endian),
    decoded (the decoded text equals the text) and, if asked for, ids.

    Null and empty texts have no pieces and decode to an empty text. Rows with a null doc_id keep it; repeated rows
    give equal rows; an empty table gives no rows. Texts that hold the whitespace marker itself decode to a space."""
    path = model or default_model()
    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("decoded", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * ids
    schema = pa.schema(names)

    def run(batches):
        codec = _codecs.get(path) or _codecs.setdefault(path, Codec(path))
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) < SLICE):
                    size += len(texts[end])
                    end += 1
                part = texts[first:end]
                coded = codec.encode(part)
                cols = [[len(x) for x in coded], [int(codec.is_byte[x].sum()) for x in coded], [zlib.crc32(x.astype("<u4")) for x in coded], [codec.decode(x.tolist()) == t for x, t in zip(coded, part, strict=True)]] + [[x.astype(np.int32) for x in coded]] * ids
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), *[pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)
                first = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, decoded boolean" + ", ids array<int>" * ids)


def decode_ids(coded: DataFrame, model: str | None = None) -> DataFrame:
    """coded (doc_id, ids) -> doc_id, text. Null ids give an empty text."""
    path = model or default_model()

    def run(batches):
        codec = _codecs.get(path) or _codecs.setdefault(path, Codec(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
