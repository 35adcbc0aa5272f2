"""Cross-tokenizer alignment: the tokens of two tokenizers (A byte-level BPE, B pieces) over the same bytes.

The ends of A's and B's tokens are two sorted lists. Merging them gives every stretch between neighbouring ends, which is
one overlap of an A and a B token; an end that both have closes a group. The merge is cut into pieces of equal work:
on each diagonal of the two lists a binary search finds how many ends of each the merge has taken there, so that pieces
run on their own, whatever document their ends belong to; an end of A that the next piece meets as an end of B is
stitched at the boundary. Texts are encoded from parts that no token crosses, whose ids a task keeps, and every text's
token bytes are compared with it. Documents' counts of id pairs are added up by Spark; frequent pairs come back to the
tasks as a table of bounded size, the others, which few documents hold, by a join."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, ragged, text_slices, word_hashes, written

#: Parts of texts whose ids a task keeps; ends that one piece of the merge takes.
CACHE, WORK = 400_000, 1 << 16
#: Pairs whose counts are broadcast, at most; the others come by a join.
FREQUENT = 1_000_000
#: Pairs that a task adds up before it passes them on.
HELD = 4_000_000
_worker: dict = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """Bytes by the letters that byte-level BPE writes for them: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of parts of texts, and the bytes of each id."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.start[ids], self.size[ids])]


class ByteSide(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary, letters = self.tokenizer.get_vocab(), byte_of_letter()
        raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(raw)
        with open(path, encoding="utf-8") as f:
            before = json.load(f).get("pre_tokenizer") or {}
        #: Its pattern never joins what stands before white space with what follows.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        own = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        super().__init__(own)
        self.space = self.model.piece_to_id("▁")
        #: No piece goes on over a space or holds a line break.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not self.model.is_byte(i))

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that begin with the space that the model adds, or with a line break, before which its space goes."""
        got = self.model.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [g[1:] if p[0] != " " and g[:1] == [self.space] else g for p, g in zip(parts, got, strict=True)]


class Pool:
    """Ids of parts met before."""

    def __init__(self):
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, new: list[list[int]]) -> None:
        size = np.array([len(x) for x in new], np.int64)
        flat = np.fromiter((i for x in new for i in x), np.int32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, flat])

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[ragged(self.start[at], self.size[at])], self.size[at]


def merge_starts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a and of b that the merge has taken at every work-th step, by binary searches on the diagonals; of equal ends, a's comes first."""
    d = np.arange(0, len(a) + len(b), work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while len(go := np.flatnonzero(low < high)):
        mid = (low[go] + high[go]) // 2
        first = a[mid] <= b[d[go] - mid - 1]
        low[go], high[go] = np.where(first, mid + 1, low[go]), np.where(first, high[go], mid)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of ends: the pairs of tokens that overlap, and the pairs of tokens that end together."""
    i0, j0 = merge_starts(a, b, work)
    i1, j1 = np.append(i0[1:], len(a)), np.append(j0[1:], len(b))
    out: list[tuple] = []
    for i, ii, j, jj in zip(i0.tolist(), i1.tolist(), j0.tolist(), j1.tolist(), strict=True):
        own, other = np.arange(i, ii), np.arange(j, jj)
        partner = j + np.searchsorted(b[j:jj], a[i:ii], "left")
        cover = i + np.searchsorted(a[i:ii], b[j:jj], "right")
        # an end of b that a has too was taken with a's, maybe by the piece before
        both = np.zeros(jj - j, bool)
        some = np.flatnonzero(cover > 0)
        both[some] = a[cover[some] - 1] == b[j:jj][some]
        out.append((np.concatenate([own, cover[~both]]), np.concatenate([partner, other[~both]]), cover[both] - 1, other[both]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


@dataclass
class Aligned:
    """Tokens of the texts of a slice, and how they overlap."""

    a: np.ndarray  # ids
    b: np.ndarray
    row_a: np.ndarray  # texts of the tokens
    row_b: np.ndarray
    link_a: np.ndarray  # overlaps as positions in a and b
    link_b: np.ndarray
    group_a: np.ndarray  # last token of each group
    group_b: np.ndarray


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pools = Pool(), Pool()

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of parts: texts are cut before a space or line break that follows what is surely no white space."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.a.cuts and self.b.cuts and len(data) > 2:
            before, lead = data[1:-1], data[:-2]
            solid = ((before > 32) & (before < 127)) | ((before >= 128) & (lead >= 0xC3) & (lead <= 0xDF))
            cut[2:-1] |= ((data[2:] == 32) | (data[2:] == 10)) & solid
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Of both sides: ids of all rows, and the number in each. Rows hold the leading space; a row whose token bytes aren't its own has none."""
        if len(self.known) > CACHE:
            self.clear()
        rows = len(offsets) - 1
        starts, ends = self.parts(data, offsets)
        unit, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.array([self.known.get(h, -1) for h in unit.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            texts = [raw[starts[i] : ends[i]].decode(errors="replace") for i in first[new].tolist()]
            at[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(unit[new].tolist(), at[new].tolist(), strict=True))
            for side, pool in zip((self.a, self.b), self.pools, strict=True):
                for k in range(0, len(texts), 20_000):
                    pool.add(side.encode(texts[k : k + 20_000]))
        row = np.searchsorted(offsets, starts, "right") - 1
        out, wrong = [], np.zeros(rows, bool)
        for side, pool in zip((self.a, self.b), self.pools, strict=True):
            ids, n = pool.get(at[back]) if len(at) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            of = np.repeat(row, n)
            wrong |= self.differ(side, ids, of, data, offsets)
            out.append((ids, of))
        if not wrong.any():
            return tuple((ids, np.bincount(of, minlength=rows)) for ids, of in out)
        raw = data.tobytes()
        both: list[list[list[int]]] = [[], []]
        edge = [np.searchsorted(of, np.arange(rows + 1)) for _, of in out]
        for r in range(rows):
            got = [ids[e[r] : e[r + 1]].tolist() for (ids, _), e in zip(out, edge, strict=True)]
            if wrong[r]:  # a part's hash met twice, or bytes that no token spells: the text as a whole decides
                whole = raw[offsets[r] : offsets[r + 1]]
                got = [s.encode([whole.decode(errors="replace")])[0] for s in (self.a, self.b)]
                if any(s.spelled(np.array(g, np.int64)).tobytes() != whole for s, g in zip((self.a, self.b), got, strict=True)):
                    got = [[], []]
            for k in (0, 1):
                both[k].append(got[k])
        return tuple((np.array([i for x in side for i in x], np.int32), np.array([len(x) for x in side], np.int64)) for side in both)

    def differ(self, side: Side, ids: np.ndarray, of: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose tokens' bytes aren't the row's."""
        rows = len(offsets) - 1
        n = np.bincount(of, side.size[ids], minlength=rows).astype(np.int64)
        wrong = n != np.diff(offsets)
        same = ~wrong[of]
        spelled = side.spelled(ids[same])
        own = data[ragged(offsets[:-1][~wrong], np.diff(offsets)[~wrong])]
        off = np.flatnonzero(spelled != own)
        if len(off):
            good = np.flatnonzero(~wrong)
            wrong[good[np.searchsorted(np.cumsum(n[good]), off, "right")]] = True
        return wrong

    def __call__(self, data: np.ndarray, offsets: np.ndarray, work: int = WORK) -> Aligned:
        full = np.flatnonzero(np.diff(offsets) > 0)  # texts without bytes have no tokens
        spaced = np.insert(data, offsets[full], 32)
        (a, n_a), (b, n_b) = self.tokens(spaced, offsets + np.searchsorted(full, np.arange(len(offsets))))
        rows = np.arange(len(offsets) - 1)
        links = overlaps(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]), work)
        return Aligned(a, b, np.repeat(rows, n_a), np.repeat(rows, n_b), *links)


def group_texts(x: Aligned, rows: int) -> list[bytes]:
    """a1,a2|b1;a3|b2,b3 of each text."""
    group_of_a, group_of_b = np.searchsorted(x.group_a, np.arange(len(x.a))), np.searchsorted(x.group_b, np.arange(len(x.b)))
    n = len(x.a) + len(x.b)
    at_a = np.arange(len(x.a)) + np.append(0, x.group_b + 1)[group_of_a]
    at_b = np.arange(len(x.b)) + (x.group_a + 1)[group_of_b]
    ids, mark, row = np.empty(n, np.int64), np.full(n, ord(","), np.uint8), np.empty(n, np.int64)
    ids[at_a], ids[at_b], row[at_a], row[at_b] = x.a, x.b, x.row_a, x.row_b
    mark[at_a[x.group_a]], mark[at_b[x.group_b]] = ord("|"), ord(";")
    digits = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[ends - 1] = mark
    left = ids.copy()
    for k in range(int(digits.max(initial=0))):
        some = np.flatnonzero(digits > k)
        out[ends[some] - 2 - k] = left[some] % 10 + 48
        left[some] //= 10
    edge = np.searchsorted(row, np.arange(rows + 1))
    byte = np.append(0, ends)[edge]
    raw = out.tobytes()
    return [raw[a : max(a, z - 1)] for a, z in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]


def _aligner(paths: tuple[str, str]) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _worker.get(paths) or _worker.setdefault(paths, Aligner(*paths))


def _slices(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Aligned, int]]:
    align = _aligner(paths)
    for b in batches:
        for first, end, data, offsets in text_slices(b.column("text")):
            yield b.slice(first, end - first), align(data, offsets), end - first


def align_texts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, a_ids, b_ids, a_ends, b_ends: the tokens, and how many of A's and B's have come at the end of each group.

    Null and empty texts, and texts that a tokenizer doesn't spell byte for byte, have no tokens; repeated rows give
    equal rows; an empty table gives no rows."""
    paths, names = paths or default_tokenizers(), ("a_ids", "b_ids", "a_ends", "b_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, rows in _slices(batches, paths):
            cols = []
            for values, row in ((x.a, x.row_a), (x.b, x.row_b), (x.group_a, x.row_a[x.group_a]), (x.group_b, x.row_b[x.group_b])):
                cols.append((values, np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)))
            for k in (2, 3):  # counts from 1 within the text
                values, edge = cols[k]
                cols[k] = values + 1 - np.repeat(cols[k - 2][1][:-1], np.diff(edge)), edge
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.ListArray.from_arrays(e, pa.array(v, pa.int32())) for v, e in cols]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in names))


def _tally(paths: tuple[str, str]):
    """(doc_id, text) -> a row number, counts, digest, and the document's distinct pairs (differences of their sorted numbers) with their links."""
    form = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        wide = len(_aligner(paths).b.size)
        for b, x, rows in _slices(batches, paths):
            count = lambda row: np.bincount(row, minlength=rows)  # noqa: B023, E731
            row = x.row_a[x.link_a]
            pair, times = np.unique(row << 40 | (x.a[x.link_a].astype(np.int64) * wide + x.b[x.link_b]), return_counts=True)
            edge = np.searchsorted(pair, np.arange(rows + 1) << 40)
            pair &= (1 << 40) - 1
            steps = np.diff(pair, prepend=0)
            steps[edge[:-1][np.diff(edge) > 0]] = pair[edge[:-1][np.diff(edge) > 0]]
            cut = lambda v: [v[p:q].tobytes() for p, q in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]  # noqa: B023, E731
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, rows)]
            values = [np.arange(rid, rid + rows), None, count(x.row_a), count(x.row_b), count(x.row_a[x.group_a]), count(row), digest, cut(steps.astype("<u4")), cut(times.astype("<u4"))]
            rid += rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id") if v is None else pa.array(v, f.type) for v, f in zip(values, form, strict=True)], schema=form)

    return run, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and links of each row of pairs and times."""
    n = np.array([len(x) // 4 for x in b.column("pairs").to_pylist()], np.int64)
    steps = np.frombuffer(b"".join(b.column("pairs").to_pylist()), "<u4").astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(n) - n
    base = np.zeros(len(n), np.int64)
    some = n > 0
    base[some] = total[first[some]] - steps[first[some]]
    return np.repeat(np.arange(len(n)), n), total - np.repeat(base, n), np.frombuffer(b"".join(b.column("times").to_pylist()), "<u4").astype(np.int64)


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each pair, added up within the task."""
    held, n = [], 0

    def added():
        pair, count = np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[cut], np.add.reduceat(count, cut) if len(cut) else count

    for b in batches:
        pair, count = np.unique(_pairs(b)[1], return_counts=True)
        held.append((pair, count))
        n += len(pair)
        if n > HELD:
            held = [added()]
            n = len(held[0][0])
            if n > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names=["pair", "n"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in added()], names=["pair", "n"])


def alignment_counts(docs: DataFrame, paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; edge cases as in align_texts."""
    paths = paths or default_tokenizers()
    spark = docs.sparkSession
    run, form = _tally(paths)
    tally = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, form), new_folder(spark))
    wide = len(PieceSide(paths[1]).size)
    counts = tally.select("pairs", "times").mapInArrow(_documents_of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts)
    most = counts.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n").alias("best"))  # one row an id of A
    sizes = {r[0]: r[1] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("k")).agg(F.count("*")).collect()}
    least = next(k for k in range(64) if sum(n for j, n in sizes.items() if j >= k) <= frequent)
    known = counts.where(F.col("n") >= (1 << least)).toArrow()
    best = most.toArrow()
    order = np.argsort(known["pair"].to_numpy())
    top = np.zeros(int(max(best["a"].to_numpy(), default=0)) + 1, np.int64)
    top[best["a"].to_numpy()] = best["best"].to_numpy()
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy()[order], known["n"].to_numpy()[order], top))

    def lookup(b: pa.RecordBatch):
        pairs, n, top = shared.value
        row, pair, times = _pairs(b)
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        got = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
        return row, pair, times, got, np.where(got, n[at] if len(n) else 0, 0), top[pair // wide]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, times, got, n, best = lookup(b)
            add = lambda v: np.bincount(row, v, minlength=b.num_rows).astype(np.int64)  # noqa: B023, E731
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, row, n * times)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(add(times * (got & (n == best))), pa.int64()), pa.array(total), b.column("groups_sha256")], names=["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    scored = tally.mapInArrow(score, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    if least == 0:
        return scored.drop("rid")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pair, times, got, _, best = lookup(b)
            rid = b.column("rid").to_numpy()
            some = ~got
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[row[some]], pair[some], times[some], best[some])], names=["rid", "pair", "times", "best"])

    # each of these pairs is in fewer than 2^least documents
    rare = tally.select("rid", "pairs", "times").mapInArrow(rest, "rid long, pair long, times long, best long")
    rare = rare.join(counts.where(F.col("n") < (1 << least)).hint("shuffle_hash"), "pair")
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    joined = scored.join(rare, "rid", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_best", "_best"), ("count_sum", "_sum"))], "groups_sha256")
