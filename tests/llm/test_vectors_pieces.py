import zlib

import numpy as np
import pytest
import sentencepiece

from sightline.llm import embedding_dedup
from sightline.llm.embedding_dedup import near_vectors
from sightline.llm.sentencepiece_codec import Codec, decode_ids, default_model, encode_texts, fields, read_model


def brute(rows, cosine=0.98):
    rows = [(i, None if x is None or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.array(x, float), lab) for i, x, lab in rows]
    link = {i: set() for i, _, _ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a is not None and a == b and x is not None and y is not None and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                link[i].add(j)
    comp = {}
    for i in sorted(link):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += link[k]
    return link, comp


def test_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    more = [(10_000 + i, [float(c) for c in base + rng.normal(size=64) * 0.09], 3) for i in range(60)] + [(20_000 + i, [float(c) for c in base], 3) for i in range(30)]
    more += [(30_000, None, 3), (30_001, [0.0] * 64, 3), (30_002, [float("nan")] * 64, 3), (30_003, [float(c) for c in base], None), (30_004, [None] * 64, 3), (30_005, [float(c) for c in 7 * base], 3)]
    rows = [tuple(r) for r in v.collect()] + more
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], lab) for i, x, lab in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as x", "2 as rep")
    link, comp = brute(rows)
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    true, found = sum(map(len, link.values())), sum(r.n_links for r in got)
    assert all(r.n_links <= len(link[r.vec_id]) for r in got) and found >= 0.97 * true
    assert sum(r.component_id == comp[r.vec_id] for r in got) >= 0.99 * len(got) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(df.limit(0)).collect() == []


def test_vectors_in_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "OCCUPIED", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "SIDE", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(c) for c in base[i % 40] * (1 + i % 3) + rng.normal(size=16) * 0.12], i % 2) for i in range(900)] + [(900 + i, [float(c) for c in base[i % 2]], 0) for i in range(50)]
    link, comp = brute(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links <= len(link[r.vec_id]) for r in got) and sum(r.n_links for r in got) >= 0.97 * sum(map(len, link.values()))
    assert sum(r.component_id == comp[r.vec_id] for r in got) >= 0.98 * len(got)


def test_vectors_with_repeated_and_null_ids(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.001, 1.0]
    rows = [(1, x, 1), (1, y, 1), (2, [2.0, 0.01, 0.0], 1), (3, [0.01, 3.0, 0.0], 1), (4, z, 1), (4, z, 1), (None, x, 1), (5, x, 2), (6, [1.0, 0.0], 1), (7, [], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]


def unigram_model() -> bytes:
    """The model's own bytes with its kind and scores changed, for the library to read."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    data = open(default_model(), "rb").read()
    _, scores, kinds = read_model(data)
    out, i = b"", 0
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            body = b"\x0a" + varint(len(piece[1])) + piece[1] + b"\x15" + np.float32(scores[i]).tobytes() + b"\x18" + varint(int(kinds[i]))
            i += 1
            out += b"\x0a" + varint(len(body)) + body
        elif number == 2:
            body = value.replace(b"\x18\x02", b"\x18\x01", 1)
            out += b"\x12" + varint(len(body)) + body
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=unigram_model())


TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve café — 中文 \U0001f600\n\ttab", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "\x00\x01", "x\n\ny  z"]


def test_against_library(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    codec = Codec()
    for t, ids in zip(TEXTS + docs, codec.encode(TEXTS + docs), strict=True):
        theirs = library.encode(t)
        if ids.tolist() != theirs:  # sums of 32-bit scores over a whole text round; ours must be as good
            assert len(t) > 1000 and codec.scores[ids].sum(dtype=float) >= codec.scores[theirs].sum(dtype=float) - 1e-3
        assert codec.decode(ids.tolist()) == t


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    coded = encode_texts(docs, ids=True)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.decoded and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in got)
    assert {(r.doc_id, r.text) for r in decode_ids(coded).collect()} == {(i, t or "") for i, t in rows}
    assert encode_texts(docs.limit(0)).collect() == []
