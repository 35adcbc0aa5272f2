import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sightline.llm.common import text_slices
from sightline.llm.packing import PartEncoder, default_tokenizer, pack, taken
from sightline.llm.queries import op8


def whole(rows, pieces, size):
    tk = Tokenizer.from_file(default_tokenizer())
    ids = {d: tk.encode(t or "", add_special_tokens=False).ids + [1] for d, t, _ in rows}
    seen, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert bytes(p.ids) == np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length, p.doc_id))
    for d, x in ids.items():
        at = 0
        for s, n in sorted(seen[d]):
            assert s == at
            at += n
        assert at == len(x)
    fill = {}
    for w, x in windows.items():
        at = 0
        for o, n, _ in sorted(x):
            assert o == at
            at += n
        fill[w] = at
    last = max(fill)
    assert sorted(fill) == list(range(last + 1)) and all(v == size for w, v in fill.items() if w < last) and fill[last] <= size
    return windows, ids


def test_pack(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    windows, ids = whole(rows, pack(docs).collect(), 2048)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in op8(spark, "/root/testdata/sf0.001").collect()}
    assert digests == {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in pack(docs).collect()}
    total = sum(map(len, ids.values()))
    source = {d: s for d, _, s in rows}
    share = defaultdict(int)
    for d, x in ids.items():
        share[source[d]] += len(x)
    for w in range(len(windows) - 1):
        got = defaultdict(int)
        for _, n, d in windows[w]:
            got[source[d]] += n
        assert all(abs(got[s] - 2048 * share[s] / total) <= 2.01 for s in share)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y Ź don't 中 12", "b"), (4, "long " * 3000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5 as n", "6 as block")
    whole(rows, pack(docs, 256).collect(), 256)
    whole(rows, pack(docs, 256, mixture={"a": 0.9, "b": 0.1}).collect(), 256)
    assert pack(docs.limit(0)).collect() == []


def test_queues_keep_their_share():
    totals, weights = np.array([5000, 30, 1200]), np.array([0.5, 0.1, 0.4])
    given = taken(np.arange(62) * 100, totals, weights)
    assert (np.diff(given.sum(1)) == 100).all() and (np.diff(given, axis=0) >= 0).all() and given[3].tolist() == [150, 30, 120]


def shares(rows, windows, sequence):
    source, got = {d: s for d, _, s in rows}, defaultdict(int)
    for _, n, d in windows[sequence]:
        got[source[d]] += n
    return got


def test_many_sources(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i % 7)), f"s{i % 300}") for i in range(900)] + [(900 + i, "a b c " * 60, "s299") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    windows, ids = whole(rows, pack(docs, 256).collect(), 256)
    count = defaultdict(int)
    for d, _, s in rows:
        count[s] += len(ids[d])
    total = sum(count.values())
    for w in list(windows)[:-1]:
        got = shares(rows, windows, w)
        assert all(abs(got[s] - 256 * count[s] / total) <= 3.01 for s in count)
    windows, _ = whole(rows, pack(docs, 256, mixture={"s299": 0.9, "s7": 0.1}).collect(), 256)
    assert all(abs(shares(rows, windows, w)["s299"] - 230) <= 3 for w in range(2))


def test_repeated_and_null_ids(spark):
    rows = [(1, "one two", "a"), (1, "one two", "a"), (1, "other", "b"), (None, "x", "a"), (None, None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((p.doc_id or 0, p.length) for p in got) == [(0, 1), (0, 2), (1, 2), (1, 3), (1, 3)] and {p.sequence_id for p in got} == {0}


def test_parts_equal_whole_texts():
    chance = random.Random(1)
    signs = [*"abcXYZ019 \t\n'.,!?#$%&*-_@()[]<>|/\\\"éÉßİıﬁǅ中文٣²½̈ͅ=≠\xa0\u2003\u200b\x1c\x85", "'s", "'re", "'LL", "<|endoftext|>", " don't "]
    texts = ["".join(chance.choices(signs, k=chance.randint(0, 60))) for _ in range(3000)] + ["word " * 300_000]
    encode = PartEncoder(default_tokenizer())
    assert encode.cuts
    for first, end, data, offsets in text_slices(pa.array(texts)):
        ids, n = encode(data, offsets, 1)
        for i, x in zip(range(first, end), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert x.tolist() == encode.tokenizer.encode(texts[i], add_special_tokens=False).ids + [1]


def test_case_of_letters(tmp_path):
    """A tokenizer that tells cases apart gets its own ids for each of them."""
    from tokenizers import models, pre_tokenizers

    words = ["[UNK]", "The", "the", "THE", "a", "A"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    tokenizer.save(f"{tmp_path}/t.json")
    data = np.frombuffer(b"The the THE a A the", np.uint8)
    ids, n = PartEncoder(f"{tmp_path}/t.json")(data, np.array([0, len(data)]), 9)
    assert ids.tolist() == [1, 2, 3, 4, 5, 2, 9] and n.tolist() == [7]
    assert PartEncoder(default_tokenizer()).folds
