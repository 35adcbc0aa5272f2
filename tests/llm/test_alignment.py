import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sightline.llm.alignment import Aligner, align_texts, alignment_counts, byte_of_letter, default_tokenizers, merge_starts, overlaps

TEXTS = [
    (1, "Hello  world, it's Été 2024!\n\n\tTabs and  spaces  \nend "), (2, None), (3, ""), (4, " "), (5, "<s> <unk> <|endoftext|> </s> <0x41>"), (6, "a ▁ b▁c"), (7, "中文字符 мир ﬁ ①  x　y \x1c z"),
    (8, "\nline"), (9, "word " * 4000 + "x" * 500), (1, "Hello  world, it's Été 2024!\n\n\tTabs and  spaces  \nend "), (None, "don't"), (10, "a\r\nb \r\n c"), (11, "é è ß ÿ Ā ſ\nİ́ q"), (12, "   three"),
]


def brute(rows):
    """Every document by itself, every pair of tokens compared."""
    a_path, b_path = default_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = byte_of_letter()
    docs = []
    for doc, text in rows:
        one = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ra = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            rb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
            if b"".join(ra) == b"".join(rb) == (" " + text).encode():
                ea, eb = np.cumsum([len(x) for x in ra]).tolist(), np.cumsum([len(x) for x in rb]).tolist()
                links, j = [], 0
                for i in range(len(ia)):
                    start = ea[i - 1] if i else 0
                    while j and (eb[j - 1] if j else 0) > start:
                        j -= 1
                    while eb[j] <= start:
                        j += 1
                    k = j
                    while k < len(ib) and (eb[k - 1] if k else 0) < ea[i]:
                        links.append((i, k))
                        k += 1
                groups, i, k = [], 0, 0
                for e in sorted(set(ea) & set(eb)):
                    ii, kk = ea.index(e) + 1 if e < ea[-1] else len(ea), eb.index(e) + 1 if e < eb[-1] else len(eb)
                    groups.append((ia[i:ii], ib[k:kk]))
                    i, k = ii, kk
                one = [ia, ib, groups, [(ia[x], ib[y]) for x, y in links]]
        docs.append((doc, one))
    count = Counter(p for _, one in docs if one for p in set(one[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc, one in docs:
        if not one:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in one[2])
        out.append((doc, len(one[0]), len(one[1]), len(one[2]), len(one[3]), sum(count[p] == best[p[0]] for p in one[3]), sum(count[p] for p in one[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), docs


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pairs string")


@pytest.mark.parametrize("frequent", [10**6, 20, 0])
def test_against_brute_force(spark, frequent):
    """All counts broadcast, some, or none of them: the rest comes by a join."""
    rows = TEXTS + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    got = alignment_counts(frame(spark, rows).repartition(3), frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)[0]


def test_groups_and_edges(spark):
    want = brute(TEXTS)[1]
    got = align_texts(frame(spark, TEXTS).coalesce(1)).collect()
    for (doc, one), r in zip(want, got, strict=True):
        assert r.doc_id == doc and [r.a_ids, r.b_ids] == (one[:2] if one else [[], []])
        a, b = [0, *r.a_ends], [0, *r.b_ends]
        assert [(r.a_ids[a[i] : a[i + 1]], r.b_ids[b[i] : b[i + 1]]) for i in range(len(r.a_ends))] == (one[2] if one else [])
    empty = frame(spark, [])
    assert align_texts(empty).count() == 0 == alignment_counts(empty).count()


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces(work):
    """Pieces of any size give the overlaps of the whole merge, stitched where equal ends fall on both sides of a cut."""
    r = np.random.default_rng(work)
    for _ in range(30):
        n = int(r.integers(1, 60))
        a, b = (np.append(np.sort(r.choice(np.arange(1, n), int(r.integers(0, n)), replace=False)), n) for _ in range(2))
        i, j = merge_starts(a, b, work)
        assert (i + j == np.arange(0, len(a) + len(b), work)).all()
        la, lb, ga, gb = overlaps(a, b, work)
        start = lambda e, k: e[k - 1] if k else 0
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(start(a, x), start(b, y)) < min(a[x], b[y])}
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist(), strict=True)) == want
        assert a[ga].tolist() == b[gb].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_equal_hashes_of_parts(spark):
    """A part taken for another one, as by an equal hash, is found out by its bytes."""
    align = Aligner(*default_tokenizers())
    data, offsets = np.frombuffer(b"one two", np.uint8), np.array([0, 7])
    want = align(data, offsets)
    align.known = {h: (i + 1) % 2 for h, i in align.known.items()}
    got = align(data, offsets)
    assert got.a.tolist() == want.a.tolist() and got.b.tolist() == want.b.tolist() and got.link_a.tolist() == want.link_a.tolist()
