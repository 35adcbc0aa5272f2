"""Each stage of the pipeline against brute force on a small table, and rows that are odd."""

import re
from collections import defaultdict

import corpus_pipeline
from sightline.llm.common import load, written
from sightline.llm.ordinal_quality import score_quality
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_packing import whole
from tests.llm.test_quality_rules import brute as counts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ruled(rows):
    """doc_id -> text without boilerplate, of the documents that the rules keep."""
    texts, out = defaultdict(set), {}
    plain = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" "))
    for _, t, s in rows:
        for x in t.split("\n"):
            texts[s, plain(x)].add(t)
    for d, t, s in rows:
        often = [plain(x) != "" and len(texts[s, plain(x)]) > 25 for x in t.split("\n")]
        n, _, _, _, repeats = counts(t)
        lost = sum(len(plain(x).split(" ")) for x, o in zip(t.split("\n"), often, strict=True) if o)
        if n >= 50 and 100 * repeats <= 50 * n and 100 * lost <= 80 * n:
            out[d] = "\n".join(x for x, o in zip(t.split("\n"), often, strict=True) if not o) if any(often) else t
    return out


def test_stages_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram jaccard join", "packing"]
    classify, rules, one, pack = (f for _, f in corpus_pipeline.STAGES)
    first = written(classify(spark, docs, SF))
    assert first.columns == COLUMNS
    kept = {r.doc_id for r in score_quality(docs, load(spark, SF, "labels")).collect() if r.keep}
    assert {r.doc_id for r in first.collect()} == kept and kept
    second = written(rules(spark, first, SF))
    assert second.columns == COLUMNS
    left = ruled([(r.doc_id, r.text, r.source) for r in first.collect()])
    assert {r.doc_id: r.text for r in second.collect()} == left
    third = written(one(spark, second, SF))
    assert third.columns == COLUMNS
    assert {r.doc_id for r in third.collect()} == {d for d, _, c in groups(list(left.items()), 5, 8, 10) if d == c}
    rows = [(r.doc_id, r.text, r.source) for r in third.collect()]
    whole(rows, pack(spark, third, SF).collect(), 2048)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, a very long text, a column more and no rows at all."""
    words = lambda s, n: " ".join(f"{s}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(n))
    rows = [(1, words("a", 80)), (1, words("a", 80)), (2, words("b", 80)), (None, words("a", 81)), (None, "x"), (3, None), (4, ""), (5, words("c", 60_000)), (6, words("b", 79))]
    docs = spark.createDataFrame([(d, t, "en", None, 0, d) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, line long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (5, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    classify, rules, one, pack = (f for _, f in corpus_pipeline.STAGES)
    assert classify(spark, docs, str(tmp_path)).count() == len(rows)  # one grade alone rejects nothing
    left = written(rules(spark, docs, ""))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "2", "5", "6", "None"] and left.columns == docs.columns
    assert sorted(r.doc_id for r in one(spark, left, "").collect()) == [1, 2, 5]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 5} and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    for stage in (classify, rules, pack):
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
