import re

import duckdb
import numpy as np
import pytest

from sightline.llm.common import ALNUM, hash_word, lower_ascii, word_spans
from sightline.llm.decontamination import Automaton, contamination, decontaminate
from sightline.llm.oracles import contamination_sql
from sightline.llm.queries import op13

ITEMS = [("a", "x y"), ("b", "w x y"), ("c", "y"), ("d", "a b c d e f g h i j k"), ("e", "b c d e f g h i j k l m"), (None, "v v"), ("a", "x y"), ("f", ""), ("g", None), ("h", "q q q q q q q q q q q q")]
DOCS = [
    (1, "w x y z"), (2, "x-y"), (3, "z a b c d e f g h i j k l m z"), (4, "q q"), (5, "q " * 15), (6, None), (7, ""), (8, "Y"), (None, "B C D e f g h i j k"),
    (8, "Y"), (9, "é x y " * 500), (10, "v v\nv"), (11, "z " * 200 + "a b c d e f g h i j k " * 40), (12, "... !"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((doc, len(w), sum(hit), sorted(found - {None})))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()], key=str)


@pytest.mark.parametrize("part_words", [10**6, 8])
def test_against_all_windows(spark, part_words):
    """One automaton or one after another: short and repeated items, items without id or words, long and repeated texts."""
    docs = spark.createDataFrame([(d, t, "z") for d, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, doc_id int")
    assert rows(contamination(docs, items, part_words=part_words)) == brute(DOCS, ITEMS)
    assert contamination(docs.limit(0), items).count() == 0
    assert all(r[2] == 0 for r in rows(contamination(docs, items.limit(0))))


def test_against_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in items.collect()])
    assert sum(r[2] > 0 for r in want) and rows(contamination(docs, items, part_words=200)) == want


def test_sql(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ITEMS)], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = op13(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({contamination_sql()})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_other_words_of_an_equal_hash():
    """A word that only its hash takes for an item's word doesn't count."""
    made = Automaton.build([("a", [b"aa", b"bb"])], 10)
    at = int(np.flatnonzero(made.hashes == np.uint64(hash_word(b"aa")))[0])
    made.bytes = made.bytes.copy()
    made.bytes[made.offsets[at]] = ord("c")  # now the item's word is "ca", with the hash of "aa"
    data = np.frombuffer(b"aa bb", np.uint8)
    assert not made.scan(data, np.array([0, len(data)]))[3].any()
    assert len(word_spans(lower_ascii(data), np.array([0, len(data)]), ALNUM)[0]) == 2


def test_removal(spark):
    docs = spark.createDataFrame([(1, "One two. A b c D e f g h i j k? Three four five six seven eight nine ten eleven twelve"), (2, "a b c d e f g h i j k"), (3, None), (4, "é w x y ü"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).collect()}
    assert got == {1: "One two. ? Three four five six seven eight nine ten eleven twelve", 3: None, 5: ""}
    got = {r.doc_id: r.text for r in decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string"), most_words=3, most_share=1.0).collect()}
    assert got[4] == "é  ü" and got[2] == ""
