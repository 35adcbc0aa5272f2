import re
from contextlib import suppress
from itertools import combinations
from pathlib import Path
from threading import Event, Thread

from sightline.llm import jaccard_join
from sightline.llm.jaccard_join import first_of_each, jaccard_components

SF = "/root/testdata/sf0.001"


def brute(rows, k, num, den):
    sets, best = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        best[d] = d

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
            i = len(sets[a] & sets[b])
            if den * i >= num * (len(sets[a]) + len(sets[b]) - i) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                best[hi] = lo
    return {(d, len(sets[d]), root(d)) for d in sets}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, num, den in ((3, 9, 10), (5, 8, 10), (2, 3, 10)):
        assert {tuple(r) for r in jaccard_components(docs, k, num, den).collect()} == brute(rows, k, num, den)


def test_edges(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "b a"), (6, " ".join(base)), (7, " ".join(base[:-1])), (8, " ".join(base)), (9, "é " * 3000)]
    rows += [(100 + i, " ".join(base[:i] + ["x"] + base[i:])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sig", "2 as component")
    assert {tuple(r) for r in jaccard_components(docs, 3, 9, 10).collect()} == brute(rows, 3, 9, 10)
    assert jaccard_components(docs.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "c"), (4, "c"), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as _gone", "8 as component_id")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 9, 10).collect()), key=str)
    assert got == sorted([(1, 38, 1), (1, 38, 1), (2, 39, 1), (3, 39, 1), (4, 1, 4), (4, 1, 4), (0, 38, None), (0, 0, None)], key=str)
    kept = first_of_each(docs, 3, 9, 10).collect()
    assert sorted(map(str, (tuple(r)[:2] for r in kept))) == sorted(map(str, [(1, a), (1, b), (4, "c"), (None, None)]))
    once = docs.where("doc_id = 2 or text = 'c'").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in first_of_each(once.unionByName(once.selectExpr("doc_id + 10 as doc_id", "text", "_gone", "component_id"))).collect()} == {2, 4}
    assert first_of_each(docs.limit(0)).collect() == []


def test_blocks_and_turns(spark, monkeypatch):
    """Groups of several blocks, signatures packed a few at a time, cells and pairs in many turns."""
    for name, value in (("BLOCK", 4), ("PACKED", 50), ("CELLS_A_SET", 3), ("LINKS_A_SET", 1), ("LEAST_ROWS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    base = [f"w{i}" for i in range(30)]
    rows = [(10**15 * (-1) ** i + i, " ".join(base[:i] + [f"x{i}"] + base[i:])) for i in range(14)] + [(100 + i, " ".join(base[i:] + base[:i])) for i in range(14)]
    rows += [(200 + i, f"a{i // 3} b{i // 3} c{i // 3} d{i // 3}") for i in range(9)] + [(-(2**63), "z y x"), (2**63 - 1, "z y x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(docs, 2, 8, 10).collect()} == brute(rows, 2, 8, 10)


def test_disk(spark):
    """Shuffle files on disk at any one time, against the texts' bytes: 0.91 when signatures were shuffled as rows, sketches went to all
    cells at once and files stayed until the driver happened to collect its garbage."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    held = lambda: {f: f.stat().st_size for d in folders for f in Path(d.getPath()).glob("*/shuffle_*.data") if f.exists()}
    before, peak, over = set(held()), 0, Event()

    def watch():
        nonlocal peak
        while not over.wait(0.1):
            with suppress(FileNotFoundError):  # a file may go meanwhile
                peak = max(peak, sum(n for f, n in held().items() if f not in before))

    thread = Thread(target=watch)
    thread.start()
    try:
        assert jaccard_components(docs).count() == docs.count()
    finally:
        over.set()
        thread.join()
    assert 0 < peak < 0.5 * docs.selectExpr("sum(octet_length(text))").first()[0]
