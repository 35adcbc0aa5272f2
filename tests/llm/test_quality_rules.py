import re
from collections import Counter

import duckdb

from sightline.llm import quality_rules as rules
from sightline.llm.quality_rules import QUALITY_SQL, cleaned, quality_rules
from sightline.llm.queries import op7


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(wins)
    hit = {i + j for i, x in enumerate(wins) if c[x] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_and_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules(docs).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {d: brute(t) for d, t in text.items()}
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    names = ", ".join(got[0].__fields__)
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select {names} from ({QUALITY_SQL})").fetchall())


def test_lines_and_edges(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Accept 12 cookies {i}\n" + " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}y{j}" for j in range(60)), "a") for i in range(30)]
    rows += [(100 + i, "\n".join(f"menu {j}" for j in range(40)) + f"\nend{i}", "b") for i in range(30)]
    rows += [(1000, None, None), (1001, "", "a"), (1002, "a\x0bb c  d\na\x0bb c  d", "a"), (None, body, "c"), (1003, body, "c"), (1003, body, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as n", "3 as words")
    got = quality_rules(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].removed_words == 4 and by[0].kept and by[100].removed_words == 81 and not by[100].base_failed and not by[100].kept
    assert by[1003].kept and by[None].kept and not by[1000].kept and by[1002].n_words == 6 and by[1002].n_dup_lines == 1
    assert all(tuple(by[d][1:6]) == brute(t) for d, t, _ in rows)
    assert quality_rules(docs.limit(0)).collect() == []


def test_long_lines(spark, tmp_path):
    passage = " ".join(f"p{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    own = lambda i, n: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{'z' * j}" for j in range(n))
    rows = [(i, f"{passage}\n{own(i, 100)}", "a") for i in range(30)] + [(100 + i, passage + "\nend" + "x" * i, "b") for i in range(30)]
    rows += [(200 + i, own(999, 80), "c") for i in range(30)] + [(300 + i, f"{passage}\n{own(i, 100)}", "d") for i in range(25)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    by = {r.doc_id: r for r in op7(spark, path).collect()}
    assert all(by[i].removed_words == 60 and by[i].kept and by[100 + i].removed_words == 60 and not by[100 + i].kept for i in range(30))
    assert all(not by[d].removed_words and by[d].kept for d, _, _ in rows[60:])  # exact copies count once, 25 texts aren't too many


def test_cleaned_drops_boilerplate_lines(spark):
    own = lambda i, n: " ".join(f"w{chr(97 + i)}{'z' * j}{'xy'[n % 2]}" for j in range(n))
    text = lambda i: f"{own(i, 31)}\nShare  this page {i}\n\n {own(i, 40)}\nshare this page 7"
    clean = lambda i: f"{own(i, 31)}\n\n {own(i, 40)}"
    rows = [(i, "en", text(i % 26), "a", len(text(i % 26))) for i in range(26)] + [(None, "en", text(3), "a", 1), (3, "de", text(3), "a", 1), (50, "en", text(5), "b", len(text(5))), (51, "en", text(6), None, len(text(6))), (52, "en", "short", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long")
    docs = docs.unionByName(spark.createDataFrame([(None, "en", "bad row without an id", "a", 3)], docs.schema))
    got = cleaned(docs).collect()
    want = [(d, x, clean(i), s, len(clean(i))) for (d, x, _, s, _), i in zip(rows[:28], [*range(26), 3, 3], strict=True)] + [tuple(r) for r in rows[28:30]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_boilerplate_lines_are_salted(spark, monkeypatch):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}w{chr(97 + i // 26)}q{j}" for j in range(60))
    rows = [(i, f"{own(i)}\nfollow us on all channels\nfollow us on all channels", "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality_rules(docs).collect()))
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality_rules(docs).collect())) == want and want[0][-1] == 10
