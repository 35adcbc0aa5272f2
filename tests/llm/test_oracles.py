"""The SQL of op3 and op4 against their queries, on generated tables and on small fixtures."""

import zlib

import duckdb
import pytest

from sightline.llm import oracles, queries

SF = "/root/testdata/sf0.01"


def compare(spark, name, folder):
    """Rows of the query and of its SQL, floats rounded."""
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda r: tuple(round(v, 8) if isinstance(v, float) else v for v in r)
    return sorted((plain(r) for r in got.select(names).collect()), key=str), sorted((plain(r) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_ngram_jaccard_join"])
def test_generated_tables(spark, name):
    got, want = compare(spark, name, SF)
    assert got == want


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_ngram_jaccard_join"])
def test_fixture(spark, name, tmp_path):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 40]) for i in range(0, 8)]  # each step changes two of 40 shingles' worth
    texts = [None, "", " \t\n", "One", "one", "one two", "A b C", "a\x0bb\x0cc", *chain, " ".join(words * 200), " ".join(words * 200 + ["end"]), *["same text again here"] * 5]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y://z", "x://a.net/fr/", "a://b", "://#", *[f"http://é{i}.org/ü" for i in range(3)], *[f"https://site{i}.com/page/{i * i}" for i in range(150)], *[f"https://s{i}.net/es/{i}" for i in range(60)], "http://s1.org/" + "x" * 3000]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://nobody.org/es/")], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    got, want = compare(spark, name, folder)
    assert got == want and len(got) >= len(texts)


def test_crc32():
    ids = [0, 7, 12, 999, 123456789, -5]
    got = [r[0] for r in duckdb.connect().execute(f"select {oracles.CRC32.format('i')} from (select unnest({ids}) as i)").fetchall()]
    assert got == [zlib.crc32(str(i).encode()) for i in ids]
