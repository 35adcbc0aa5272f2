"""DuckDB SQL for the rows of op3, op4, op11 and op13. The near-linear work of the Spark jobs isn't repeated here: SQL compares what
the definitions name (all grams, all pairs with a common shingle), so it suits small tables."""

from __future__ import annotations

from .url_filter import ALPHABET, LEAST, LOSS, ORDER, RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a column's ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))))"""


def url_filter_sql() -> str:
    """Rules, Witten-Bell models of every order and the calibrated cut of judge_urls. Its percentile is the exact one for
    fewer than 5,000 calibration URLs."""
    ruled = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{value(r)}'" for r in ruled) + " END"
    width = ORDER + 1
    mixed = lambda x: f"CASE WHEN n{x} > 0 THEN ({x} + t{x} * p{x}) / (n{x} + t{x}) ELSE p{x} END AS p{x}"
    steps = "".join(
        f"""
part{n} AS (SELECT right(gram, {n}) AS g, sum(a) AS a, sum(b) AS b FROM grams GROUP BY 1),
base{n} AS (SELECT left(g, {n - 1}) AS c, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM part{n} GROUP BY 1),
p{n} AS (SELECT s.gram, {mixed("a")}, {mixed("b")} FROM p{n - 1} s JOIN part{n} p ON p.g = right(s.gram, {n}) JOIN base{n} q ON q.c = left(p.g, {n - 1})),"""
        for n in range(1, width + 1)
    )
    return rf"""
WITH u AS (SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  regexp_replace(coalesce(url, ''), '(?s)^.*?://', '') AS body, {CRC32.format("page_id")} % 5 AS fold FROM pages),
d AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled FROM u),
e AS (SELECT body, CASE WHEN coalesce(fold, 1) <> 0 THEN ruled END AS side, unnest(range(1, length(body) + 1)) AS i FROM d),
grams AS (SELECT substring(repeat(chr(2), {ORDER}) || body, i, {width}) AS gram, count(*) FILTER (side = 'allow') AS a, count(*) FILTER (side = 'block') AS b FROM e GROUP BY 1),
p0 AS (SELECT gram, 1 / {ALPHABET}::DOUBLE AS pa, 1 / {ALPHABET}::DOUBLE AS pb FROM grams),{steps}
o AS (SELECT body, avg(ln(pa) - ln(pb)) AS score FROM (SELECT DISTINCT body, i, substring(repeat(chr(2), {ORDER}) || body, i, {width}) AS gram FROM e) JOIN p{width} USING (gram) GROUP BY 1),
j AS (SELECT page_id, host, path, rule, ruled, fold, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN o USING (body)),
held AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM j WHERE fold = 0 AND ruled = 'allow'),
cut AS (SELECT coalesce(min(least(score, 0)), 0) AS cut FROM held WHERE n >= {LEAST} AND k = ceil({LOSS} * n))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score FROM j, cut
"""


def jaccard_sql(k: int = 3, num: int = 9, den: int = 10) -> str:
    """Components of documents whose sets of k-word shingles have a similarity of num/den or more."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS of FROM x GROUP BY 1),
c AS (SELECT of, n, min(doc_id) AS rep FROM n GROUP BY 1, 2),
y AS (SELECT rep, n, hash(s) AS h, s FROM c JOIN x ON x.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM y a JOIN y b ON a.h = b.h AND a.s = b.s AND a.rep < b.rep AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.low, c.rep, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.of = n.of AND c.n = n.n LEFT JOIN m ON m.a = c.rep
"""


def contamination_sql(window: int = 10) -> str:
    """Words of documents inside a window of an item, by all windows as text; and the items with such windows."""
    words = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[k + 1 : k + least(len(w), {window})], ' ') AS s FROM (SELECT *, unnest(range(greatest(len(w) - {window - 1}, 1))) AS k FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
p AS (SELECT r, k, n, array_to_string(w[k + 1 : k + n], ' ') AS s FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, k, n, item_id FROM p JOIN v USING (n, s)),
m AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (r) LEFT JOIN t USING (r)
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's algorithm on integers with every entry compared, a chain of tables a round. All vectors have one length, a multiple of parts."""
    far = "list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2])))"
    steps = "".join(
        f"""
a{t} AS MATERIALIZED (SELECT r, p, min(coalesce({far}, 0) * {entries} + b.e) AS m FROM x JOIN b{t} b USING (p) GROUP BY 1, 2),
s{t} AS (SELECT p, (m % {entries})::BIGINT AS e, i, sum(x.c[i])::HUGEINT AS s, count(*) AS n FROM a{t} JOIN x USING (r, p), unnest(range(1, len(x.c) + 1)) u(i) GROUP BY 1, 2, 3),
b{t + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(any_value(c) FILTER (i IS NULL), list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i)) AS c FROM b{t} b LEFT JOIN s{t} USING (p, e) GROUP BY 1, 2),"""
        for t in range(rounds)
    )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS c FROM k, unnest(range({parts})) t(p)),
f AS (SELECT vec_id, min(v) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k WHERE vec_id IS NOT NULL GROUP BY 1 QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT p, e, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS c FROM f, unnest(range({parts})) t(p)),{steps}
z AS (SELECT r, p, min(coalesce({far}, 0) * {entries} + b.e) AS m FROM x JOIN b{rounds} b USING (p) GROUP BY 1, 2),
o AS (SELECT r, string_agg(printf('%02x', (m % {entries})::BIGINT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM z GROUP BY 1)
SELECT vec_id::BIGINT AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN o USING (r)
"""
