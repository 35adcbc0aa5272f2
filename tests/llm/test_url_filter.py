import math
import re
import zlib
from collections import Counter, defaultdict

from sightline.llm.url_filter import ORDER, RULES, START, judge_urls


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(rows):
    n = defaultdict(lambda: [Counter(), Counter()])
    body = {i: re.sub(r"(?s)^.*?://", "", u or "", count=1) for i, u in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    rule = {i: ruled(*parts(u)) for i, u in rows}
    for i, _ in rows:
        if rule[i][1] and fold[i]:
            s = START * ORDER + body[i]
            for j in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    n[s[j - k : j]][rule[i][1] == "block"][s[j]] += 1

    def p(context, c, side):
        probability = 1 / 128
        for k in range(len(context) + 1):
            seen = n[context[len(context) - k :]][side]
            total = sum(seen.values())
            if total:
                probability = (seen[c] + len(seen) * probability) / (total + len(seen))
        return probability

    score = {}
    for i, _ in rows:
        s = START * ORDER + body[i]
        x = [math.log(p(s[j - ORDER : j], s[j], 0)) - math.log(p(s[j - ORDER : j], s[j], 1)) for j in range(ORDER, len(s))]
        score[i] = sum(x) / len(x) if x else 0.0
    return rule, score


def test_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = [(-1, None), (-2, "no scheme"), (-3, "HTTP://WWW.Example.COM/en/x?y://z"), (-4, "x://a.net/fr/"), (-5, "x://anet/fr/"), (-6, "a://b"), (-7, "http://é.org/ü" + "x" * 3000), (-8, "://#")]
    pages = pages.select("page_id", "url").union(spark.createDataFrame(more, "page_id long, url string")).selectExpr("*", "1 as host", "2 as score")
    rows = [(r.page_id, r.url) for r in pages.collect()]
    rule, score = brute(rows)
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    url = dict(rows)
    for r in got:
        assert (r.host, r.path) == parts(url[r.page_id]) and r.rule == rule[r.page_id][0], r
        assert r.verdict == rule[r.page_id][1] or rule[r.page_id][1] is None and r.verdict in ("allow", "block")
        assert abs(r.score - score[r.page_id]) < 1e-6, r


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert len(judge_urls(pages).collect()) == 3
    assert judge_urls(pages.limit(0)).collect() == []


def test_exact_cut(spark):
    """The value at a rank of many, with ties and of both signs."""
    import random

    from sightline.llm.url_filter import kth_smallest

    r = random.Random(5)
    values = [round(r.gauss(0, 3), 9) for _ in range(6000)] + [0.123456789] * 500 + [-1.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "score double")
    order = sorted(values)
    for k in (1, 2, 70, 3500, 6999, 7000):
        assert kth_smallest(df, "score", k) == order[k - 1]
