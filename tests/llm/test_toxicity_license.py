import re
import time
from re import _parser

import numpy as np

from sightline.llm.license_scan import BASE, detect, hinted, rules, scan, scan_licenses, uncontained
from sightline.llm.toxicity import Matcher, folded, score_toxicity

SF = "/root/testdata/sf0.1"


def test_folding_and_exceptions():
    assert folded("You, ѕtuр1d!") == " you stupid "
    assert "pathetic" in folded("P4th3tic") and "stupid" in folded("stup1d")
    m = Matcher({" trash ": 3.0})
    assert folded("1diot $tupid @sshole ｉｄｉｏｔ ídiot") == " idiot stupid asshole idiot idiot " and folded("5 apples, 2024") == " apples "
    assert m.features("such trash")[2] == 3.0 and m.features("the trash can")[2] == 0 and m.features("")[0] == 0


def test_exceptions_in_a_long_text():
    m = Matcher({" pig ": 3.0, " trash ": 3.0})
    began = time.time()
    x = m.features("guinea pig iron trash can " * 60_000 + "such trash")
    assert time.time() - began < 20 and x[2] == 3.0 and x[3] == 10 / (5 * 60_000 + 2 + 20)
    assert m.features("guinea pig iron trash can")[3] == 0 and m.features("pig guinea pig pig")[3] == 20 / 24


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([a > b for a in pos for b in neg]) > 0.93
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.8 and np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (4, "a " * 50000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as score")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(docs.limit(0), labels).collect() == []


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, k) for k, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({k for _, k in at}))


def test_license_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Under\x0bthe MIT-license, cc by nc cc by-nc; Apache License, Version 2.0é"), (None, "under the mit license"), (-5, "K under the mit license")], docs.schema)
    docs = docs.union(more)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs).collect()
    assert len(got) == len(text)
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {d: brute(t) for d, t in text.items()}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(docs.limit(0)).collect() == []


def test_suppression():
    assert len(rules()) >= 300
    label = lambda t: [x[2] for x in detect(t)]
    assert label("licensed under the gnu general public license version 3") == ["gpl-3"]
    assert label("licensed under the apache license version 2 0") == ["apache-2"]
    assert label("released under the mit license") == ["mit"]
    assert label("licensed under cc by nc 4 0") == ["cc-by-nc-4.0"]
    assert label("gnu lesser general public license version 2 1 or later") == ["lgpl-2.1-or-later"]
    assert label("plain words only") == []


def example(parsed, keyword):
    """A text that the parsed regex matches: optional parts taken, the first way of each choice that holds the keyword."""
    out = ""
    for op, x in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(x)
        elif kind == "IN":
            out += "0" if str(x[0][1]) == "CATEGORY_DIGIT" else chr(x[0][1] if str(x[0][0]) == "LITERAL" else x[0][1][0])
        elif kind == "MAX_REPEAT":
            out += example(x[2], keyword)
        elif kind == "MIN_REPEAT":
            out += "x" * x[0]
        elif kind == "SUBPATTERN":
            out += example(x[3], keyword)
        elif kind == "BRANCH":
            ways = [example(w, keyword) for w in x[1]]
            out += next((w for w in ways if keyword in w), ways[0])
    return out


def test_every_rule_reaches_scan(spark):
    texts = [example(_parser.parse(p.pattern), k) for _, k, p, *_ in rules()]
    assert all(k in t and p.search(t) for t, (_, k, p, *_) in zip(texts, rules(), strict=True))
    raw = [t.upper().replace(" ", " -\n") if i % 2 else t for i, t in enumerate(texts)]
    raw.append("Photos are shared under Creative Commons Attribution-ShareAlike 4.0 by their makers.")
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert got[len(texts)].labels == "cc-by-sa-4.0"
    assert all(got[i].score > 0 and {x[2] for x in detect(t)} <= set(got[i].labels.split(",")) for i, t in enumerate(texts))
    assert all(detect(t) == detect(t, filtered=False) for t in texts)


def test_prefilter_loses_nothing_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in docs]
    assert all(hinted(t) for t in texts if scan(t, filtered=False)[4])
    assert all(scan(t) == scan(t, filtered=False) for t in texts) and any(scan(t)[4] for t in texts)


def test_license_texts():
    label = lambda t: {x[2] for x in detect(t)}
    assert label("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files") == {"mit"}
    assert "bsd" in label("redistribution and use in source and binary forms with or without modification are permitted provided that")
    assert label("https www gnu org licenses gpl 3 0 html") == {"gpl-3"} and label("http creativecommons org licenses by sa 4 0") == {"cc-by-sa-4.0"}


def test_suppression_against_brute_force_and_long_texts():
    chance = np.random.default_rng(4)
    for _ in range(50):
        start = chance.integers(0, 60, 80)
        found = [(int(s), int(s + n)) for s, n in zip(start, chance.integers(1, 20, 80), strict=True)]
        kept = []
        for i, (s, e) in enumerate(found):
            if not any(found[k][0] <= s and e <= found[k][1] for k in kept):
                kept.append(i)
        assert uncontained(found) == kept
    began = time.time()
    n, first, last, *_ = scan("cc by nc all rights reserved " * 60_000)
    assert (n, first, last) == (60_000, 0, 59_999 * 6) and time.time() - began < 20
