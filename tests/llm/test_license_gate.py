"""Every rule in all its forms passes the gate and the keywords of the scan."""

from re import _parser as re_parser

from sightline.llm.license_scan import detect, hinted, literals, rules, scan, scan_licenses


def forms(parsed):
    """Strings that a regex matches: one, and for every choice in it one that takes another way there."""
    parts = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else "1" for o, v in value])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "SUBPATTERN":
            parts.append(forms(value[-1]))
        elif name == "BRANCH":
            parts.append([f for x in value[1] for f in forms(x)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            inner = forms(value[2])
            parts.append([""] * (value[0] == 0) + [i * max(value[0], 1) for i in inner])
        else:
            parts.append([""])
    first = "".join(p[0] for p in parts)
    out = [first]
    for k, p in enumerate(parts):
        out += ["".join(q[0] for q in parts[:k]) + x + "".join(q[0] for q in parts[k + 1 :]) for x in p[1:]]
    return out


def test_all_forms_of_all_rules(spark):
    texts = sorted({t for r in rules() for t in (" ".join(f.split()) for f in forms(re_parser.parse(r[2].pattern))) if r[2].search(t)})
    assert len(texts) > 3000
    assert [t for t in texts if not hinted(t)] == []
    assert [t for t in texts if detect(t) != detect(t, filtered=False)] == []
    long = "many other words and " * 60
    written = [long + t.upper().replace(" ", " -\n") + ". " + long for t in texts]
    got = scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in enumerate(written)], "doc_id long, text string, labels string"))
    assert [written[r.doc_id] for r in got.where("labels = '' or score = 0").collect()] == []


def test_statements():
    label = lambda t: scan(t)[4]
    for text, want in [
        ("This work is released under GPLv3.", {"gpl-3"}), ("GPL2", {"gpl-2"}), ("SPDX-License-Identifier: MIT", {"mit"}), ("SPDX-License-Identifier: Apache-2.0", {"apache-2"}), ("license: MIT", {"mit"}),
        ("Dual MIT/BSD", {"mit", "bsd"}), ("the Expat License", {"mit"}), ("SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", {"mit", "gpl-2-or-later"}), ("License :: OSI Approved :: BSD", {"bsd"}), ("mitigation of submits, gplan", set()),
    ]:
        assert label(text) == want, text
    assert literals("(?:mit|expat) licen[sc]e") == {" licen"} and literals("a(?:bc|de)?f?") == {"a"} and literals("(?:abc|d[ef])x?") == {"abc", "d"}


def test_repeated_rows_and_long_texts(spark):
    text = "word " * 200_000 + "under the MIT License " + "word " * 1000
    got = scan_licenses(spark.createDataFrame([(1, text, 3), (1, text, 4), (2, None, 5), (3, "", 6)], "doc_id long, text string, score int")).orderBy("doc_id").collect()
    assert got[0] == got[1] and (got[0].n_base, got[0].first_word, got[0].labels) == (1, 200_000, "mit")
    assert [(r.n_words, r.labels, r.score) for r in got[2:]] == [(0, "", 0.0)] * 2
