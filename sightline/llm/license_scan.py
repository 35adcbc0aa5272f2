"""License scans: ordered signature rules, each a regex gated by keywords, resolved by priority and containment.

Rules are sentences of license texts and notices, addresses of license texts, and what families, versions, identifiers and
ways of stating a license make. Keywords come from the rules' own patterns: pieces of text of which every match holds one.
A text is matched against a rule's regex only if it holds one of the rule's keywords. A detection is dropped if a detection of higher priority contains its interval, or one of
the same priority does that is longer or earlier in the list."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from re import _parser as re_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, word_spans

# Phrases that are labels wherever their words stand one after another.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# License families as name: (keyword, regex of the name, versions).
FAMILIES = {
    "gpl": ("general public", r"(?:gnu )?general public licen[sc]e", "1 2 3"),
    "gpl-short": ("gpl", r"(?:gnu )?gpl", "1 2 3"),
    "lgpl": ("lesser", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "2 2 1 3"),
    "lgpl-short": ("lgpl", r"(?:gnu )?lgpl", "2 2 1 3"),
    "agpl": ("affero", r"(?:gnu )?affero general public licen[sc]e", "1 3"),
    "agpl-short": ("agpl", r"(?:gnu )?agpl", "1 3"),
    "gfdl": ("documentation", r"(?:gnu )?free documentation licen[sc]e", "1 1 2 1 3"),
    "apache": ("apache", r"apache(?: software)? licen[sc]e", "1 1 1 2"),
    "mit": ("mit", r"(?:mit|expat) licen[sc]e", ""),
    "bsd-2-clause": ("bsd", r"(?:2|two) clause bsd licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)?|simplified bsd licen[sc]e", ""),
    "bsd-3-clause": ("bsd", r"(?:3|three) clause bsd licen[sc]e|bsd (?:3|three) clause(?: licen[sc]e)?|(?:new|modified) bsd licen[sc]e", ""),
    "bsd": ("bsd", r"bsd licen[sc]e", ""),
    "isc": ("isc", r"isc licen[sc]e", ""),
    "mpl": ("mozilla", r"mozilla public licen[sc]e", "1 1 1 2"),
    "epl": ("eclipse", r"eclipse public licen[sc]e", "1 2"),
    "cddl": ("distribution", r"common development and distribution licen[sc]e", "1 1 1"),
    "artistic": ("artistic", r"artistic licen[sc]e", "1 2"),
    "boost": ("boost", r"boost software licen[sc]e", "1"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[sc]e", ""),
    "unlicense": ("unlicense", r"the unlicense", ""),
    "wtfpl": ("wtfpl", r"wtfpl", "1 2"),
    "eupl": ("european", r"european union public licen[sc]e", "1 1 1 1 2"),
    "ofl": ("font", r"(?:sil )?open font licen[sc]e", "1 1 1"),
    "python": ("python", r"python software foundation licen[sc]e", "2"),
    "openssl": ("openssl", r"openssl licen[sc]e", ""),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", ""),
    "odbl": ("database", r"open database licen[sc]e", "1"),
}
# Clauses of Creative Commons licenses, long and short.
CLAUSES = {"by": ("attribution", "by"), "by-sa": ("attribution share ?alike", "by sa"), "by-nd": ("attribution no ?deriv(?:ative)?s?", "by nd"), "by-nc": ("attribution non ?commercial", "by nc"), "by-nc-sa": ("attribution non ?commercial share ?alike", "by nc sa"), "by-nc-nd": ("attribution non ?commercial no ?deriv(?:ative)?s?", "by nc nd")}
# Short identifiers of licenses as label: regex of the words.
IDS = {
    "mit": "mit|expat|x11 mit", "mit-0": "mit 0", "apache-2": "apache 2(?: 0)?|apache2(?: 0)?|asl 2(?: 0)?", "apache-1.1": "apache 1 1", "bsd-2-clause": "bsd 2 clause|bsd2|bsd 2", "bsd-3-clause": "bsd 3 clause|bsd3|bsd 3",
    "bsd-4-clause": "bsd 4 clause", "0bsd": "0bsd", "bsd": "bsd", "isc": "isc", "gpl-2": "gpl ?v?2(?: 0)?(?: only)?", "gpl-3": "gpl ?v?3(?: 0)?(?: only)?", "gpl-2-or-later": "gpl ?v?2(?: 0)? (?:or later|plus)",
    "gpl-3-or-later": "gpl ?v?3(?: 0)? (?:or later|plus)", "gpl": "gpl", "lgpl-2.1": "lgpl ?v?2 1(?: only)?", "lgpl-3": "lgpl ?v?3(?: 0)?(?: only)?", "lgpl-2.1-or-later": "lgpl ?v?2 1 (?:or later|plus)",
    "lgpl-3-or-later": "lgpl ?v?3(?: 0)? (?:or later|plus)", "lgpl": "lgpl", "agpl-3": "agpl ?v?3(?: 0)?(?: only)?", "agpl-3-or-later": "agpl ?v?3(?: 0)? (?:or later|plus)", "gfdl": "gfdl(?: 1 [123])?", "mpl-2": "mpl ?v?2(?: 0)?",
    "mpl-1.1": "mpl ?v?1 1", "epl-1": "epl 1(?: 0)?", "epl-2": "epl 2(?: 0)?", "cddl-1.0": "cddl 1 0", "artistic-2": "artistic 2(?: 0)?", "boost-1": "bsl 1 0|boost 1(?: 0)?", "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "eupl-1.2": "eupl 1 2", "ofl-1.1": "ofl 1 1", "python-2": "psf 2 0|python 2 0", "openssl": "openssl", "postgresql": "postgresql", "odbl-1": "odbl 1 0", "cc0": "cc0(?: 1 0)?", "ncsa": "ncsa", "vim": "vim", "ms-pl": "ms pl", "bsl-1.1": "busl 1 1",
    "cc-by-4.0": "cc by 4 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-3.0": "cc by 3 0", "cc-by-sa-3.0": "cc by sa 3 0", "proprietary": "proprietary", "public-domain": "public domain",
}
# Ways of stating a license before an identifier: (regex, priority, score).
TAGGED = [(r"spdx licen[sc]e identifier (?:[a-z0-9 ]{1,80}? (?:or|and|with) )??", 5, 1.0), (r"licen[sc]es?(?: is| id| type| name| osi approved)? ", 3, 0.9), (r"dual(?:ly)?(?: licen[sc]ed?)?(?: under)?(?: the)? (?:[a-z0-9 ]{1,20}? )??", 3, 0.85), (r"(?:licen[sc]ed|released|distributed|available|published) (?:under|as) (?:the )?", 3, 0.85)]
# Ways of stating a license before its name: (regex, priority, score).
STATED = [(r"(?:dual |re)?licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?", 3, 1.0), (r"(?:released|distributed|available|published|made available) under (?:the |a )?(?:terms of (?:the )?)?", 3, 0.95), (r"spdx licen[sc]e identifier ", 4, 1.0), (r"", 1, 0.6)]
# Other signs of a license, without a name.
OTHERS = [("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2, 0.8), ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", 2, 0.9), ("proprietary", "rights reserved", r"all rights reserved", 0, 0.4), ("proprietary", "proprietary", r"proprietary and confidential", 0, 0.5), ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 0, 0.3), ("unknown", "licen", r"licen[sc]ed under", 0, 0.2)]
# Sentences of license texts and notices as label, keyword, regex of words, priority, score.
BODIES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 5, 1.0),
    ("mit", "sell copies", r"to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", 2, 0.9),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5, 1.0),
    ("hpnd", "without fee", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee", 5, 0.9),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.9),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software", 5, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 6, 0.95),
    ("bsd-2-clause", "this list of conditions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.7),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?", 5, 0.95),
    ("apache-2", "except in compliance", r"you may not use this file except in compliance with the licen[sc]e", 5, 1.0),
    ("apache-2", "apache", r"apache licen[sc]e version 2 0 january 2004", 6, 1.0),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 5, 0.9),
    ("gpl-2-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("gpl-3-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("gpl-2", "version 2 as published", r"under the terms of the gnu general public licen[sc]e version 2 as published by the free software foundation", 6, 1.0),
    ("gpl-2", "version 2 june 1991", r"gnu general public licen[sc]e version 2 june 1991", 6, 1.0),
    ("gpl-3", "version 3 29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007", 6, 1.0),
    ("gpl", "without even the implied", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e", 2, 0.8),
    ("lgpl-2.1-or-later", "lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("lgpl-3-or-later", "lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("lgpl-2-or-later", "library general", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("agpl-3-or-later", "affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 5, 1.0),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0", 6, 1.0),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 6, 1.0),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public licen[sc]e (?:v )?2 0", 6, 1.0),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public licen[sc]e v1 0", 6, 1.0),
    ("cddl-1.0", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 5, 0.95),
    ("zlib", "held liable", r"in no event will the authors be held liable for any damages arising from the use of this software", 5, 0.95),
    ("boost-1", "hereby granted", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 5, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 5, 1.0),
    ("wtfpl", "you want to", r"do what the fuck you want to(?: public licen[sc]e)?", 5, 1.0),
    ("cc0", "waive", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", 5, 1.0),
    ("ofl-1.1", "font software", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 6, 1.0),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis", 5, 1.0),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 5, 0.95),
    ("artistic-2", "artistic", r"the artistic licen[sc]e 2 0 copyright c 2000 2006", 6, 1.0),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 6, 1.0),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e(?: ms pl)?", 4, 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e(?: ms rl)?", 4, 0.9),
    ("bsl-1.1", "business source", r"business source licen[sc]e(?: 1 1)?", 4, 0.9),
    ("sspl-1", "server side public", r"server side public licen[sc]e(?: (?:v|version )?1)?", 4, 0.9),
    ("elastic-2", "elastic licen", r"elastic licen[sc]e(?: v?2 0)?", 4, 0.9),
    ("beerware", "beer", r"(?:the )?beer ?ware licen[sc]e|if we meet some day and you think this stuff is worth it you can buy me a beer", 4, 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 5, 0.95),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 5, 0.95),
    ("ncsa", "university of illinois", r"university of illinois(?: ncsa)? open source licen[sc]e", 4, 0.95),
    ("vim", "vim licen", r"vim licen[sc]e", 4, 0.9),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:confidential )?(?:information and )?trade secrets? of", 1, 0.5),
    ("proprietary", "written permission", r"(?:may not|no part of this .{1,30}? may) be (?:reproduced|copied)(?: or distributed)?(?: in any form)? without (?:the )?(?:prior )?written permission", 1, 0.5),
    ("proprietary", "redistribution is prohibited", r"(?:unauthori[sz]ed )?(?:copying or )?redistribution is prohibited", 1, 0.5),
]
# Addresses of license texts as label, words of the address.
ADDRESSES = [
    ("mit", "opensource org licenses mit"), ("apache-2", "apache org licenses license 2 0"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl-2", "gnu org licenses old licenses gpl 2 0"),
    ("gpl", "gnu org licenses gpl"), ("lgpl", "gnu org licenses lgpl"), ("agpl-3", "gnu org licenses agpl 3 0"), ("mpl-2", "mozilla org mpl 2 0"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"), ("isc", "opensource org licenses isc"), ("boost-1", "boost org license 1 0"), ("unlicense", "unlicense org"), ("cc0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"), ("epl-2", "eclipse org legal epl 2 0"), ("ofl-1.1", "scripts sil org ofl"), ("wtfpl", "wtfpl net"),
]
#: Words that any text may hold: of equally long ones others are looked for first.
COMMON = {"what", "want", "with", "this", "that", "from", "under", "when", "have", "into"}
_WORD = np.ones(256, bool)
_WORD[:48], _WORD[58:97], _WORD[123:128] = False, False, False
_WORD[65:91] = True
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@lru_cache(1)
def rules() -> list[tuple[str, str, re.Pattern, int, float]]:
    """label, keyword, regex over words joined by a space, priority, score; earlier rules win ties."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int, score: float) -> None:
        out.append((label, keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), priority, score))

    for family, (keyword, name, versions) in FAMILIES.items():
        label = family.removesuffix("-short")
        numbers = {"2 2 1 3": ["2", "2 1", "3"], "1 1 2 1 3": ["1 1", "1 2", "1 3"], "1 1 1 2": ["1 1", "2"], "1 1 1": ["1 0", "1 1"], "1 1 1 1 2": ["1 1", "1 2"]}.get(versions, versions.split())
        for lead, priority, score in STATED:
            for v in numbers:
                for later in (r" or (?:any )?later(?: version)?", ""):
                    add(f"{label}-{v.replace(' ', '.')}" + ("-or-later" if later else ""), keyword, rf"{lead}(?:{name})(?: (?:version|v))? ?v?{v}(?: 0)?{later}", priority + 1, score)
            add(label, keyword, rf"{lead}(?:{name})", priority, score * 0.9)
    for clause, (long, short) in CLAUSES.items():
        for lead, priority, score in STATED:
            for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
                add(f"cc-{clause}-{v.replace(' ', '.')}", "cc" if lead else "cc " + short, rf"{lead}cc {short} {v}", priority + 1, score)
                add(f"cc-{clause}-{v.replace(' ', '.')}", "creative commons", rf"{lead}creative commons {long} {v}", priority + 1, score)
            add(f"cc-{clause}", "cc " + short, rf"{lead}cc {short}", priority, score * 0.9)
            add(f"cc-{clause}", "creative commons", rf"{lead}creative commons {long}", priority, score * 0.9)
    for label, name in IDS.items():
        for lead, priority, score in TAGGED:
            add(label, "", rf"{lead}(?P<id>{name})", priority, score)
    for x in [*OTHERS, *BODIES]:
        add(*x)
    for label, words in ADDRESSES:
        add(label, words, words, 5, 0.95)
    for clause, (_, short) in CLAUSES.items():
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(f"cc-{clause}-{v.replace(' ', '.')}", "creativecommons org", rf"creativecommons org licenses {short} {v}", 5, 1.0)
    return out


def literals(pattern: str) -> set[str]:
    """Pieces of text of which every match of the regex holds one; of several choices the one whose shortest piece is longest."""

    def of(parsed) -> set[str] | None:
        best: set[str] | None = None
        run = ""

        def better(x: set[str] | None) -> None:
            nonlocal best
            size = lambda y: min(max(map(len, z.split()), default=0) for z in y)
            if x and all(z.strip() for z in x) and (best is None or size(x) > size(best)):
                best = x

        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
                continue
            if name in ("ASSERT_NOT", "ASSERT", "AT"):
                continue
            better({run} if run else None)
            run = ""
            if name == "SUBPATTERN":
                better(of(value[-1]))
            elif name == "BRANCH":
                parts = [of(x) for x in value[1]]
                better(set().union(*parts) if all(parts) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                better(of(value[2]))
        better({run} if run else None)
        return best

    return of(re_parser.parse(pattern)) or set()


@lru_cache(1)
def prefilter():
    """Automaton over the keywords of all rules, and groups of rules with the same keywords: rules, and the most characters that a match takes."""
    import ahocorasick

    a, groups = ahocorasick.Automaton(), {}
    for i, (label, _, pattern, *_) in enumerate(rules()):
        found = frozenset(k.strip() for k in literals(pattern.pattern))
        if not found:
            raise ValueError(f"a rule for {label} has no keyword")
        groups.setdefault(found, []).append(i)
    by: dict[str, list[int]] = {}
    for g, found in enumerate(groups):
        for k in found:
            by.setdefault(k, []).append(g)
    for k, v in by.items():
        a.add_word(k, v)
    a.make_automaton()
    return a, [(x, max(re_parser.parse(rules()[i][2].pattern).getwidth()[1] for i in x)) for x in groups.values()]


def stretches(plain: str, ends: list[int], width: int) -> list[tuple[int, int]]:
    """Parts of the text, from space to space, that hold all matches of up to `width` characters that reach over one of the places."""
    out: list[tuple[int, int]] = []
    for e in ends:
        a, z = plain.rfind(" ", 0, max(e - width, 0) + 1), plain.find(" ", e + width)
        a, z = max(a, 0), len(plain) if z < 0 else z
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def uncontained(found: list[tuple[int, int]]) -> list[int]:
    """Positions of the intervals, given in order of rank, that none ranked before contains: a tree over the starts keeps
    the largest end of those kept, so this takes n log n steps."""
    starts = sorted({s for s, _ in found})
    tree, kept = [-1] * (len(starts) + 1), []
    for i, (s, e) in enumerate(found):
        at = bisect_right(starts, s)
        k, most = at, -1
        while k:
            most = max(most, tree[k])
            k &= k - 1
        if most < e:
            kept.append(i)
            k = at
            while k < len(tree):
                tree[k] = max(tree[k], e)
                k += k & -k
    return kept


def detect(plain: str, filtered: bool = True) -> list[tuple[int, int, str, float]]:
    """start, end, label, score in a text of words joined by a space, after suppression. filtered: try rules only where their
    keywords stand."""
    automaton, groups = prefilter()
    places: dict[int, list[int]] = {}
    if filtered:
        for end, v in automaton.iter(plain):
            for g in v:
                places.setdefault(g, []).append(end)
    parts = [(i, span) for g, ends in places.items() for span in stretches(plain, ends, groups[g][1]) for i in groups[g][0]] if filtered else [(i, (0, len(plain))) for i in range(len(rules()))]
    found = []
    for i, span in parts:
        label, _, pattern, priority, score = rules()[i]
        name = "id" if "id" in pattern.groupindex else 0  # of one statement, each identifier counts by itself
        found += [(-priority, m.start(name) - m.end(name), i, m.start(name), m.end(name), label, score) for m in pattern.finditer(plain, *span)]
    found.sort()
    kept = [found[i] for i in uncontained([x[3:5] for x in found])]
    return sorted((k[3], k[4], k[5], k[6]) for k in kept)


def scan(text: str, filtered: bool = True) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Places of base phrases: number, first and last word; base labels, all labels, score."""
    plain = f" {_GAP.sub(' ', text.encode().lower().decode()).strip()} "
    at, base = [], set()
    for label, phrase in BASE.items():
        i = plain.find(f" {phrase} ")
        while i >= 0:
            at.append(i)
            base.add(label)
            i = plain.find(f" {phrase} ", i + 1)
    own = detect(plain.strip(), filtered)
    score = max([x[3] for x in own] + [0.9] * bool(base), default=0.0)
    word = lambda i: plain.count(" ", 0, i + 1) - 1
    return len(at), word(min(at)) if at else None, word(max(at)) if at else None, base, base | {x[2] for x in own}, score


@lru_cache(1)
def hints():
    """Of every keyword and base phrase the longest word, which a raw text must hold somewhere. Of keywords whose words have up to
    three letters, all words are looked at: (length, None) or (length, regexes of keywords that may begin there)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    long, short = set(), {}
    for phrase in {k for k, _ in prefilter()[0].items()} | set(BASE.values()):
        word = max(phrase.split(), key=lambda w: (len(w), w not in COMMON))
        if len(word) > 3:
            long.add(word)
        else:
            first, gap = phrase.split()[0], _GAP.pattern
            short.setdefault(first, []).append(re.compile(gap.join(map(re.escape, phrase.split()))))
    for word in long:
        a.add_word(word, (len(word), None))
    for word, patterns in short.items():
        a.add_word(word, (len(word), patterns))
    a.make_automaton()
    return a


def hinted(text: str) -> bool:
    """Whether any rule or base phrase may stand in a raw text."""
    low = text.encode().lower().decode()
    return any(patterns is None or any(p.match(low, end - n + 1) for p in patterns) for end, (n, patterns) in hints().iter(low))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels ('') and score 0. Rows with a null doc_id keep it; repeated rows
    give equal rows; an empty table gives no rows."""
    form = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                _, _, row = word_spans(data, offsets, _WORD)
                raw = data.tobytes()
                got = []
                for i in range(end - first):
                    text = raw[offsets[i] : offsets[i + 1]].decode()
                    got.append(scan(text) if hinted(text) else (0, None, None, set(), set(), 0.0))
                n, lo, hi, base, labels, score = zip(*got, strict=True)
                join = lambda x: [",".join(sorted(s)) for s in x]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), pa.array(np.bincount(row, minlength=end - first), pa.int64()), *[pa.array(x, pa.int64()) for x in (n, lo, hi)], pa.array(join(base)), pa.array(join(labels)), pa.array(score, pa.float64())], schema=form)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
