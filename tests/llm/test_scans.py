"""Licence and personal data scans against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from logwarden.llm.licenses import BASE, GATES, licence_detections, scan_licences, signatures
from logwarden.llm.pii import GENERALISE, REACH, REMOVE, personal_spans, sanitise
from logwarden.llm.queries import op7_licenses, op8_personal_data
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LICENSED = [
    (1, "Released under the MIT License."), (2, "This work is licensed under the GNU General\nPublic License, version 3."),
    (3, "Licensed under CC BY-NC 4.0."), (4, "SPDX-License-Identifier: Apache-2.0 and the Apache License"), (5, None), (6, ""),
    (7, "mit license mit-license MIT  LICENSE"), (8, "permit license, mit licenses, xmit license"), (9, "mit"), (10, "licensing nothing"),
    (11, "see https://www.apache.org/licenses/LICENSE-2.0 or GPL v2"), (11, "see https://www.apache.org/licenses/LICENSE-2.0 or GPL v2"),
    (None, "general public license"), (12, "été apache license ÉTÉ"), (13, "dual: mit licence"), (14, "mit license " * 3000), (15, "...")]


def test_base_places_equal_plain_version(spark, documents, write_tables):
    got = {(r.doc_id, r.n_words): r for r in op7_licenses(spark, write_tables(documents=documents(LICENSED))).collect()}
    for doc, text in LICENSED:
        w, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
        for phrase, label in BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[doc, len(w)]
        assert (r.n_base, r.base_labels, r.first_word, r.last_word) == (
            len(starts), ",".join(sorted(labels)), min(starts, default=None), max(starts, default=None)), (doc, r)
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_signatures_resolve_overlaps(spark, documents):
    rows = licence_detections(documents(LICENSED)).collect()
    kept = defaultdict(set)
    for r in rows:
        if r.kept and not r.base:
            kept[r.doc_id].add(r.name)
    assert kept[2] == {"grant gpl-3.0"} and kept[3] == {"grant cc-by-nc-4.0"}  # the names inside the grants are gone
    assert kept[4] == {"identifier apache-2.0"} and kept[11] == {"address apache-2.0", "name gpl-2.0"}
    assert {r.name for r in rows if r.doc_id == 2 and not r.kept} >= {"name gpl-3.0"}
    assert sum(r.base for r in rows if r.doc_id == 14) == 3000
    for doc in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == doc and not r.base and r.kept]
        assert not any(a is not b and a.start <= b.start and b.end <= a.end for a in own for b in own)


def test_rules_can_be_reached(spark):
    rules = signatures()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    for r in rules:
        plain = r.pattern.replace("licen[cs]e", "license")
        assert any(g in plain for g in GATES), r
        assert r.keyword in plain, r


def test_licences_of_an_empty_table(spark, documents):
    assert scan_licences(documents([])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def is_personal(kind, match):
    number = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")),
            "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if is_personal(k, m[0])]


def tricky():
    rnd = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "a@b.c_x@d.ee", "é@f.gh", "@a.b", "..@..", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0255.1.1", "1.2.3.", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "5500 0000 0000 0004", "12", "+1 (415) 555-2671", "+12", "+1--9", "+44 20 7946 0958.", "++1 23 45 67 89 0", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
              "00000000000000", "\U0001f600", "\n", "  ", "-", "9" * 25, "1.1.1.1.1", "a@b.c.", "99999999999.1.1.1"]
    docs = [(i, "".join(rnd.choice(pieces) + rnd.choice(["", " ", "", ",", "x"]) for _ in range(rnd.randrange(1, 14)))) for i in range(300)]
    return docs + [(400, None), (401, ""), (402, "1" * 60_000), (403, "a" * 60_000 + "@b.c"), (404, "1 " * 30_000), (405, "a.b@c.de " * 4000),
                   (406, "x@" + "y." * 30_000 + "z"), (0, "again a@b.cd"), (None, "none@no.id")]


def test_personal_data_equals_plain_version(spark, documents, write_tables):
    docs = tricky()
    got = op8_personal_data(spark, write_tables(documents=documents(docs))).collect()
    want = Counter()
    for doc, text in docs:
        spans = plain_spans(text)
        count = Counter(k for k, _, _ in spans)
        want[(doc, *(count[k] for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_terms_that_disclose_equal_plain_version(spark, documents):
    rnd = random.Random(2)
    filler = [f"{a}{b}{c}" for a in ("lor", "ips", "dol") for b in "aeiou" for c in ("rum", "sit")]
    docs = []
    for i in range(120):
        text = " ".join(rnd.choice(filler) for _ in range(30))
        if i % 20 < 3:  # three documents each share an entity and a rare word
            text = f"{text} Zebra{'abcdef'[i // 20]} wrote from 10.0.0.{i // 20} today {text}"
        elif i % 20 == 5:
            text += f" Zebra{'abcdef'[i // 20]} alone"
        docs.append((i, text))
    df = documents(docs)
    got = {(r.doc_id, r.kind, r.start, r.end) for r in personal_spans(df).collect()}
    term = re.compile(r"(?<![^\W_@._%+-])(?<![@._%+-])[^\W\d_]{3,}(?![\w@%+-]|\.[A-Za-z0-9])")
    near, total, having = defaultdict(set), len(docs), defaultdict(set)
    places = []
    for doc, text in docs:
        for m in term.finditer(text):
            having[m[0].lower()].add(doc)
        for kind, a, b in plain_spans(text):
            e = text[a:b]
            near[e, None].add(doc)
            for m in term.finditer(text):
                if (a - REACH < m.start() and m.end() <= a) or (b <= m.start() and m.end() < b + REACH):
                    near[e, m[0].lower()].add(doc)
                    places.append((doc, e, m[0].lower(), m.start(), m.end()))
    want = {(d, k, a, b) for d, t in docs for k, a, b in plain_spans(t)}
    best = {}
    for doc, e, t, a, b in places:
        both = len(near[e, t])
        info = math.log2(total / len(near[e, None]))
        if both >= 2:
            share = math.log2(both * total / (len(having[t]) * len(near[e, None]))) / info
            best[doc, a, b] = max(best.get((doc, a, b), 0), share)
    want |= {(d, "hidden" if s >= REMOVE else "hint", a, b) for (d, a, b), s in best.items() if s >= GENERALISE}
    assert got == want and any(k in ("hidden", "hint") for _, k, _, _ in got)


def test_sanitised_text(spark, documents):
    shared = "Quagga at a.b@c.de says"
    rows = documents([(1, f"é {shared} one"), (2, f"{shared} two"), (3, "plain words here"), (4, None), (5, "one two says here at"), *[(i, "says here at") for i in range(6, 60)]])
    out = {r.doc_id: r.sanitised for r in sanitise(rows.withColumns({c: F.lit(0) for c in ("mark", "of_id", "of_spans", "kind", "all")})).collect()}
    assert out[1].startswith("é [] at [email] ") and out[2].startswith("[] at [email] ") and out[3] == "plain words here" and out[4] is None
    assert sanitise(documents([])).count() == 0


def test_terms_disclose_over_whole_texts(spark, documents):
    far = " and so on" * 40  # 400 code points, more than REACH
    rows = [(1, f"Quagga{far} a.b@c.de"), (2, f"a.b@c.de{far} QUAGGA, then quagga"), (3, "the quagga alone"),
            (4, "once@d.ee has a Solitaire"), (4, "once@d.ee has a Solitaire"), *[(i, "and has then alone the") for i in range(5, 200)]]
    df = documents(rows)
    spans = lambda **more: {(r.doc_id, r.start, r.end) for r in personal_spans(df, **more).collect() if r.kind in ("hidden", "hint")}
    own = {(1, 0, 6), (2, 409, 415), (2, 422, 428)}
    assert spans() == own and spans(everywhere=True) == own | {(3, 4, 10)}
    out = {r.doc_id: r.sanitised for r in sanitise(df).collect()}
    assert not any("quagga" in t.lower() for t in out.values()) and out[4] == "[email] has a Solitaire"


#: Sentences as licences, headers and readmes have them, and the label that each must get.
WRITTEN_TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("bsd-2-clause", "in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("apache-2.0", "you may not use this file except in compliance with the License."), ("apache-2.0", "licensed under Apache 2.0"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"),
    ("lgpl-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("agpl-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd-3-clause", "BSD 3-Clause License"), ("bsd-2-clause", "the BSD-2-Clause"), ("gpl-3.0", "It is GPLv3+."), ("lgpl-2.1", "uses LGPLv2.1 code"), ("gpl-2.0", "GPL2"),
    ("agpl-3.0", "AGPLv3"), ("mpl-2.0", "MPL-2.0"), ("epl-1.0", "EPLv1.0"), ("mit", "Licensed under MIT."),
    ("unlicense", "This is free and unencumbered software released into the public domain."), ("zlib", "The origin of this software must not be misrepresented; you must not"),
    ("ofl-1.1", "fonts under this license cannot be released under any other type of license"), ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"), ("ncsa", "to deal with the Software without restriction"),
    ("mit,apache-2.0,bsd-3-clause", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"),
    ("gpl-2.0,isc", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR ISC"),
    ("", "The team lost; permission was granted by the bsd people and the mit campus."), ("", "Redistribution of wealth and use of sources")]


def test_licences_are_found_without_their_names(spark, documents):
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in scan_licences(documents([(i, t) for i, (_, t) in enumerate(WRITTEN_TEXTS)])).collect()}
    for i, (labels, text) in enumerate(WRITTEN_TEXTS):
        want = set(filter(None, labels.split(",")))
        assert want <= got[i] and (want or not got[i]), (labels, text, got[i])


def shortest(parsed):
    """A match of each choice of alternatives of a parsed pattern, with as few repeats as may be."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "NOT_LITERAL":
            more = ["q"]
        elif name == "IN":
            more = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "q"]
        elif name == "BRANCH":
            more = [m for choice in arg[1] for m in shortest(choice)]
        elif name == "SUBPATTERN":
            more = shortest(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [m * arg[0] for m in shortest(arg[2])] if arg[0] else [""]
        else:
            more = [""]  # what looks around takes no room
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_every_match_of_every_rule_opens_the_gate_and_holds_its_keyword():
    import re
    from logwarden.llm.licenses import GATES, signatures
    seen = 0
    for rule in signatures():
        for match in shortest(re._parser.parse(rule.pattern)):
            text = f"{match} "
            assert re.search(rule.pattern, text), (rule.name, match)
            assert rule.keyword in text or rule.keyword.startswith("|"), (rule.name, match)
            # an operand stands after an identifier of an expression, which is a gate itself
            assert any(g in text for g in GATES), (rule.name, match)
            seen += 1
    assert seen > 484


def test_names_without_the_word_licence_are_found(documents):
    from logwarden.llm.licenses import scan_licences
    docs = documents([(1, "Released under the Apache 2.0"), (2, "published under the terms of the Apache v2"), (3, "it is MIT No Attribution, all of it"), (4, "an apache in 2.0 parts")])
    got = {r.doc_id: r.labels for r in scan_licences(docs).collect()}
    assert got == {1: "apache-2.0", 2: "apache-2.0", 3: "mit-0", 4: ""}


def plain_detections(text, rules):
    """Detections of a text as licence_detections describes them, by Python's own regular expressions."""
    import re

    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    words = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", lowered).strip(" ") + " "
    found = [(words[:m.end()].count(" ") - m.group().count(" "), words[:m.end()].count(" "), r) for r in rules for m in re.finditer(r.pattern, words)]
    free = sorted(((s, -e, r.priority, r.name, r) for s, e, r in found if not r.base), key=lambda d: d[:4])
    outer = [d for i, d in enumerate(free) if not any(-b[1] >= -d[1] for b in free[:i])]
    kept = [(s, e, r) for s, e, r in found if r.base]
    chosen = []
    for s, e, _, _, r in sorted(outer, key=lambda d: (d[2], d[0], -d[1], d[3])):
        if not any(a < -e and b > s for a, b, _ in chosen):
            chosen.append((s, -e, r))
    return {(r.name, s, e) for s, e, r in found}, {(r.name, s, e) for s, e, r in kept + chosen}


def test_an_overlap_is_lost_only_to_a_detection_that_stays(documents):
    from logwarden.llm.licenses import Rule
    rules = [Rule("a", "a", 1, 1.0, "one", " license one two(?= )"), Rule("b", "b", 2, 1.0, "two", " two three(?= )"),
             Rule("c", "c", 3, 1.0, "three", " three four(?= )"), Rule("d", "d", 3, 1.0, "four", " four five(?= )")]
    text = "license one two three four five"
    got = {(r.name, r.start, r.end) for r in licence_detections(documents([(1, text), (2, " ".join([text] * 40))]), rules).filter("doc_id = 1 and kept").collect()}
    assert got == plain_detections(text, rules)[1] == {("a", 0, 3), ("c", 3, 5)}
    long = {(r.name, r.start, r.end) for r in licence_detections(documents([(2, " ".join([text] * 40))]), rules).filter("kept").collect()}
    assert long == plain_detections(" ".join([text] * 40), rules)[1] and len(long) == 80


def test_all_signatures_against_a_plain_scan(documents):
    """Detections, labels and scores of mixed licence texts, every rule tried on every text."""
    import random

    rules, draw = signatures(), random.Random(7)
    parts = [t for _, t in WRITTEN_TEXTS] + [t for _, t in LICENSED if t and len(t) < 200] + [
        "licensed under the terms of the GNU General Public License version 2", "Apache License 2.0", "the MIT", "license", "BSD", "under", "v2", "2.0"]
    texts = [(i, " ".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))) for i in range(60)]
    texts = [(i, t) for i, t in texts if "SPDX" not in t.upper()]
    docs = documents(texts)
    found, kept = {}, {}
    for r in licence_detections(docs).collect():
        found.setdefault(r.doc_id, set()).add((r.name, r.start, r.end))
        if r.kept:
            kept.setdefault(r.doc_id, set()).add((r.name, r.start, r.end))
    by_name = {r.name: r for r in rules}
    scanned = {r.doc_id: (r.labels, r.score) for r in scan_licences(docs).collect()}
    for i, text in texts:
        all_found, all_kept = plain_detections(text, rules)
        assert (found.get(i, set()), kept.get(i, set())) == (all_found, all_kept), text
        assert scanned[i] == (",".join(sorted({by_name[n].label for n, _, _ in all_kept})), max((by_name[n].weight for n, _, _ in all_kept), default=0.0))
