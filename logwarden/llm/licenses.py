"""Licence scans by ordered signature rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import ascii_lower, same
from logwarden.llm.places import hits, placed


@dataclass(frozen=True)
class Rule:
    """A signature over a text of words with one space before and after each. Smaller priorities are stronger."""
    name: str
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool = False


# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Licences as (label, identifier, name, address). Identifier, name and address are patterns over words,
# in which a version such as 2.0 is two words.
LICENCES = (
    ("mit", "mit", "(?:expat|mit(?: x11)?) licen[cs]e", "opensource org licenses? mit"),
    ("mit-0", "mit 0", "mit no attribution(?: licen[cs]e)?", "opensource org licenses? mit 0"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?licen[cs]e (?:version |v )?v?1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache 2 0", "apache (?:software )?licen[cs]e (?:version |v )?v?2(?: 0)?", "apache org licenses license 2 0"),
    ("bsd-2-clause", "bsd 2 clause", "(?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", "(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", "(?:4 clause|four clause|original) bsd licen[cs]e", "opensource org licenses? bsd 4 clause"),
    ("0bsd", "0bsd", "(?:zero clause bsd|bsd zero clause) licen[cs]e", "opensource org licenses? 0bsd"),
    ("isc", "isc", "isc licen[cs]e", "opensource org licenses? isc"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v )?v?1(?: 0)?", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v )?v?2(?: 0)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v )?v?3(?: 0)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public licen[cs]e|lgpl) (?:version |v )?v?2(?: 0)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v )?v?2 1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v )?v?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public licen[cs]e|agpl) (?:version |v )?v?3(?: 0)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", "(?:gnu )?free documentation licen[cs]e (?:version |v )?v?1 2", "gnu org licenses (?:old licenses )?fdl 1 2"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "(?:gnu )?free documentation licen[cs]e (?:version |v )?v?1 3", "gnu org licenses fdl 1 3"),
    ("mpl-1.1", "mpl 1 1", "mozilla public licen[cs]e (?:version |v )?v?1 1", "mozilla org mpl(?: mpl)? 1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?", "mozilla org (?:en us )?mpl(?: mpl)? 2 0"),
    ("epl-1.0", "epl 1 0", "eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", "eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?", "eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution licen[cs]e (?:version |v )?v?1 0", "opensource org licenses? cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", "common development and distribution licen[cs]e (?:version |v )?v?1 1", "opensource org licenses? cddl 1 1"),
    ("cpl-1.0", "cpl 1 0", "common public licen[cs]e(?: (?:version |v )?v?1 0)?", "opensource org licenses? cpl 1 0"),
    ("ipl-1.0", "ipl 1 0", "ibm public licen[cs]e(?: (?:version |v )?v?1 0)?", "opensource org licenses? ipl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicen[cs]e", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl net"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "opensource org licenses? zlib"),
    ("bsl-1.0", "bsl 1 0", "boost software licen[cs]e(?: (?:version |v )?v?1 0)?", "boost org license 1 0"),
    ("artistic-1.0", "artistic 1 0", "artistic licen[cs]e (?:version |v )?v?1(?: 0)?", "opensource org licenses? artistic 1 0"),
    ("artistic-2.0", "artistic 2 0", "artistic licen[cs]e (?:version |v )?v?2(?: 0)?", "opensource org licenses? artistic 2 0"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font licen[cs]e(?: (?:version |v )?v?1 1)?", "scripts sil org ofl"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e (?:version |v )?v?1 1", "opensource org licenses? eupl 1 1"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e (?:version |v )?v?1 2", "opensource org licenses? eupl 1 2"),
    ("ms-pl", "ms pl", "microsoft public licen[cs]e", "opensource org licenses? ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[cs]e", "opensource org licenses? ms rl"),
    ("psf-2.0", "(?:psf|python) 2 0", "(?:python software foundation|psf) licen[cs]e(?: (?:version |v )?v?2)?", "docs python org 3 license"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby lang org en about license"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "opensource org licenses? postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?(?:ncsa open source|uiuc) licen[cs]e", "opensource org licenses? ncsa"),
    ("x11", "x11", "x11 licen[cs]e", "xfree86 org 3 3 6 copyright2"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl org source license"),
    ("php-3.01", "php 3 01", "php licen[cs]e(?: (?:version |v )?v?3 01)?", "php net license 3 01"),
    ("osl-3.0", "osl 3 0", "open software licen[cs]e(?: (?:version |v )?v?3(?: 0)?)?", "opensource org licenses? osl 3 0"),
    ("afl-3.0", "afl 3 0", "academic free licen[cs]e(?: (?:version |v )?v?3(?: 0)?)?", "opensource org licenses? afl 3 0"),
    ("cecill-2.1", "cecill 2 1", "cecill (?:free software )?licen[cs]e(?: (?:agreement )?(?:version |v )?v?2 1)?", "cecill info licences"),
    ("lppl-1.3c", "lppl 1 3c", "latex project public licen[cs]e(?: (?:version |v )?v?1 3c?)?", "latex project org lppl"),
    ("qpl-1.0", "qpl 1 0", "q public licen[cs]e(?: (?:version |v )?v?1 0)?", "opensource org licenses? qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "opensource org licenses? sleepycat"),
    ("vim", "vim", "vim licen[cs]e", "vimhelp org uganda txt"),
    ("curl", "curl", "curl licen[cs]e", "curl se docs copyright"),
    ("odbl-1.0", "odbl 1 0", "open (?:data commons open )?database licen[cs]e(?: (?:version |v )?v?1 0)?", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution licen[cs]e(?: (?:version |v )?v?1 0)?", "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl 1 0", "(?:open data commons )?public domain dedication and licen[cs]e", "opendatacommons org licenses pddl"),
    ("cc0-1.0", "cc0 1 0", "(?:creative commons zero|cc0)(?: (?:version |v )?v?1 0)?(?: universal)?", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", "(?:dedicated to|placed in(?:to)?|released in(?:to)?) the public domain", "creativecommons org publicdomain mark 1 0"),
    ("proprietary", "licenseref proprietary", "(?:proprietary|commercial) licen[cs]e(?: agreement)?", "example com eula license"),
)

# The kinds of Creative Commons licences, by identifier and name, and their versions.
COMMONS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
           "by nd": "attribution no ?deriv(?:ative)?s", "by nc sa": "attribution non ?commercial share ?alike",
           "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
VERSIONS = ("2 0", "2 5", "3 0", "4 0")

# Sentences of licences themselves, notices, and names in other orders, as (label, form, keyword, pattern). A
# keyword is part of every match and opens the text to all signatures.
WRITTEN = (
    ("mit", "body", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "body", "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "notice", "mit licensed", "mit licensed"),
    ("bsl-1.0", "body", "permission is hereby granted free of charge to any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "body", "permission to use copy modify and", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "body", "permission to use copy modify and", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "body", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd-2-clause", "body", "other materials provided with the distribution this software is provided by", "other materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "body", "used to endorse or promote products derived from this software without", "(?:neither the names? of|the names? of)(?: [^ ]+){1,40}? used to endorse or promote products derived from this software without"),
    ("bsd-4-clause", "body", "advertising materials mentioning features or use of this software", "all advertising materials mentioning features or use of this software"),
    ("bsd", "notice", "bsd style licen", "bsd style licen[cs]e"),
    ("apache-2.0", "notice", "use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "body", "each contributor hereby grants to you a perpetual worldwide", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", "body", "products derived from this software may not be called apache", "products derived from this software may not be called apache"),
    ("apache-2.0", "order", "apache", "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache (?:version |v )?v?2(?: 0)?"),
    ("apache-2.0", "order", "licen", "version 2 0 of the apache licen[cs]e"),
    ("gpl-2.0", "notice", "either version 2 of the license", "general public licen[cs]e as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "notice", "either version 3 of the license", "(?<!lesser )(?<!affero )general public licen[cs]e as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "notice", "free software foundation version 2", "(?<!library )general public licen[cs]e(?: version 2)? as published by the free software foundation version 2"),
    ("lgpl-2.0", "notice", "library general public license as published", "library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "notice", "either version 2 1 of the license", "lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "notice", "lesser general public license as published", "lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "notice", "affero general public license as published", "affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3.0", "body", "general public license is a free copyleft license for software and other kinds of works", "general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "body", "general public license is intended to guarantee your freedom to share and change free software", "general public license is intended to guarantee your freedom to share and change free software"),
    ("lgpl-2.1", "body", "this license the lesser general public license applies to some specially designated software", "this license the lesser general public license applies to some specially designated software"),
    ("agpl-3.0", "body", "copyleft license for software and other kinds of works specifically designed to ensure cooperation", "copyleft license for software and other kinds of works specifically designed to ensure cooperation"),
    ("gfdl-1.3", "notice", "free documentation license version 1 3 or any later version", "free documentation license version 1 3 or any later version"),
    ("gpl-1.0", "order", "gpl", "(?:gnu )?gpl ?v?1(?: 0)?"), ("gpl-2.0", "order", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?"), ("gpl-3.0", "order", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "order", "lgpl", "(?:gnu )?lgpl ?v?2 1"), ("lgpl-2.0", "order", "lgpl", "(?:gnu )?lgpl ?v?2(?: 0)?(?! 1)"), ("lgpl-3.0", "order", "lgpl", "(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "order", "agpl", "(?:gnu )?agpl ?v?3(?: 0)?"),
    ("gpl-2.0", "order", "of the gnu general public license", "version 2 of the gnu general public license"), ("gpl-3.0", "order", "of the gnu general public license", "version 3 of the gnu general public license"),
    ("bsd-2-clause", "order", "bsd 2 clause", "bsd 2 clause(?: simplified)?(?: licen[cs]e)?"), ("bsd-3-clause", "order", "bsd 3 clause", "bsd 3 clause(?: new| revised| modified)?(?: or revised)?(?: licen[cs]e)?"),
    ("bsd-4-clause", "order", "bsd 4 clause", "bsd 4 clause(?: original)?(?: licen[cs]e)?"), ("bsd-2-clause", "order", "bsd two clause", "bsd two clause licen[cs]e"),
    ("bsd-3-clause", "order", "bsd three clause", "bsd three clause licen[cs]e"), ("0bsd", "order", "bsd 0 clause", "bsd 0 clause(?: licen[cs]e)?"),
    ("mit", "order", "mit", "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?mit(?! no)"),
    ("mpl-2.0", "notice", "subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "notice", "subject to the mozilla public license version 1 1", "contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "order", "mpl", "mpl ?v?2(?: 0)?"), ("mpl-1.1", "order", "mpl", "mpl ?v?1 1"),
    ("epl-2.0", "notice", "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license(?: v| version)? ?v?2 0"),
    ("epl-1.0", "notice", "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license(?: v| version)? ?v?1 0"),
    ("epl-2.0", "order", "epl", "epl ?v?2(?: 0)?"), ("epl-1.0", "order", "epl", "epl ?v?1(?: 0)?"),
    ("cddl-1.0", "notice", "terms of the common development and distribution license", "contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "order", "cddl", "cddl ?v?1 0"), ("cddl-1.1", "order", "cddl", "cddl ?v?1 1"),
    ("unlicense", "body", "this is free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "body", "you just do what the fuck you want to", "you just do what the fuck you want to"),
    ("zlib", "body", "altered source versions must be plainly marked as such", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "body", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("artistic-2.0", "body", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("ofl-1.1", "body", "the font software may be sold as part of a larger software package", "the font software may be sold as part of a larger software package"),
    ("ofl-1.1", "body", "fonts under this license cannot be released under any other type of license", "fonts under this license cannot be released under any other type of license"),
    ("ncsa", "body", "to deal with the software without restriction", "to deal with the software without restriction"),
    ("x11", "body", "the name of the x consortium shall not be used in advertising", "the name of the x consortium shall not be used in advertising"),
    ("openssl", "body", "this product includes software developed by the openssl project", "this product includes software developed by the openssl project"),
    ("postgresql", "body", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("php-3.01", "body", "this product includes php software", "this product includes php software"),
    ("cc0-1.0", "body", "the person who associated a work with this deed has dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "notice", "this work is in the public domain", "this work is in the public domain"),
    ("proprietary", "notice", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "notice", "proprietary and confidential", "proprietary and confidential"),
)
#: Priority and weight of the forms of WRITTEN.
FORMS = {"notice": (2, 0.95), "body": (3, 0.9), "order": (4, 0.7)}

#: One of these is part of every signature, so a text without them is passed over at once.
GATES = ("licen", "spdx", "creativecommons", "creative commons", "public domain", " cc by ", " cc0 ", "gpl", "wtfpl", "opensource org",
         "mozilla org", "eclipse org", "boost org", "sil org", "cecill", "latex project", "vimhelp", "curl se", "opendatacommons",
         "xfree86 org", " mpl", " epl", " cddl", " apache ", " mit no attribution", *(k for _, form, k, _ in WRITTEN if form != "order" or k.startswith("bsd")))


def commons() -> list[tuple[str, str, str, str]]:
    """Creative Commons licences, from their kinds and versions."""
    return [(f"cc {kind} {version}".replace(" 0", ".0").replace(" 5", ".5").replace(" ", "-"), f"cc {kind} {version}",
             f"(?:cc {kind}|creative commons {name}) (?:licen[cs]e )?(?:version |v )?v?{version}(?: (?:international|unported))?",
             f"creativecommons org licenses {kind} {version}") for (kind, name), version in product(COMMONS.items(), VERSIONS)]


def keyword_of(pattern: str) -> str:
    """The longest plain piece of a pattern that every match holds."""
    plain, piece, depth, optional = [""], "", 0, False
    for i, c in enumerate(pattern):
        following = pattern[i + 1:i + 2]
        if c == "(" or c == "[":
            plain.append(piece)
            piece, depth = "", depth + 1
        elif c == ")" or c == "]":
            depth -= 1
        elif c == "|" and not depth:
            return ""  # nothing is common to alternatives
        elif depth or c == "?":
            continue
        elif following == "?" or c == ".":
            plain.append(piece)
            piece = ""
        else:
            piece += c
    return max([*plain, piece], key=len)


def signatures() -> list[Rule]:
    """All rules, strongest first: identifiers (the first of an SPDX expression, and its further operands), grants, addresses
    and names of every licence, WRITTEN sentences, and the base phrases."""
    grant = "(?:licen[cs]ed|released|distributed|available|provided|published|covered)(?: [^ ]+){0,2}? under (?:the )?(?:terms of )?(?:the )?"
    out = [Rule(f"base {label}", label, 9, 0.6, phrase, f" {phrase}(?= )", True) for phrase, label in BASE]
    for nth, (label, form, key, pattern) in enumerate(WRITTEN):
        out.append(Rule(f"{form} {label} {nth}", label, *FORMS[form], key, f" {pattern}(?= )"))
    for label, identifier, name, address in (*LICENCES, *commons()):
        out.append(Rule(f"operand {label}", label, 1, 1.0, "|spdx", f" \\|spdx (?:{identifier})(?= )"))
        own = f"(?:{name})"
        for form, priority, weight, pattern, key in (
                ("identifier", 1, 1.0, f" spdx license identifier (?:{identifier})(?= )", "spdx license identifier"),
                ("grant", 2, 0.95, f" {grant}{own}(?= )", keyword_of(name)),
                ("address", 3, 0.9, f" {address}(?= )", keyword_of(address)),
                ("name", 4, 0.7, f" {own}(?= )", keyword_of(name))):
            out.append(Rule(f"{form} {label}", label, priority, weight, key, pattern))
    return sorted(out, key=lambda r: (r.priority, r.name))


RULES = "array<struct<name:string,label:string,priority:int,weight:double,keyword:string,pattern:string,base:boolean>>"


def words_between_spaces(text):
    """The words of a text column, each with one space before it, and one at the end."""
    apart = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.btrim(apart), F.lit(" "))


def marked(words):
    """Words in which every operator of an SPDX expression is the word ``|spdx``, which no text holds: operands follow it.
    An operand is one to eight words, and as many after ``with``; there may be any number of operands."""
    operator = r"((?:\G(?!^)| spdx license identifier)(?: (?!and |or |with |spdx )[^ ]+(?: or later(?= ))?){1,8}?(?: with(?: (?!and |or |spdx )[^ ]+){1,8}?)?) (?:and|or)(?= )(?! later )"
    return F.when(F.contains(words, F.lit("spdx license identifier")), F.regexp_replace(words, operator, "$1 |spdx")).otherwise(words)


def spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, mark and words. The one-element explode keeps Spark from copying the expression into what reads it."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(F.array(words_between_spaces(F.col("text")))).alias("words"))


def licence_detections(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row for each place where a signature matches, with ``kept``.

    Texts become words, so punctuation, case and line breaks don't matter and places are word numbers [start, end).
    Texts without any of GATES are passed over; of a text's rules only those whose keyword it holds are tried. Base
    phrases are always kept. Other detections are resolved within a text: one whose words lie within another's goes (of
    equal ones the one with the lower priority number stays, then by rule name). Those left are taken in order of priority
    number, then of place, and one goes if it overlaps one that has been kept, so a detection falls only to one that stays.
    Containment is found by running maxima over sorted detections, linear in them. Overlaps are settled within chains
    of detections that overlap their neighbours, with work in the square of a chain; a chain hardly ever has more than a few.

    Documents are told apart by id and text; repeated rows give one set of rows. Null texts have no words. Returns
    doc_id, mark (hash of the text), name, label, priority, weight, base, start, end, kept.
    """
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in rules or signatures()])), RULES)
    text = normalised(docs)
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("words", F.lit(g))
    tried = text.filter(gate).withColumn("words", marked(F.col("words"))).select("doc_id", "mark", "words", F.explode(F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"]))).alias("rule"))
    found = (tried.select("doc_id", "mark", "rule", hits(F.col("words"), F.col("rule.pattern"), spaces).alias("hits"))
             .filter(F.col("hits").isNotNull()).select("doc_id", "mark", "rule.*", "hits").drop("keyword", "pattern"))
    keys = ["doc_id", "mark", "name", "label", "priority", "weight", "base"]
    places = placed(found, keys)

    own = Window.partitionBy("doc_id", "mark", "base")
    order = own.orderBy("start", F.desc("end"), "priority", "name")
    inside = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("end"), F.lit(False))
    outer = places.withColumn("inside", ~F.col("base") & inside)
    near = Window.partitionBy("doc_id", "mark", "base", "inside").orderBy("start", "end")
    begins = F.coalesce(F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    chained = outer.withColumn("begins", begins.cast("int")).withColumn("chain", F.sum("begins").over(near))
    chains = chained.groupBy("doc_id", "mark", "base", "inside", "chain").agg(F.array_sort(F.collect_list(F.struct(*CHAINED))).alias("rows"))
    settled = F.when(F.col("base") | F.col("inside"), F.transform("rows", lambda r: with_kept(r, F.col("base"))))
    settled = settled.otherwise(F.aggregate("rows", F.array().cast(SETTLED), settle))
    return (chains.select("doc_id", "mark", "base", F.explode(settled).alias("row"))
            .select("doc_id", "mark", "row.name", "row.label", "row.priority", "row.weight", "base", "row.start", "row.end", "row.kept"))


#: Fields of a detection in the order in which a chain is settled, and their type with the verdict.
CHAINED = ("priority", "start", "end", "name", "label", "weight")
SETTLED = "array<struct<priority:int,start:bigint,end:bigint,name:string,label:string,weight:double,kept:boolean>>"


def with_kept(row, kept):
    return F.struct(*(row[c].alias(c) for c in CHAINED), kept.alias("kept"))


def settle(done, row):
    """``done`` and the next detection of a chain, which is kept unless it overlaps one that is."""
    falls = F.exists(done, lambda d: d["kept"] & (d["start"] < row["end"]) & (d["end"] > row["start"]))
    return F.concat(done, F.array(with_kept(row, ~falls)))


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row for each document: its words, base places, labels and score.

    ``score`` is the largest weight among kept detections, 0 without any. Rows that repeat an id and text are all
    there; other columns are ignored; an empty table gives no rows.
    """
    rows = normalised(docs).select("doc_id", "mark", F.when(F.length("words") <= 2, 0).otherwise(spaces(F.col("words")) - 1).cast("long").alias("n_words"))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    found = (licence_detections(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"))
             .agg(F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
                  F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), labels(F.col("base")).alias("base_labels"),
                  labels(F.col("kept")).alias("labels"), F.max(F.when(F.col("kept"), F.col("weight"))).alias("score")))
    return (rows.join(found, same(F.col("doc_id"), F.col("of_id")) & same(F.col("mark"), F.col("of_mark")), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
