"""License scans with ordered signature rules (operator 3), DataFrame functions only.

A text is scanned in two steps. A cheap gate looks for any keyword; only texts that pass are turned
into a line of lower-case words. On it every rule whose own keyword occurs is matched. Detections are
then taken in the order of their priority, the longer and the earlier first: one that lies inside a
detection that was kept, or overlaps one in part, is suppressed, and nothing else is. Everything happens inside
the row: nothing is shuffled.

The rules are ``TEXTS``, sentences of the licences themselves and of their notices, and before all others
in priority; then ``FAMILIES`` (a name as it is written, a label, a keyword) in each of ``FORMS`` (the
phrases around the name): explicit identifiers first, bare names last.

Edge cases: a null text is empty; an empty or license-free text gives no detection, null positions,
empty label strings and score 0; texts of any length are scanned whole; repeated rows are scanned
one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # on any letter case; ASCII separators split
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

V = r"(?: version)?(?: v)?"
#: label, keyword that must occur, name as words: fixed values
FAMILIES = (
    ("gpl-3.0", "gnu", rf"gnu general public license{V} 3(?: 0)?"),
    ("gpl-2.0", "gnu", rf"gnu general public license{V} 2(?: 0)?"),
    ("gpl-1.0", "gnu", rf"gnu general public license{V} 1(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl ?v? ?2(?: 0)?(?: only| or later)?"),
    ("lgpl-3.0", "lesser", rf"gnu lesser general public license{V} 3(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"gnu lesser general public license{V} 2 1"),
    ("lgpl-2.0", "library general", rf"gnu library general public license{V} 2(?: 0)?"),
    ("lgpl-3.0", "lgpl", r"lgpl ?v? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v? ?2 1"),
    ("agpl-3.0", "affero", rf"gnu affero general public license{V} 3(?: 0)?"),
    ("agpl-3.0", "agpl", r"agpl ?v? ?3(?: 0)?"),
    ("gfdl-1.3", "free documentation", rf"gnu free documentation license{V} 1 3"),
    ("gfdl-1.2", "free documentation", rf"gnu free documentation license{V} 1 2"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[cs]e{V} 2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{V} 1 1"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"),
    ("mit", "mit", r"mit(?: open source)? licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{V} 2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{V} 1 1"),
    ("mpl-2.0", "mpl", r"mpl 2(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{V} 2(?: 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{V} 1(?: 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution licen[cs]e{V} 1(?: 0)?"),
    ("eupl-1.2", "european union public", rf"european union public licen[cs]e{V} 1 2"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{V} 2(?: 0)?"),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e{V} 1(?: 0)?"),
    ("busl-1.1", "business source", rf"business source licen[cs]e{V} 1 1"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font licen[cs]e{V} 1 1"),
    ("odbl-1.0", "open database", r"open database licen[cs]e"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-4.0", "cc by", r"cc by(?: licen[cs]e)? 4 0"),
    ("cc-by-3.0", "cc by", r"cc by(?: licen[cs]e)? 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "rights reserved", r"all rights reserved"),
)
#: what stands before the name, what stands behind it, confidence: in order of priority
FORMS = (
    (r"spdx license identifier ", "", 1.0),
    (r"(?:is |are )?(?:licensed|released|distributed|published|available|provided) (?:to you )?under (?:the )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?", 0.95),
    (r"(?:see|read|under) (?:the )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?(?: for details| for more)?", 0.85),
    (r"licen[cs]e ", "", 0.8),
    (r"", "", 0.6),
)
ANY = r"(?: [^ ]+){0,12}?"  # a few words: names of holders and products
#: label, keyword that must occur, sentence as words: fixed values
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee| without fee)? is hereby granted"),
    ("bsd-3-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){0,110}? neither the name of"),
    ("bsd-4-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){0,110}? all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither the name", rf"neither the names? of{ANY} nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0 the license you may not use (?:this file|these files) except in compliance with the license"),
    ("apache-2.0", "apache license", r"apache license version 2 0 january 2004"),
    ("apache-2.0", "software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "compliance with the license", r"you may not use (?:this file|these files) except in compliance with the license you may obtain a copy of the license at"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl-3.0", "free software", r"(?:this program|this file|this|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("gpl-2.0", "free software", r"(?:this program|this file|this|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: either)? version 2"),
    ("lgpl-3.0", "free software", rf"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by{ANY} version 3"),
    ("lgpl-2.1", "free software", rf"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by{ANY} version 2 1"),
    ("lgpl-2.0", "free software", rf"free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by{ANY} version 2"),
    ("agpl-3.0", "free software", rf"free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by{ANY} version 3"),
    ("gpl-3.0", "general public license", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "general public license", r"gnu general public license version 2 june 1991"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3.0", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? 2 0"),
    ("epl-1.0", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? 1 0"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", r"do what the f[^ ]{3} you want to public license"),
    ("zlib", "warranty in no event", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("cc0-1.0", "to the extent possible", r"to the extent possible under law{0} has waived all copyright and related or neighboring rights".replace("{0}", ANY)),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("artistic-2.0", "artistic", r"this is free software licensed under the artistic license 2 0"),
    ("ms-pl", "microsoft public", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license(?: ms rl)?"),
    ("elastic-2.0", "elastic license", r"elastic license(?: version)? 2 0"),
    ("sspl-1.0", "server side public", r"server side public license(?: version 1)?"),
    ("python-2.0", "psf is making", r"psf is making python available to licensee on an as is basis"),
    ("curl", "except as contained", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license"),
    ("proprietary", "confidential", r"this (?:file|source code|software) (?:contains|is) (?:the )?(?:proprietary and )?confidential(?: and proprietary)?(?: information)? of"),
)
#: what a text must contain to be scanned at all, in lower case; each rule needs one of these
GATE = (
    "license", "licence", "copyright", "spdx", "gpl", "wtfpl", "0bsd", "cc0", "bsd", "mpl", "apache", "reserved", "domain", "creative", "permission", "redistribution",
    "neither the", "free software", "warranty", "advertising", "evil", "retain this", "openssl", "confidential", "waived", "public",
)
CC_BY = rf"(?i)cc{GAP}by"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern over a line of words, confidence); a lower priority is better."""
    made = [(i, label, keyword, f" {sentence}(?= |$)", 1.0) for i, (label, keyword, sentence) in enumerate(TEXTS)]
    for before, behind, confidence in FORMS:
        for label, keyword, name in FAMILIES:
            made.append((len(made), label, keyword, f" {before}{name}{behind}(?= |$)", confidence))
    return made


def _rule_array() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(f" {kw}").alias("keyword"),
                F.lit(rx).alias("pattern"), F.lit(c).alias("confidence"),
            )
            for p, label, kw, rx, c in rules()
        ]
    )


def word_line(text: Column) -> Column:
    """The text's words, ASCII letters in lower case, each behind one space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.concat(F.lit(" "), F.array_join(words, " ")), upper, lower)


def _n_words(piece: Column) -> Column:
    """Words of a piece of a line of words: each stands behind its own space."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def detections(line: Column) -> Column:
    """All matches of the rules, each a struct of first and last word, priority, label and confidence."""

    def of(rule: Column) -> Column:
        between, found = F.split(line, rule["pattern"], -1), F.regexp_extract_all(line, rule["pattern"], F.lit(0))
        spans = F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans")),
            lambda acc, i: F.struct(
                (acc["at"] + _n_words(F.get(between, i - 1)) + _n_words(F.get(found, i - 1))).alias("at"),
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["at"] + _n_words(F.get(between, i - 1))).alias("first"),
                        (acc["at"] + _n_words(F.get(between, i - 1)) + _n_words(F.get(found, i - 1)) - 1).alias("last"),
                    ),
                ).alias("spans"),
            ),
        )["spans"]
        return F.transform(
            F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<first:int,last:int>>")),
            lambda s: F.struct(
                s["first"].alias("first"), (-s["last"]).alias("neg_last"), rule["priority"].alias("priority"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ),
        )

    gated = F.filter(_rule_array(), lambda rule: F.contains(line, rule["keyword"]))
    return F.flatten(F.transform(gated, of))


def suppress(found: Column) -> Column:
    """Detections in the order of priority, then length, then place: each is kept unless it meets one that was kept.

    Only survivors suppress: what a suppressed detection contained or overlapped stays.
    """
    ranked = F.sort_array(
        F.transform(
            found,
            lambda d: F.struct(
                d["priority"].alias("priority"), (d["first"] + d["neg_last"]).alias("neg_size"), d["first"].alias("first"),
                d["neg_last"].alias("neg_last"), d["label"].alias("label"), d["confidence"].alias("confidence"),
            ),
        )
    )
    meets = lambda kept, d: F.exists(kept, lambda k: (k["first"] <= -d["neg_last"]) & (d["first"] <= -k["neg_last"]))
    kept = F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, d: F.when(meets(kept, d), kept).otherwise(F.array_append(kept, d)))
    return F.transform(kept, lambda d: F.struct(*[d[c].alias(c) for c in ("first", "neg_last", "priority", "label", "confidence")]))


def _base(line: Column) -> Column:
    """A struct for each phrase: label, places, first and last start."""
    out = []
    for phrase, label in BASE:
        pieces = F.split(line, f" {phrase}(?= |$)", -1)
        n = F.size(pieces) - 1
        end = _n_words(line) - _n_words(F.element_at(pieces, -1)) - len(phrase.split())
        out.append(
            F.struct(F.lit(label).alias("label"), n.alias("n"), _n_words(F.get(pieces, F.lit(0))).alias("first"), end.alias("last"))
        )
    return F.filter(F.array(*out), lambda b: b["n"] > 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base`` (phrase structs) and ``found`` (surviving detections), one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    gate = reduce(or_, [F.contains(low, F.lit(k)) for k in GATE]) | (F.contains(low, F.lit("cc")) & text.rlike(CC_BY))
    gated = F.when(gate, F.array(text)).otherwise(F.array().cast("array<string>"))
    scanned = F.transform(
        F.transform(gated, word_line),
        lambda line: F.struct(_base(line).alias("base"), suppress(detections(line)).alias("found")),
    )
    return docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.get(scanned, F.lit(0)).alias("s")).select(
        "doc_id", "n_words", "s.base", "s.found"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, found = F.col("base"), F.col("found")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform(base, lambda b: b["label"]), none)
    labels = F.coalesce(F.transform(found, lambda d: d["label"]), none)
    confidence = F.array_max(F.transform(found, lambda d: d["confidence"]))
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, labels)), ",").alias("labels"),
        F.coalesce(confidence, F.when(F.size(base_labels) > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE_SQL: dict[str, str] = {}
