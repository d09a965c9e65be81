"""License detection by ordered signature rules.

A text becomes a line of lower-case words.  Rules are regular expressions over
that line; each has a label, a priority and a keyword, and runs only where its
keyword occurs.  Texts without a part that some rule needs are not even normalised.
Detections are word intervals; one that lies inside another of at least its
priority is suppressed (of equal intervals the first rule stays).  All of it is
one projection of built-in functions: no shuffle, no Python.

Three base phrases are found on their own and always keep their labels.

Defined cases: null text has no words and no labels; a text of any length is read
whole; first and last word are null where no base phrase stands; equal rows get
equal results; other columns are not read; an empty table gives no rows.
Suppression compares the detections of one text with each other, so its cost is
quadratic in them, not in the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases and their labels; fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: Families: label, keyword, name as a pattern over words.
FAMILIES = [
    ("mit", "mit", r"(?:mit|expat)(?: x11)?"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 1(?: 0)?"),
    ("gpl-2", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 2(?: 0)?"),
    ("gpl-3", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 3(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: ?v| version)? ?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: ?v| version)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? 2 1"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public license(?: version)? 3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: ?v| version)? ?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: ?v| version)? ?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: version)? 3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: ?v| version)? ?3(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? 1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? 2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: ?v| version)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("cddl-1", "cddl", r"(?:common development and distribution license )?cddl(?: version)? 1(?: [01])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0", "cc", r"cc zero(?: 1 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4](?: [0-9])?)?(?: international| unported)?"),
    ("cc0", "creative", r"creative commons zero(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?"),
    ("ofl-1.1", "sil", r"sil open font license(?: version)?(?: 1 1)?"),
    ("odbl-1", "database", r"open (?:data commons open )?database license(?: v)?(?: ?1(?: 0)?)?"),
    ("python-2", "psf", r"(?:python software foundation|psf)"),
    ("postgresql", "postgresql", r"postgresql"),
    ("public-domain", "public", r"public domain"),
]
#: How a family's name is used: pattern around the name, priority.
FORMS = [
    (r"spdx license identifier {}(?: only| or later)?", 4),
    (r"(?:is |are )?(?:licensed|released|distributed|published|dedicated|available|made available|provided) (?:under|to|by) (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 3),
    (r"under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?{} license", 3),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 3),
    (r"{} license", 2),
]
#: Families whose name is unmistakable also count where it stands alone.
_ALONE = {"general", "lesser", "affero", "mozilla", "eclipse", "creative", "cc0", "unlicense", "wtfpl", "sil", "artistic"}
#: Labels whose names with a version, or whole, count alone; with the priority of a name before "license".
_ALONE_LABELS = {"apache-1.1", "apache-2", "public-domain"}
#: Signatures without a family; fixed values: label, keyword, pattern, priority.
TEXTS = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 4),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 4),
    ("apache-2", "apache", r"apache org licenses license 2 0", 4),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 3),
    ("public-domain", "unencumbered", r"free and unencumbered software released into the public domain", 4),
    ("zlib", "provided", r"this software is provided as is without any express or implied warranty in no event", 4),
    ("proprietary", "rights", r"all rights reserved", 1),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 1),
    ("mit", "sell", r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 4),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", 4),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders", 3),
    ("mit-0", "attribution", r"mit no attribution(?: license)?", 3),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used", 4),
    ("isc", "hereby", r"fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 4),
    ("0bsd", "fee", r"with or without fee is hereby granted the software is provided as is", 4),
    ("bsd-3-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 4),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 4),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 3),
    ("bsd", "tort", r"theory of liability whether in contract strict liability or tort including negligence or otherwise", 2),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license", 3),
    ("apache-2", "basis", r"distributed on an as is basis without warranties or conditions of any kind", 3),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 4),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 4),
    ("gpl-2", "59", r"free software foundation inc 59 temple place", 3),
    ("gpl-2", "franklin", r"free software foundation inc 51 franklin", 3),
    ("gpl-2", "version", r"either version 2 of the license or at your option any later version", 4),
    ("gpl-3", "version", r"either version 3 of the license or at your option any later version", 4),
    ("gpl-2", "general", r"version 2 1991 of the gnu general public license", 4),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 4),
    ("gpl", "received", r"you should have received a copy of the gnu general public license", 3),
    ("gpl-3", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 4),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 4),
    ("lgpl-2.1", "version", r"either version 2 1 of the license or at your option any later version", 4),
    ("lgpl-2", "library", r"gnu library general public license(?: version 2(?: 0)?)?", 2),
    ("agpl-3", "received", r"you should have received a copy of the gnu affero general public license", 4),
    ("agpl-3", "remotely", r"interacting with it remotely through a computer network", 3),
    ("gfdl", "documentation", r"gnu free documentation license(?: version 1 [123])?", 2),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 4),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 4),
    ("mpl-2", "mozilla", r"you can obtain one at (?:http|https) mozilla org mpl 2 0", 4),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1 1", 4),
    ("epl-1", "eclipse", r"eclipse org legal epl v10", 4),
    ("epl-2", "eclipse", r"eclipse org legal epl (?:v20|2 0)", 4),
    ("cpl-1", "common", r"common public license(?: version| v)? 1 0", 3),
    ("cddl-1", "common", r"the contents of this file are subject to the terms of the common development and distribution license", 4),
    ("ms-pl", "microsoft", r"microsoft public license(?: ms pl)?", 3),
    ("ms-rl", "microsoft", r"microsoft reciprocal license(?: ms rl)?", 3),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0", 4),
    ("boost-1", "boost", r"boost org license 1 0 txt", 4),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 4),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 4),
    ("unlicense", "unlicense", r"for more information please refer to (?:http|https) unlicense org", 4),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 4),
    ("public-domain", "domain", r"(?:has been |is |are )?(?:placed|released|put) (?:in|into) the public domain", 3),
    ("public-domain", "dedicate", r"dedicate any and all copyright interest in the software to the public domain", 4),
    ("cc0", "waived", r"(?:has|have) waived all copyright and related or neighboring rights", 4),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 4),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]", 4),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]", 4),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]", 4),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]", 4),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]", 4),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]", 4),
    ("ofl-1.1", "scripts", r"scripts sil org ofl", 4),
    ("ofl-1.1", "reserved", r"copyright (?:[^ ]+ ){1,12}with reserved font name", 4),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl", 4),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl", 4),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by", 3),
    ("python-2", "psf", r"psf license agreement for python", 4),
    ("php-3", "php", r"php license(?: version)? 3(?: 0[01]?)?", 3),
    ("ruby", "ruby", r"distributed under the (?:same )?terms (?:of|as) (?:the )?ruby(?: license)?", 3),
    ("perl", "perl", r"under the same terms as perl itself", 4),
    ("artistic-1", "artistic", r"the artistic license preamble", 4),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 4),
    ("curl", "daniel", r"copyright c 1996 (?:20[0-9][0-9] )?daniel stenberg", 4),
    ("ncsa", "illinois", r"university of illinois ncsa open source license", 4),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version| v)? 1 2", 3),
    ("eupl-1.1", "european", r"european union public licen[cs]e(?: version| v)? 1 1", 3),
    ("afl-3", "academic", r"academic free license(?: version| v)? 3 0", 3),
    ("osl-3", "open", r"open software license(?: version| v)? 3 0", 3),
    ("sspl-1", "server", r"server side public license(?: version| v)?(?: ?1)?", 3),
    ("bsl-1.1", "business", r"business source license(?: version)? 1 1", 3),
    ("elastic-2", "elastic", r"elastic license(?: version)? 2(?: 0)?", 3),
    ("commons-clause", "commons", r"commons clause license condition v(?:ersion)? ?1 0", 4),
    ("json", "evil", r"the software shall be used for good not evil", 4),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 4),
    ("proprietary", "information", r"this (?:file|software|document) contains (?:confidential and proprietary|trade secret|proprietary and confidential) information", 3),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|software|document|material) )?(?:via any medium )?is strictly prohibited", 3),
    ("proprietary", "permission", r"may not be (?:copied|reproduced|published|broadcast|rewritten)(?: (?:or|and) redistributed| [^ ]+){0,4} without (?:prior |express |the )*(?:written )?permission", 2),
    ("noncommercial", "commercial", r"for non commercial (?:use|purposes) only", 2),
    ("noncommercial", "noncommercial", r"for noncommercial (?:use|purposes) only", 2),
    ("noncommercial", "academic", r"for academic (?:use|purposes) only", 2),
    ("noncommercial", "research", r"for research (?:use|purposes) only", 2),
    ("noncommercial", "commercial", r"(?:not for commercial use|no commercial use(?: is)? (?:permitted|allowed))", 2),
]


def rules() -> list[tuple[int, str, str, str, int]]:
    """(order, label, keyword, pattern, priority); the pattern starts and ends at word edges."""
    found = [(label, keyword, form.format(f"(?:{name})"), priority) for form, priority in FORMS for label, keyword, name in FAMILIES]
    found += [(label, keyword, name, 2 if label in _ALONE_LABELS else 1) for label, keyword, name in FAMILIES if keyword in _ALONE or label in _ALONE_LABELS]
    return [(i, label, f" {keyword}", f"(?<= )(?:{pattern})(?= )", priority) for i, (label, keyword, pattern, priority) in enumerate([*TEXTS, *found])]


def _traces() -> str:
    """A pattern over a text as it is that stands in every text with a detection.

    Each rule gives what it cannot do without: a form its part on one side of the
    name, a name that counts alone its keyword, other signatures their whole pattern.
    """
    cues = [before if not after or after.endswith("?") else after for before, after in (form.split("{}") for form, _ in FORMS)]
    cues += [keyword for label, keyword, _ in FAMILIES if keyword in _ALONE or label in _ALONE_LABELS]
    cues += [*(pattern for _, _, pattern, _ in TEXTS), *BASE]
    first: dict[str, list[str]] = {}  # by first letter, so a word is held against few of them
    for cue in dict.fromkeys(c.strip() for c in cues):
        alone = cue[0].isalnum() and cue[1:2] not in ("?", "*", "+", "{")
        first.setdefault(cue[0] if alone else "", []).append(cue[1:] if alone else cue)
    either = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in first.items())
    return rf"(?i)(?:^|[{_SEP}])(?:{either})".replace("[^ ]", f"[^{_SEP}]").replace(" ", f"[{_SEP}]+")


def _words_in(piece: Column) -> Column:
    """Words of a piece of the line that starts and ends with a blank."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))) - 1


def _places(line: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of a pattern's matches, left to right."""
    gaps, found = F.split(line, pattern), F.regexp_extract_all(line, pattern, F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, pair):
        start = state["at"] + _words_in(pair["gap"])
        end = start + _words_in(pair["match"]) + 2
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def scan_licenses(df: DataFrame, text_column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and: n_words, base (struct of label, start), detections (label, priority, start, end)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, upper, lower), rf"[{_SEP}]+", " ")), F.lit(" "))
    rows = df.select(*keys, F.col(text_column).alias("_text"))
    rows = rows.select(*keys, F.regexp_count(text, F.lit(rf"[^{_SEP}]+")).cast("long").alias("n_words"), F.when(F.col("_text").rlike(_traces()), line).alias("_line"))
    no_base = F.array().cast("array<struct<label:string,start:int>>")
    labelled = lambda label: lambda p: F.struct(F.lit(label).alias("label"), p["start"].alias("start"))
    base = F.concat(*(
        F.coalesce(F.transform(F.when(F.contains(F.col("_line"), F.lit(f" {phrase} ")), _places(F.col("_line"), F.lit(f"(?<= ){phrase}(?= )"))), labelled(label)), no_base)
        for phrase, label in BASE.items()))
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"), F.lit(p).alias("priority")) for i, label, keyword, pattern, p in rules()))
    hits = F.flatten(F.transform(
        F.filter(table, lambda r: F.contains(F.col("_line"), r["keyword"])),
        lambda r: F.transform(_places(F.col("_line"), r["pattern"]), lambda p: F.struct(r["i"].alias("i"), r["label"].alias("label"), r["priority"].alias("priority"), p["start"].alias("start"), p["end"].alias("end")))))
    none = F.array().cast("array<struct<i:int,label:string,priority:int,start:int,end:int>>")
    rows = rows.select(*keys, "n_words", base.alias("base"), F.coalesce(F.when(F.col("_line").isNotNull(), hits), none).alias("_hits"))
    inside = lambda h, o: (o["start"] <= h["start"]) & (o["end"] >= h["end"]) & (o["priority"] >= h["priority"]) & ((o["start"] < h["start"]) | (o["end"] > h["end"]) | (o["priority"] > h["priority"]) | (o["i"] < h["i"]))
    kept = F.filter("_hits", lambda h: ~F.exists("_hits", lambda o: inside(h, o)))
    return rows.select(*keys, "n_words", "base", F.transform(F.sort_array(F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), h["priority"].alias("priority")))), lambda h: F.struct(h["label"].alias("label"), h["priority"].alias("priority"), h["start"].alias("start"), h["end"].alias("end"))).alias("detections"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts, base = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"])
    own = F.transform("detections", lambda d: d["label"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 4.0
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        join(base).alias("base_labels"), join(F.concat(base, own)).alias("labels"), F.greatest(best, F.when(F.size("base") > 0, 0.75).otherwise(0.0)).alias("score"))
