r"""License scans by sentence identifiers.

A text is cut into sentences; a sentence that runs over lines is also tried line by line. Each piece
is normalised (lower case, everything but letters and digits to one space) and looked up in a fixed
table of licence sentences; what is found, in order, is the document's identifier sequence. Ordered
rules, the longest first, then claim runs of identifiers, so that a full licence header is reported
once and not again by its parts. An SPDX expression gives the licences of all its operands, and so
does a notice of several licences, if all of their names are known; a field such as ``License: MIT``
at the start of a line is a notice, and an exception to a licence leaves the licence.

Only DataFrame functions are used, all within a row: nothing is shuffled. Null and empty texts have
no licences, repeated rows are scanned each, an empty table gives an empty result, and other columns
but those of the scan's own names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import SPACE_CLASS
from episodica.sources.tables import table

SENTENCE_END = rf"[.!?;]+(?:[{SPACE_CLASS}]+|$)|:[\x20\t]*\n[{SPACE_CLASS}]*|\n[\x20\t]*\n[{SPACE_CLASS}]*"

#: The scan also ends sentences at colons inside a line, but not after an SPDX tag, and at lines that
#: hold comment marks only. ``SENTENCE_END`` stays as the SQL has it.
COMMENT_MARKS = r"[\x20\t\r/*#;%!|'\-]*"
SCAN_END = (
    rf"[.!?;]+(?:[{SPACE_CLASS}]+|$)|:[\x20\t]*\r?\n[{SPACE_CLASS}]*|(?<!(?i:spdx-license-identifier)[\x20\t]{{0,3}}):[{SPACE_CLASS}]+"
    rf"|\n{COMMENT_MARKS}(?=\n)[{SPACE_CLASS}]*"
)
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Normalised sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-the-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice-kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-4-notice": "licensed under cc by nc 4 0",
    "cc-by-4-notice": "licensed under cc by 4 0",
    "cc-by-sa-4-notice": "licensed under cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}

#: Ordered rules, an identifier sequence and the licence that it stands for. Longer
#: sequences come first, and identifiers that a rule has claimed are not seen by later rules.
RULES = (
    (("apache-grant", "apache-comply", "apache-copy", "apache-url", "apache-asis", "apache-see"), "Apache-2.0"),
    (("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl2-terms", "gpl-hope", "gpl-implied", "gpl-see"), "GPL-2.0-or-later"),
    (("mit-title", "mit-grant", "mit-notice-kept", "mit-asis"), "MIT"),
    (("mit-the-title", "mit-grant", "mit-notice-kept", "mit-asis"), "MIT"),
    (("mit-grant", "mit-notice-kept", "mit-asis"), "MIT"),
    (("apache-grant", "apache-comply"), "Apache-2.0"),
    (("gpl-free", "gpl3-terms"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl2-terms"), "GPL-2.0-or-later"),
    (("bsd-grant", "bsd-asis"), "BSD"),
    (("mit-grant", "mit-notice-kept"), "MIT"),
    (("apache-grant",), "Apache-2.0"),
    (("apache-notice",), "Apache-2.0"),
    (("mit-grant",), "MIT"),
    (("mit-notice",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("gpl3-notice",), "GPL-3.0-only"),
    (("gpl3-licensed",), "GPL-3.0-only"),
    (("bsd-grant",), "BSD"),
    (("cc-by-nc-4-notice",), "CC-BY-NC-4.0"),
    (("cc-by-4-notice",), "CC-BY-4.0"),
    (("cc-by-sa-4-notice",), "CC-BY-SA-4.0"),
    (("spdx-apache",), "Apache-2.0"),
    (("spdx-mit",), "MIT"),
    (("spdx-gpl3",), "GPL-3.0-only"),
    (("spdx-bsd3",), "BSD-3-Clause"),
)

#: Fixed values of the scan beyond the SQL's table. Names of licences, normalised, as notices spell them.
_VERSIONED = {
    "GPL": (("gnu general public license", "gnu gpl", "gpl", "general public license"), ("2.0", "3.0")),
    "LGPL": (("gnu lesser general public license", "gnu lgpl", "lgpl", "lesser general public license"), ("2.1", "3.0")),
    "AGPL": (("gnu affero general public license", "gnu agpl", "agpl", "affero general public license"), ("3.0",)),
}
_NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license version 2", "apache 2 0 license", "apache 2 0", "apache 2 license"),
    "MIT": ("mit license", "mit", "expat license"),
    "ISC": ("isc license", "isc"),
    "BSD": ("bsd license", "bsd"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl version 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license", "zlib"),
    "0BSD": ("0bsd license", "0bsd", "zero clause bsd license", "bsd zero clause license"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0", "artistic 2 0"),
    "PostgreSQL": ("postgresql license", "postgresql licence"),
    "WTFPL": ("wtfpl", "wtfpl license", "do what the fuck you want to public license"),
    "X11": ("x11 license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
    **{
        f"CC-{part}-{v}.0": (f"cc {part.lower().replace('-', ' ')} {v} 0", f"creative commons {words} {v} 0 {area} license", f"creative commons {words} {v} 0 license", f"creative commons {words} {v} 0")
        for v, area in (("4", "international"), ("3", "unported"))
        for part, words in (
            ("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"),
            ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"),
        )
    },
}
_LATER = (" or later", " or any later version", " or at your option any later version")


def _names() -> dict[str, str]:
    """Identifiers of licences by normalised name."""
    found = {name: spdx for spdx, spelled in _NAMES.items() for name in spelled}
    for family, (titles, versions) in _VERSIONED.items():
        for v in versions:
            short = v.removesuffix(".0").replace(".", " ")
            numbers = {v.replace(".", " "), short}
            for name in (f"{t}{j}{n}" for t in titles for j in (" version ", " v", " ") for n in numbers):
                found[name] = f"{family}-{v}-only"
                found |= {name + later: f"{family}-{v}-or-later" for later in _LATER}
            found |= {f"{family.lower()}v{n}": f"{family}-{v}-only" for n in numbers}
            found |= {f"{family.lower()}v{n}{later}": f"{family}-{v}-or-later" for n in numbers for later in _LATER}
    return found


#: What may come before the name in a notice; ``NOTICE`` stands for it and is in no normalised text.
NOTICE_START = (
    "^(?:(?:this|the) (?:work|project|software|program|file|code|source code|library|package|document|text|module) is |it is )?"
    "(?:(?:dual |dually )?licensed|released|distributed|published|provided|made available|available) under (?:an? |the )?(?:terms of (?:an? |the )?)?"
)
#: Around the names of a notice of several licences, between them, and behind a name.
NOTICE_AROUND = "^> (?:either of |both |either |both of |your choice of )?(?:the )?| at your (?:option|choice)$"
NOTICE_BETWEEN = " (?:or|and|and or)(?: the)? (?!later|any later|at your option)"
NOTICE_EXCEPTION = " with (?:the )?[a-z0-9 ]+ exception(?: [0-9 ]+)?$"
#: A field at the start of a line, behind comment marks.
FIELD = r"(?im)^([\x20\t/*#;%|'-]*)licen[sc]e[\x20\t]*:[\x20\t]*(?=[a-z0-9])"
NOTICE = "> "

#: The operators of an SPDX expression, and what an exception adds to a licence.
SPDX_TAG = "SPDX-License-Identifier:"
SPDX_OPERATOR = rf"[\x20\t]+(?:AND|OR)(?<={SPDX_TAG}[^\n]{{1,400}})[\x20\t]+"
SPDX_EXCEPTION = rf"[\x20\t]+WITH(?<={SPDX_TAG}[^\n]{{1,400}})[\x20\t]+[A-Za-z0-9.-]+"

_FSF = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation either version {} of the license or at your option any later version"
_BODIES = {
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl21-terms": _FSF.format("lesser", "2 1"),
    "lgpl3-terms": _FSF.format("lesser", "3"),
    "agpl3-terms": _FSF.format("affero", "3"),
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
}
_NOTICE_IDS = {name: "notice-" + spdx.lower() for name, spdx in _names().items()}
_SPDX = {x: x for x in sorted({*_names().values()} - {"BSD"})}
_SPDX |= {f"{f}-{v}": f"{f}-{v}-only" for f, (_, vs) in _VERSIONED.items() for v in vs}
_SPDX |= {f"{f}-{v}+": f"{f}-{v}-or-later" for f, (_, vs) in _VERSIONED.items() for v in vs}


def _scan_sentences() -> dict[str, str]:
    """Sentence to identifier: the SQL's table, then bodies, notices and SPDX tags."""
    found = {v: k for k, v in SENTENCES.items()}
    for k, v in _BODIES.items():
        found.setdefault(v, k)
    for name, k in _NOTICE_IDS.items():
        found.setdefault(NOTICE + name, k)
    for tag, spdx in _SPDX.items():  # a plus is lost when a text is normalised; it is written out before
        found.setdefault("spdx license identifier " + " ".join(tag.lower().replace("+", " or later").replace("-", " ").replace(".", " ").split()), "notice-" + spdx.lower())
    return found


SCAN_SENTENCES = _scan_sentences()
SCAN_RULES = (
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    *RULES,
    *(((k,), spdx) for k, spdx in (("lgpl21-terms", "LGPL-2.1-or-later"), ("lgpl3-terms", "LGPL-3.0-or-later"), ("agpl3-terms", "AGPL-3.0-or-later"))),
    (("gpl3-terms",), "GPL-3.0-or-later"),
    (("gpl2-terms",), "GPL-2.0-or-later"),
    (("isc-grant",), "ISC"),
    (("mpl2-form",), "MPL-2.0"),
    *((("notice-" + spdx.lower(),), spdx) for spdx in sorted({*_names().values()})),
    (("mit-notice-kept",), "MIT"),
    (("mit-asis", "mit-liability"), "MIT"),
    (("apache-asis",), "Apache-2.0"),
    (("bsd-source",), "BSD"),
    (("bsd-binary",), "BSD"),
    (("bsd-asis",), "BSD"),
)


def normalised(piece: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(piece), NOT_WORD, " "))


def looked_up(piece: Column) -> Column:
    """A piece as the table has it: normalised, the start of a notice as ``NOTICE``."""
    plain = normalised(F.regexp_replace(piece, r"(?i)(spdx-license-identifier\s*:[\s(]*[a-z]+-[0-9.]+)\+", "$1-or-later"))
    own = plain.isin([*SENTENCES.values()])
    return F.when(own | ~F.contains(plain, F.lit(" under ")), plain).otherwise(F.regexp_replace(plain, NOTICE_START, NOTICE))


def named_in(notice: Column) -> Column:
    """The parts of a normalised notice of several licences or with an exception, each as a notice of its own."""
    bare = F.regexp_replace(F.regexp_replace(notice, NOTICE_EXCEPTION, ""), NOTICE_AROUND, "")
    return F.transform(F.split(bare, NOTICE_BETWEEN), lambda x: F.concat(F.lit(NOTICE), F.regexp_replace(x, NOTICE_EXCEPTION, "")))


def fields_as_notices(text: Column) -> Column:
    """``text`` with ``License: X`` at the start of a line said as a notice."""
    return F.when(F.contains(F.lower(text), F.lit("licen")), F.regexp_replace(text, FIELD, "$1Licensed under ")).otherwise(text)


def tags_apart(text: Column) -> Column:
    """``text`` with every operand of an SPDX expression under a tag of its own, without exceptions."""
    plain = F.regexp_replace(text, SPDX_EXCEPTION, "")
    return F.when(F.contains(text, F.lit(SPDX_TAG)), F.regexp_replace(plain, SPDX_OPERATOR, f"\n{SPDX_TAG} ")).otherwise(text)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    known = list(SCAN_SENTENCES)
    by_sentence = F.create_map(*[F.lit(x) for pair in SCAN_SENTENCES.items() for x in pair])
    whole = F.transform(F.split(tags_apart(fields_as_notices(F.coalesce(text, F.lit("")))), SCAN_END), lambda s: F.struct(looked_up(s).alias("n"), s.alias("raw")))
    pieces = F.transform(
        whole,
        lambda s: F.when(s["n"].isin(known), F.array(s["n"]))
        .when(F.startswith(s["n"], F.lit(NOTICE)) & F.forall(named_in(s["n"]), lambda x: x.isin(known)), named_in(s["n"]))
        .when(F.contains(s["raw"], F.lit("\n")), F.filter(F.transform(F.split(s["raw"], "\n"), looked_up), lambda x: x.isin(known)))
        .otherwise(F.array().cast("array<string>")),
    )
    return F.transform(F.flatten(pieces), lambda x: by_sentence[x])


def licences(ids: Column) -> Column:
    """Licences that the ordered rules find in an identifier sequence: sorted, each once."""
    rules = F.array(*[F.struct(F.lit(" " + " ".join(seq) + " ").alias("seq"), F.lit(name).alias("name")) for seq, name in SCAN_RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(
        rules,
        start,
        lambda a, r: F.when(
            F.contains(a["rest"], r["seq"]),
            F.struct(F.replace(a["rest"], r["seq"], F.lit(" # ")).alias("rest"), F.concat(a["found"], F.array(r["name"])).alias("found")),
        ).otherwise(a),
    )
    return F.array_sort(F.array_distinct(found["found"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``sentence_ids`` and ``licences`` (arrays)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "sentence_ids", "licences")]
    named = docs.select(*others, sentence_ids(F.col(f"`{text}`")).alias("sentence_ids"))
    has = F.size("sentence_ids") > 0
    return named.withColumn("licences", F.when(has, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences, and the sentences that gave them, of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join("licences", ",").alias("licences"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentences"),
    )


def _oracle() -> str:
    sentences = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    rest, steps = "s0", []
    for n, (seq, name) in enumerate(RULES):
        steps.append(
            f"r{n} AS (SELECT * EXCLUDE (s, f), replace(s, ' {' '.join(seq)} ', ' # ') AS s,"
            f" CASE WHEN contains(s, ' {' '.join(seq)} ') THEN list_append(f, '{name}') ELSE f END AS f FROM {rest})"
        )
        rest = f"r{n}"
    norm = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH k(sentence, id) AS (VALUES {sentences}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, raw, pos, {norm.format("raw")} AS n
      FROM (SELECT rid, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos
            FROM (SELECT rid, string_split_regex(text, '{SENTENCE_END}') AS parts FROM d))),
l AS (SELECT rid, pos, 0 AS line, n FROM p WHERE n IN (SELECT sentence FROM k)
      UNION ALL
      SELECT rid, pos, line, {norm.format("raw")} AS n
      FROM (SELECT rid, pos, unnest(string_split(raw, chr(10))) AS raw, generate_subscripts(string_split(raw, chr(10)), 1) AS line
            FROM p WHERE contains(raw, chr(10)) AND n NOT IN (SELECT sentence FROM k))),
i AS (SELECT rid, list(id ORDER BY pos, line) AS ids FROM l JOIN k ON n = sentence GROUP BY rid),
s0 AS (SELECT doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(coalesce(ids, []), ' ') || ' ' AS s, []::VARCHAR[] AS f
       FROM d LEFT JOIN i USING (rid)),
{", ".join(steps)}
SELECT doc_id, len(list_distinct(f))::BIGINT AS n_licences, array_to_string(list_sort(list_distinct(f)), ',') AS licences,
       len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentences
FROM {rest}
"""


OP9_SQL = _oracle()
