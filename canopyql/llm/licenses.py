"""License scans by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright notices gone, punctuation, white space and line
ends to single blanks, equivalent spellings made one), and the SHA-256 of the form is joined with the digests
of known license texts and notices. Entire texts are looked up: the whole document, whatever its line breaks,
and each of its lines as a text of its own, which is how documents carry notices. A copyright notice is a
line that begins with the word or sign in one of its usual forms: followed by the sign, a year or a place for
one; other lines that begin with the word are text.

Defined results: one row for each row of the table; a null text is the empty text and matches nothing; of
several licenses that a whole text could match (known texts with equal forms) the first by name is reported;
a null id is an id; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyql.session import table

#: Spellings that public license-matching guidelines take as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. "
)
_GNU = (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"))
_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")


#: Full texts as published, a file a license.
TEXTS = Path(__file__).parent / "license_texts"


def _forms(text: str) -> list[str]:
    """The text with its own line breaks, and with each paragraph on one line."""
    return [text, "\n\n".join(" ".join(x.split()) for x in re.split(r"\n[^\S\n]*\n", text))]


def _published() -> list[tuple[str, str]]:
    """(license, text): the full texts in TEXTS, with and without the part on how to apply them, and their standard headers."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}
    bsd = texts.pop("BSD-3-Clause")
    out = list(texts.items())
    for name, text in texts.items():
        if (end := re.search(r"END OF TERMS AND CONDITIONS", text)) is not None:
            out.append((name, text[: end.start()]))
            out.append((name, text[: end.end()]))
    out.append(("Apache-2.0", texts["Apache-2.0"][texts["Apache-2.0"].rindex("   Licensed under the Apache") :]))
    mpl = texts["MPL-2.0"]
    out.append(("MPL-2.0", mpl[mpl.index("  This Source Code Form is subject to") : mpl.index("If it is not possible or desirable")]))
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1"):
        header = re.search(r"This (program|library) is free software(?s:.*?)(?=\nAlso add information)", texts[name])[0]
        out.append((name, header))
        if name == "GPL-3.0":
            out += [(f"{k}-3.0", header.replace("GNU General", f"GNU {v}")) for k, v in (("LGPL", "Lesser General"), ("AGPL", "Affero General"))]
    generic = bsd.replace("the University nor", "the copyright holder nor").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    for three in (bsd, generic):
        two = re.sub(r"3\. Neither(?s:.*?)permission\.\n", "", three)
        for name, text in (("BSD-3-Clause", three), ("BSD-2-Clause", two)):
            for t in (text, text.replace("All rights reserved.\n", "")):
                for u in (t, re.sub(r"(?m)^[123]\. ", "* ", t)):
                    out += [(name, title + u) for title in ("", f"BSD {name[4]}-Clause License\n\n", f"The BSD {name[4]}-Clause License\n\n")]
    return [(name, form) for name, text in out for form in _forms(text)]


def known_texts() -> list[tuple[str, str]]:
    """(license, text): full texts, standard headers, and the usual one-line notices."""
    full = [
        ("MIT", _MIT + _WARRANTY),
        ("MIT", "MIT License " + _MIT + _WARRANTY),
        ("MIT", "The MIT License (MIT) " + _MIT + _WARRANTY),
        ("MIT-0", _MIT.split(", subject to")[0] + ". " + _WARRANTY),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
        ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
        ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ]
    plain = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "MIT License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "Mozilla Public License, Version 2.0", "ISC": "ISC License", "Unlicense": "Unlicense", "EPL-2.0": "Eclipse Public License, Version 2.0"}
    for short, long in _GNU:
        for v in ("2", "2.1", "3") if short == "LGPL" else ("3",) if short == "AGPL" else ("2", "3"):
            plain[f"{short}-{v}{'' if '.' in v else '.0'}"] = f"GNU {long}, version {v}"
    for c in _CC:
        for v in ("3.0", "4.0"):
            plain[f"CC-{c}-{v}"] = f"CC {c} {v}"
    plain["CC0-1.0"] = "CC0 1.0"
    notices = [(k, t.format(n)) for k, n in plain.items() for t in ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This program is licensed under the {}.", "Distributed under the {}.", "SPDX-License-Identifier: " + k)]
    return [*full, *_published(), *notices, ("LicenseRef-all-rights-reserved", "All rights reserved.")]


#: A line that is a copyright notice, in lower case.
_SIGN, _YEAR = r"(?:\(c\)|©)", r"(?:[0-9]{4}|[\[<{(]?(?:year|yyyy)[\]>})])"
_COPYRIGHT = rf"(?m)^[^\p{{L}}\p{{N}}(©\n]*(?:copyright[ \t:]*(?:{_SIGN}|{_YEAR})|{_SIGN}[ \t]*(?:copyright|{_YEAR})|©)[^\n]*$"
_JUNK = r"[^\p{L}\p{N}\n]+"
_PLAIN_COPYRIGHT, _PLAIN_JUNK = (re.compile(x.replace(r"\p{L}\p{N}", r"\w")) for x in (_COPYRIGHT, _JUNK))


def canonical_text(text: str) -> str:
    """The canonical form of a known text, in plain Python."""
    t = _PLAIN_JUNK.sub(" ", _PLAIN_COPYRIGHT.sub("", text.lower())).replace("_", " ")
    t = " ".join(t.split())
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def _spelled(t: Column) -> Column:
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def with_forms(docs: DataFrame, text: Column) -> DataFrame:
    """Adds whole, the canonical form of the text, and lines, those of its lines that are not empty."""
    docs = docs.withColumn("_t", F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), _JUNK, " "))
    lines = F.filter(F.transform(F.split(_spelled(F.col("_t")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.withColumns({"whole": _spelled(F.trim(F.regexp_replace("_t", "[ \n]+", " "))), "lines": lines}).drop("_t")


def known_digests(spark) -> DataFrame:
    """(digest, known): a table as small as the list of known texts."""
    rows: dict[str, str] = {}
    for name, text in known_texts():
        digest = hashlib.sha256(canonical_text(text).encode()).hexdigest()
        rows[digest] = min(name, rows.get(digest, name))
    return spark.createDataFrame(sorted(rows.items()), "digest string, known string")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, notices, n_notice_lines): the license that the whole text is, those that lines are (by name), and how many lines."""
    forms = with_forms(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"))
    # rows are told apart by their place in the input while their lines are looked up
    rows = forms.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_insert(F.transform("lines", lambda x: F.sha2(x, 256)), 1, F.sha2("whole", 256)).alias("all"))
    texts = rows.select("doc_id", "row", F.posexplode("all").alias("at", "digest"))
    found = texts.join(F.broadcast(known_digests(docs.sparkSession)), "digest", "left")
    line = F.when(F.col("at") > 0, F.col("known"))
    whole, notices = F.min(F.when(F.col("at") == 0, F.col("known"))), F.array_join(F.sort_array(F.collect_set(line)), ",")
    out = found.groupBy("row", "doc_id").agg(whole.alias("license_id"), notices.alias("notices"), F.count(line).alias("n_notice_lines"))
    return out.drop("row")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    values = {}
    for name, text in known_texts():
        digest = hashlib.sha256(canonical_text(text).encode()).hexdigest()
        values[digest] = min(name, values.get(digest, name))
    spelled = lambda t: reduce(lambda x, p: f"replace({x}, '{p[0]}', '{p[1]}')", SPELLINGS, t)
    return f"""
WITH known(digest, known) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in sorted(values.items()))}),
t AS (SELECT doc_id, row_number() OVER () AS place, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{_COPYRIGHT}', '', 'g'), '{_JUNK}', ' ', 'g') AS t FROM documents),
x AS (
  SELECT doc_id, place, 0 AS at_line, sha256({spelled("trim(regexp_replace(t, '[ ' || chr(10) || ']+', ' ', 'g'))")}) AS digest FROM t
  UNION ALL SELECT doc_id, place, 1 AS at_line, sha256(u) AS digest FROM (SELECT doc_id, place, trim(unnest(string_split({spelled("t")}, chr(10)))) AS u FROM t) WHERE u <> ''
)
SELECT doc_id, min(CASE WHEN at_line = 0 THEN known END) AS license_id,
       coalesce(string_agg(DISTINCT CASE WHEN at_line = 1 THEN known END, ',' ORDER BY CASE WHEN at_line = 1 THEN known END), '') AS notices,
       count(CASE WHEN at_line = 1 THEN known END) AS n_notice_lines
FROM x LEFT JOIN known USING (digest) GROUP BY doc_id, place
"""


OP7_SQL = op7_sql()
