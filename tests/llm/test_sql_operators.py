"""Operators with SQL against it, and every operator on awkward tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from canopyql.llm import bpe, dedup, extraction, fingerprint, licenses, mixing, ppm, quality, registry, toxicity, warc
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, sf, name):
    assert_same(spark, con, sf, registry.queries()[name], registry.oracle_sql()[name])


# nulls in every column, empty texts, repeated rows, ties, a long text, and clashing extra columns
AWKWARD = [
    (1, "one two three four five six", "en", "a", 5, 0.5, 1),
    (1, "one two three four five six", "en", "a", 5, 0.5, 1),
    (2, "", None, None, None, None, None),
    (None, None, None, "a", 0, 0.1, None),
    (None, "text of nobody at all here", "en", None, 0, 0.1, 2),
    (3, "   \n\t ", "en", "b", 0, 0.0, 3),
    (4, "word " * 60_000, "en", "a", 1, 0.2, 4),
    (5, "ONE,\x1c two three   <|endoftext|> \U0001f600 é", "de", "c", 1, 0.2, 5),
    (6, "one two three four five six", "en", "b", 1, 0.2, 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int, score double, level int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("row", F.lit("x")).withColumn("target", F.lit(None).cast("string"))


LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "ppm": lambda d: ppm.scores(d),
    "bpe": lambda d: bpe.encode_decode(d),
    "dedup": lambda d: dedup.classes(d),
    "deduplicate": lambda d: dedup.deduplicate(d),
    "licenses": lambda d: licenses.scan(d),
    "quality": lambda d: quality.verdicts(d),
    "quality_filter": lambda d: quality.quality_filter(d),
    "mixing": lambda d: mixing.rates(d),
    "mix": lambda d: mixing.mix(d),
    "fingerprint": lambda d: fingerprint.with_next(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))),
    "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, d.sparkSession.createDataFrame([(1, 1, 1), (2, 1, 0), (None, None, None)], LABELS))),
    "toxicity_filter": lambda d: toxicity.toxicity_filter(d, {"constant": 0.0}),
    "warc": lambda d: warc.read_archives(d.sparkSession, warc.write_archives(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url"), "row"))),
    "extraction": lambda d: extraction.extract(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "lang", F.lit(1).alias("n_chars"))),
}
ONE_ROW_EACH = {"ppm": len(AWKWARD), "bpe": len(AWKWARD), "dedup": len(AWKWARD), "licenses": len(AWKWARD), "quality": len(AWKWARD), "mixing": len(AWKWARD), "fingerprint": len(AWKWARD), "toxicity": len(AWKWARD), "toxicity_filter": len(AWKWARD), "warc": len(AWKWARD), "extraction": len(AWKWARD)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == ONE_ROW_EACH[name]
    if name == "deduplicate":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)[0] == (False, 1)
        assert set(rows[0].asDict()) == set(docs.columns)
    if name == "mix":
        assert set(rows[0].asDict()) == set(docs.columns)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_equal_rows_get_equal_answers(docs):
    d = {}
    for r in dedup.classes(docs).collect():
        d.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert d[1] == d[6] == {1}
    assert {r["ids"].__repr__() for r in bpe.encode_decode(docs).where("doc_id = 1").collect()}.__len__() == 1


def test_dates_are_carried(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", datetime.date(2020, 1, 1))], "doc_id long, text string, lang string, source string, day date")
    assert bpe.encode_decode(d).first()["day"] == datetime.date(2020, 1, 1)


COMMON = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}


def test_whole_license_texts(spark):
    rows, want = [], []
    for file, name in WHOLE.items():
        with open(f"{COMMON}/{file}", encoding="utf-8") as f:
            t = f.read()
        rows += [t, "\n".join(" " * 4 + x for x in t.split("\n")), t + "One more word."]
        want += [name, name, None]
        if file == "BSD":
            two = t[: t.index("3. Neither")] + t[t.index("\nTHIS SOFTWARE") :]
            rows += [two.replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR"), "Copyright 2020 X. All rights reserved.\n" + t.split("\n", 2)[2]]
            want += ["BSD-2-Clause", "BSD-3-Clause"]
        if file == "Apache-2.0":
            rows += [t[: t.index("   APPENDIX")], t[t.rindex("   Copyright [yyyy]") :]]
            want += [name, name]
        if file == "GPL-3":
            rows.append(t[t.index("    This program is free") : t.index("Also add")])
            want.append(name)
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [r["license_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == want


def test_licenses_at_every_width(spark, sf):
    import textwrap

    import duckdb

    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + licenses._MIT + "\n\n" + licenses._WARRANTY
    bsd = (licenses.TEXTS / "BSD-3-Clause.txt").read_text()
    wrapped = lambda t, w: "\n\n".join(textwrap.fill(x, w) for x in t.split("\n\n"))
    rows = [(w, wrapped(mit, w)) for w in range(40, 120)] + [(200, mit), (201, mit.replace("\n", "\r\n")), (202, "copyright notice and this permission notice"), (203, "# " + mit.replace("\n", "\n# "))]
    rows += [(300, "\u00a9 1999 X\n" + bsd), (301, "Copyright [yyyy] [name]\nLicence: none\nAll rights reserved."), (302, None), (302, "(c) You must retain"), (303, "SPDX-License-Identifier: MIT\nint main() {}")]
    want = {i: "MIT" for i in [*range(40, 120), 200, 201, 203]} | {300: "BSD-3-Clause"}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["license_id"], r["notices"], r["n_notice_lines"]) for r in licenses.scan(d).collect()]
    assert {i: x for i, x, _, _ in got if x} == want and len(got) == len(rows)
    assert [x[2:] for x in sorted(got, key=lambda x: x[0]) if x[0] in (301, 303)] == [("LicenseRef-all-rights-reserved", 1), ("MIT", 1)]
    documents = d.toPandas()  # noqa: F841
    assert sorted(map(repr, duckdb.sql(licenses.OP7_SQL).fetchall())) == sorted(map(repr, got))
