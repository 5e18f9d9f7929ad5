"""Quality rules and licence scans."""

import pytest
from pyspark.sql import functions as F

from quillveil.llm import quality as Q
import quillveil.llm.license_scan as L
from quillveil.llm.license_scan import TEMPLATES, _table, families_told, paragraphs_of, scan_licenses, scan_paragraphs, train, vocabulary, words_of
from tests.llm import reference as R


def test_quality(docs, rows, odd, none):
    for df, source in ((docs, rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.score_documents(df).collect()}
        assert got == {i: R.quality(t) for i, t in source}
    assert Q.score_documents(none).count() == 0


def test_quality_long_text_compares_in_full(spark, monkeypatch):
    monkeypatch.setattr(Q, "_PLACE_BITS", 5)
    text = " ".join(f"w{i % 37} x{i % 11}" for i in range(90))
    df = spark.createDataFrame([(1, text), (2, "a b c d a b c")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in Q.score_documents(df).collect()} == {1: R.quality(text)[4], 2: 6}


def test_quality_plan_is_one_projection(docs):
    plan = Q.score_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Generate"))


def test_labels(spark, small, docs):
    """Documents labelled good fail by the base rule alone; those labelled bad all go."""
    judged = Q.score_documents(docs).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 1 AND NOT kept AND NOT base_failed").count() == 0
    assert judged.filter("quality = 0 AND kept").count() == 0


def test_apply_rules_keeps_columns(spark, docs):
    df = docs.withColumn("_quality", F.lit(1)).withColumn("kept", F.lit("x"))
    out = Q.apply_rules(df)
    assert out.schema == df.schema
    assert out.count() == Q.score_documents(docs).filter("kept").count()


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD",
    "Code in this folder is released under the terms of the MIT license, see below": "MIT",
    "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL",
}
PLAIN = ["He renewed his driving license in May.", "The general spoke to the public about the version of the plan.", "Mit der Zeit kam die Antwort.", "", "The software was released yesterday.", "All work and no play"]


@pytest.fixture(scope="module")
def model(spark, docs):
    telling = [f for f in vocabulary() if " " not in f]
    return train(spark, docs.select(F.inline(paragraphs_of(F.coalesce("text", F.lit("")), telling))).filter("NOT inside").select("words"))


def worded(df):
    return df.withColumn("words", words_of(F.col("text")))


def test_families(spark, model):
    rows = [(i, t) for i, t in enumerate([*LINES, *PLAIN])]
    df = spark.createDataFrame(rows, "at int, text string")
    got = {r.at: (r.family, r.confirmed) for r in scan_paragraphs(worded(df), model, ["at"]).collect()}
    want = {i: (f, True) for i, f in enumerate(LINES.values())}
    assert {i: v for i, v in got.items() if v[1]} == want


def test_held_out_accuracy(spark, model):
    """Notices cut to two thirds and embedded in words that training did not see: those that still tell their family are found, those that do not are unknown."""
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            rows.append((len(rows), family, "Please note today: " + " ".join(w[: max(6, len(w) * 2 // 3)]) + " and so on"))
    told = {n for n, family, t in rows if family in families_told(t)}
    df = _table(spark, rows, "at int, want string, text string")
    got = {r.at: (r.want, r.family) for r in df.join(scan_paragraphs(worded(df).select("at", "words"), model, ["at"]), "at", "left").select("at", "want", "family").collect()}
    assert len(told) > 50
    assert sum(got[n][0] == got[n][1] for n in told) >= 0.9 * len(told)
    assert sum(f is not None and f != want for want, f in got.values()) <= 0.03 * len(got)


def test_scan(spark, docs, odd, none):
    text = "Some words.\nReleased under the MIT License.\n\nLicensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "plain", 0), (1, text, 0), (None, text, 0)], "doc_id bigint, text string, license int")
    got = sorted(((r.doc_id, r.n_lines, r.n_notices, tuple(r.families)) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, 3, 2, ("Apache", "MIT")), (1, 3, 2, ("Apache", "MIT")), (2, 0, 0, ()), (3, 1, 0, ()), (None, 3, 2, ("Apache", "MIT"))], key=str)
    assert scan_licenses(odd).filter("n_notices > 0").count() == 0
    assert scan_licenses(none).count() == 0


ISC = TEMPLATES["ISC"][2]
MIT = TEMPLATES["MIT"][5] + ". " + TEMPLATES["MIT"][6]


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def scanned(df, model):
    return [(r.doc_id, r.n_lines, [tuple(n) for n in r.notices or []], list(r.families), r.license) for r in scan_licenses(df, model=model).orderBy("doc_id").collect()]


def test_wrapped_notices(spark, model):
    """A notice over several lines is one paragraph; neighbours of several families are told apart."""
    rows = [(1, wrapped(ISC, 70)), (2, "Words of the village.\n" + wrapped(MIT, 60) + "\nThe end."), (3, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (4, wrapped(TEMPLATES["GPL"][5], 50)), (5, "MIT License"), (6, "License: MIT\n" + "table " * 9)]
    got = {i: f for i, _, _, f, _ in scanned(spark.createDataFrame(rows, "doc_id bigint, text string"), model)}
    assert got == {1: ["ISC"], 2: ["MIT"], 3: ["Apache", "MIT"], 4: ["GPL"], 5: ["MIT"], 6: ["MIT"]}


def test_scan_is_the_brute_force(spark, docs, rows, model):
    """The query's rows are those of a plain loop over lines with the fitted numbers."""
    made = [(10_000 + i, wrapped(t, 40)) for i, t in enumerate([ISC, MIT, "x " * 30 + MIT, "The general public.\n" + ISC, "a\n\nb", *LINES, *PLAIN])]
    long = "\n".join(["The river is in the mountains."] * 20_000 + list(LINES))
    source = [*rows, *made, (20_000, long), (20_001, None)]
    for i, n, notices, families, license_ in scanned(spark.createDataFrame(source, "doc_id bigint, text string").repartition(4), model):
        want = R.licenses(dict(source)[i], model, TEMPLATES)
        assert (n, families, license_) == (want[0], want[2], want[3]), i
        assert [x[:3] + (x[5],) for x in notices] == [x[:3] + (x[5],) for x in want[1]]
        assert [x[3:5] for x in notices] == [pytest.approx(x[3:5], abs=2e-6) for x in want[1]]


def test_too_many_features_are_an_error(monkeypatch):
    monkeypatch.setattr(L, "MAX_FEATURES", 100)
    with pytest.raises(ValueError, match="MAX_FEATURES"):
        vocabulary()


def test_scan_plan_is_native(spark, docs, model):
    plans = [scan_licenses(docs, model=model), scan_paragraphs(worded(docs.select(F.col("doc_id").alias("at"), "text")), model, ["at"])]
    for p in plans:
        assert not any(x in p._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "ExistingRDD"))
