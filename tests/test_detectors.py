import pytest
from pyspark.sql import functions as F

from quillveil.functions import detectors as D
from quillveil.operators.matching import find_hits
from quillveil.plans.rules import preset_rules

#: Candidates and whether they are numbers in France and in the United States.
PHONES = [
    ("06 12 34 56 78", True, False),
    ("+33 6 12 34 56 78", True, True),
    ("0033612345678", True, True),
    ("06.12.34.56.78", True, False),
    ("06-12-34-56-78", True, False),
    ("0612345678", True, False),
    ("+33612345678", True, True),
    ("212 736 5000", False, True),
    ("+1 212 736 5000", True, True),
    ("(212) 736-5000", False, True),
    ("+44 20 7946 0958", True, True),
    ("20 7946 0958", False, True),
    ("06 12 34 56 78 poste 42", True, False),
    ("06 12 34 56 78 ext. 7", True, False),
    ("+33 6 12 34 56 78 x12", True, True),
    ("12 34", False, False),
    ("1", False, False),
    ("123456", False, False),
    ("1234567890123456789012", False, False),
    ("abc", False, False),
    ("", False, False),
    ("   ", False, False),
    ("00 33 6 12 34 56 78", True, True),
    ("99 99 99 99 99", False, False),
    ("07 00 00 00 00", False, False),
    ("+33 1 23 45 67 89", True, True),
    ("2026-06-09", False, False),
    ("4111 1111 1111 1111", False, False),
    ("+41 44 668 18 00", True, True),
    ("044 668 18 00", True, False),
    ("+81 3-1234-5678", True, True),
    ("+351 912 345 678", True, True),
    ("+55 11 91234 5678", True, True),
    ("+61 2 9374 4000", True, True),
    ("+39 06 698 1234", True, True),
    ("+33 0 12", False, False),
    ("+33 812", False, False),
    ("+998 71 123 45 67", True, True),
    ("+999 12", False, False),
    ("06 12 ext 5 34 56 78", True, False),
]


def test_phone_table(spark):
    df = spark.createDataFrame(PHONES, "c string, fr boolean, us boolean")
    got = df.select("c", "fr", "us", D.phone_ok(F.col("c"), "FR").alias("f"), D.phone_ok(F.col("c"), "US").alias("u")).collect()
    assert [(r.c, r.f, r.u) for r in got] == [(r.c, r.fr, r.us) for r in got]


def hits(spark, text, keys):
    pages = spark.createDataFrame([(1, 0, text)], "doc_id bigint, page int, text string")
    return sorted((r.rule_id.split(":")[1], r.match) for r in find_hits(pages, preset_rules(keys)).collect())


def test_email_and_phone_on_one_line(spark):
    assert hits(spark, "write to a.b@mail.example.org or 06 12 34 56 78.", ["email", "phone"]) == [("email", "a.b@mail.example.org"), ("phone", "06 12 34 56 78")]


def test_luhn(spark):
    assert hits(spark, "ok 4111 1111 1111 1111, no 4111 1111 1111 1112", ["card"]) == [("card", "4111 1111 1111 1111")]


def test_plus_belongs_to_the_number(spark):
    assert hits(spark, "Tel: +1 212 736 5000.", ["phone"]) == [("phone", "+1 212 736 5000")]


def test_spans_count_code_points(spark):
    pages = spark.createDataFrame([(1, 0, "😀😀 x@y.org 😀 z@y.org")], "doc_id bigint, page int, text string")
    assert sorted((r.start, r.end) for r in find_hits(pages, preset_rules(["email"])).collect()) == [(3, 10), (13, 20)]


def test_public_key_of_cards(spark):
    assert hits(spark, "4111-1111-1111-1111", ["credit_card"]) == [("credit_card", "4111-1111-1111-1111")]


def test_what_the_email_pattern_accepts(spark):
    assert [m for _, m in hits(spark, "a@b.org a@b..com a@b a.b+c@d-e.fr.", ["email"])] == ["a.b+c@d-e.fr", "a@b..com", "a@b.org"]


def test_unknown_region():
    with pytest.raises(ValueError, match="XX"):
        D.phone_ok(F.lit("1"), "XX")


def test_long_digit_string_ends(spark):
    import time

    began = time.time()
    assert hits(spark, "1 " * 2000, ["card"]) == []
    assert hits(spark, "x" * 100, ["card"]) == []
    assert time.time() - began < 60


def test_registry():
    with pytest.raises(ValueError, match="known: card, credit_card, email, phone"):
        D.detector("nothing")
