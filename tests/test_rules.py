import json
import time

import pytest

from quillveil.operators.matching import PatternTimeout, find_hits, next_lines, pair_hits
from quillveil.plans.rules import RequestError, page_scope, parse_request, preset_rules, regex_rules, resolve_language, search_rule


def matches(spark, text, rules, page=0):
    pages = spark.createDataFrame([(1, page, text)], "doc_id bigint, page int, text string")
    return sorted(r.match for r in find_hits(pages, rules).collect())


def test_whole_word_and_part(spark):
    assert matches(spark, "CAT CATCH", [search_rule("CAT")]) == ["CAT"]
    assert matches(spark, "CAT CATCH", regex_rules("CAT")) == ["CAT", "CAT"]


def test_whole_word_beside_marks(spark):
    assert matches(spark, "DUPONT, x.dupont@a.org l'dupont-x édupont", [search_rule("Dupont")]) == ["DUPONT", "dupont", "dupont"]


def test_accents_both_ways(spark):
    assert matches(spark, "Léo Leo", [search_rule("Leo")]) == ["Leo", "Léo"]
    assert matches(spark, "Léo Leo", regex_rules("léo")) == ["Leo", "Léo"]
    assert matches(spark, "Léo", regex_rules("léo")) == ["Léo"]


def test_decomposed_accents(spark):
    """Letters with their marks apart are found, and go with their marks."""
    text = "e\u0301te\u0301 été ete"
    assert matches(spark, text, [search_rule("ete")]) == sorted(["e\u0301te\u0301", "été", "ete"])
    assert matches(spark, text, [search_rule("e\u0301té")]) == sorted(["e\u0301te\u0301", "été", "ete"])
    assert matches(spark, "Le\u0301ox Le\u0301o", [search_rule("Leo")]) == ["Le\u0301o"]
    assert matches(spark, "cœ\u0301ur co\u0301eur", [search_rule("cœur")]) == sorted(["cœ\u0301ur", "co\u0301eur"])


def test_multiline_user_pattern(spark):
    text = "Jean\n\nDupont x\nJean Dupont"
    assert matches(spark, text, regex_rules("Jean Dupont")) == ["Jean Dupont"]
    assert matches(spark, text, regex_rules("Jean Dupont", multiline=True)) == ["Jean\n\nDupont", "Jean Dupont"]
    assert matches(spark, "a\nb\nc", regex_rules("a b c", multiline=True)) == []


def test_budget_is_time_spent_matching(spark):
    """Two actions on one DataFrame agree however long it was left alone, and a table may take longer than the budget."""
    pages = spark.createDataFrame([(1, 0, "a1 b2")], "doc_id bigint, page int, text string")
    hits = find_hits(pages, regex_rules(r"(?<=b)\d"), budget=0.5)
    assert hits.count() == 1
    time.sleep(0.7)
    assert hits.count() == 1


def test_case_and_space(spark):
    assert matches(spark, "Jean  Dupont jean\ndupont", [search_rule("jean dupont")]) == ["Jean  Dupont", "jean\ndupont"]
    assert matches(spark, "The the", [search_rule("The", case_sensitive=True)]) == ["The"]


def test_welded(spark):
    assert matches(spark, "oﬃce office", [search_rule("office", ignore_accents=False)]) == ["office", "oﬃce"]


def test_lookaround_and_scope(spark):
    assert matches(spark, "a1 b2", regex_rules(r"(?<=b)\d", pages=[0])) == ["2"]
    assert matches(spark, "a1 b2", regex_rules(r"(?<=b)\d", pages=[1])) == []
    assert page_scope([2, 0, 2]) == (2, 0) and page_scope([]) is None


def test_time_budget(spark):
    began = time.time()
    with pytest.raises(Exception, match="budget") as e:
        pages = spark.createDataFrame([(1, 0, "a" * 40 + "!")], "doc_id bigint, page int, text string")
        find_hits(pages, regex_rules(r"(a|aa)+$"), budget=1.0).collect()
    assert "PatternTimeout" in str(e.value) and issubclass(PatternTimeout, ValueError)
    assert time.time() - began < 20


def test_pairs_across_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, "call 06 12 34"), (1, 0, 1, "56 78 now"), (1, 0, 2, "end")], "doc_id bigint, page int, line_no int, text string")
    pairs = next_lines(lines, ["line_no"])
    got = pair_hits(pairs, preset_rules(["phone"])[0]).collect()
    assert [(r.line_no, r.left_span.start, r.left_span.end, r.right_span.start, r.right_span.end) for r in got] == [(0, 5, 13, 0, 5)]


def test_request_is_strict():
    r = parse_request(json.dumps({"search": {"query": " Leo "}, "regexes": [{"patterns": ["a+", " "]}], "presets": {"keys": ["email"]}, "options": {"image_regions": "block"}}))
    assert [x.kind for x in r.rules] == ["search", "regex", "preset"] and r.options.image_mode == "pixels" and r.textual
    for bad in ({"serach": {}}, {"options": {"image_mode": "blur"}}, {"search": {"query": "x", "case": True}}, {"rects": [{"page": -1, "x0": 0, "y0": 0, "x1": 1, "y1": 1}]}):
        with pytest.raises(RequestError):
            parse_request(bad)
    with pytest.raises(RequestError) as e:
        parse_request({"rects": [{"page": 0, "x0": 0, "y0": 0, "x1": 1, "y1": 1}] * 300, "full_page_rects": [{"page": 0}] * 201})
    assert e.value.code == "too_many_rects"
    with pytest.raises(RequestError):
        regex_rules("(")
    with pytest.raises(RequestError):
        search_rule("  ")


def test_language():
    assert resolve_language(None, ["eng", "fra"]) == "fra+eng"
    assert resolve_language("deu", ["eng"]) == "eng"
    assert resolve_language(None, []) is None
