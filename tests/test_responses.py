"""Answers of a model: each way to be refused, and what a reason must go with."""

import json

import pytest

from quoteloom.operators import responses

ONE = {"decision": "MATCH", "confidence": "HIGH", "matched_attributes": ["a", "a"], "conflicting_attributes": [], "missing_critical_attributes": [], "reason_code": "same"}
TWO = {**ONE, "reason_code": "MATCH_EXACT_PRODUCT_CONTEXT", "matched_attributes": [{"dimension": "CAPACITY", "detail": "4TB"}, {"detail": "x", "dimension": "CAPACITY"}], "conflict_classes": ["BRAND"]}


def problems(spark, parse, cases):
    rows = spark.createDataFrame([(k, c if c is None or isinstance(c, str) else json.dumps(c)) for k, c in enumerate(cases)], "k int, raw string")
    return {r.k: r for r in parse(rows).collect()}


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


SHAPES = [
    (None, "EMPTY"), (" \n", "EMPTY"), ("```json\n{}\n```", "CODE_FENCE"), ("Sure: {}", "NOT_AN_OBJECT"), ("{} done", "NOT_AN_OBJECT"), ("[1]", "NOT_AN_OBJECT"), ('{"decision": }', "INVALID_JSON"), ("{}{}", "INVALID_JSON"), ('{"a": NaN}', "INVALID_JSON"),
    ("{}", "MISSING_KEYS"),
]


@pytest.mark.parametrize("parse,good", [(responses.parsed_v1, ONE), (responses.parsed_v2, TWO)])
def test_shape(spark, parse, good):
    cases = [*SHAPES, (json.dumps(good).replace("{", '{"decision": "MATCH", ', 1), "INVALID_JSON"), (without(good, "confidence"), "MISSING_KEYS"), ({**good, "notes": ""}, "UNKNOWN_KEYS"), ({**without(good, "confidence"), "notes": ""}, "MISSING_KEYS")]
    cases += [(f" {json.dumps(good)}\n", None), ({**good, "decision": "match"}, "BAD_DECISION"), ({**good, "decision": 1}, "BAD_DECISION"), ({**good, "confidence": None}, "BAD_CONFIDENCE"), ({**good, "matched_attributes": "x"}, "BAD_MATCHED_ATTRIBUTES")]
    cases += [({**good, "missing_critical_attributes": [1]}, "BAD_MISSING_CRITICAL_ATTRIBUTES"), ({**good, "reason_code": " "}, "BAD_REASON_CODE"), ({**good, "reason_code": 5, "decision": "x"}, "BAD_DECISION")]
    got = problems(spark, parse, [c for c, _ in cases])
    assert [got[k].problem for k in range(len(cases))] == [p for _, p in cases]
    assert got[14].decision == "MATCH" and got[15].decision is None and got[15].reason_code is None


def test_second_contract(spark):
    attribute = {"dimension": "CAPACITY", "detail": "x"}
    no = lambda code, *classes: {**TWO, "decision": "NO_MATCH", "reason_code": code, "conflict_classes": list(classes)}
    cases = [
        (TWO, None), ({**TWO, "reason_code": "NEW"}, "BAD_REASON_CODE"), ({**TWO, "matched_attributes": [attribute, attribute]}, "BAD_MATCHED_ATTRIBUTES"), ({**TWO, "matched_attributes": [{**attribute, "more": 1}]}, "BAD_MATCHED_ATTRIBUTES"), ({**TWO, "matched_attributes": ["x"]}, "BAD_MATCHED_ATTRIBUTES"),
        ({**TWO, "conflicting_attributes": [{"dimension": "COLOUR", "detail": "x"}]}, "BAD_CONFLICTING_ATTRIBUTES"), ({**TWO, "conflicting_attributes": [{"dimension": "BRAND", "detail": 5}]}, "BAD_CONFLICTING_ATTRIBUTES"), ({**TWO, "missing_critical_attributes": ["BRAND", "BRAND"]}, "BAD_MISSING_CRITICAL_ATTRIBUTES"),
        ({**TWO, "missing_critical_attributes": ["MPN_IDENTITY"]}, "BAD_MISSING_CRITICAL_ATTRIBUTES"), ({**TWO, "conflict_classes": ["BRAND", "BRAND"]}, "BAD_CONFLICT_CLASSES"), ({**TWO, "conflict_classes": ["COLOUR"]}, "BAD_CONFLICT_CLASSES"), ({**TWO, "conflict_classes": {}}, "BAD_CONFLICT_CLASSES"),
        ({**TWO, "decision": "UNCERTAIN"}, "REASON_OF_ANOTHER_DECISION"), ({**TWO, "conflict_classes": ["CAPACITY"]}, "HARD_CONFLICT_HIDDEN"), (no("NO_MATCH_CAPACITY", "CAPACITY", "BRAND"), None), (no("NO_MATCH_CAPACITY", "BUNDLE"), "REASON_WITHOUT_ITS_CONFLICT"), (no("NO_MATCH_MULTIPLE_CONFLICTS", "BUNDLE", "BRAND"), "TOO_FEW_HARD_CONFLICTS"),
        (no("NO_MATCH_MULTIPLE_CONFLICTS", "BUNDLE", "CAPACITY"), None), (no("NO_MATCH_OTHER"), "NO_CONFLICT"), (no("NO_MATCH_OTHER", "CONDITION"), None), ({**TWO, "decision": "UNCERTAIN", "reason_code": "UNCERTAIN_MISSING_CRITICAL_ATTRIBUTES"}, "NOTHING_MISSING"),
        ({**TWO, "decision": "UNCERTAIN", "reason_code": "UNCERTAIN_MISSING_CRITICAL_ATTRIBUTES", "missing_critical_attributes": ["BRAND"]}, None), ({**TWO, "decision": "UNCERTAIN", "reason_code": "UNCERTAIN_IDENTIFIER_RELATION", "conflict_classes": ["MPN_IDENTITY"]}, "HARD_CONFLICT_HIDDEN"),
    ]
    got = problems(spark, responses.parsed_v2, [c for c, _ in cases])
    assert [got[k].problem for k in range(len(cases))] == [p for _, p in cases]
    assert [tuple(a) for a in got[0].matched_attributes] == [("CAPACITY", "4TB"), ("CAPACITY", "x")] and got[14].conflict_classes == ["CAPACITY", "BRAND"] and got[1].matched_attributes is None


def test_every_reason_has_one_rule():
    assert len({r[0] for r in responses.REASONS}) == len(responses.REASONS) == 17
    assert all(code.startswith(f"{decision}_") for code, decision, *_ in responses.REASONS)
