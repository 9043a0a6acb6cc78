"""Label and answer checks, use of failed rows, censuses and the choice between systems."""

import json

import pytest

from tidemark.operators import labels as L

TEXT = "The pump broke after two days. Smells awful"
NONE = {"present": False, "phrase": None}


def label(**change):
    return {"themes": [{"theme_id": "damage", "evidence_quote": "pump  BROKE"}], "other": NONE, "abstain": False, "overall_sentiment": "negative", "label_confidence": "high"} | change


@pytest.mark.parametrize("got, faults", [
    (label(), []),
    ([], ["not an object with the five members of a label"]),
    (label(themes=[{"theme_id": "x", "evidence_quote": "pump broke"}]), ["themes[0] is outside the taxonomy"]),
    (label(themes=[{"theme_id": "damage", "evidence_quote": "pump exploded"}]), ["themes[0] quote is no evidence"]),
    (label(themes=[{"theme_id": "damage", "evidence_quote": "pump"}] * 2), ["themes[1] repeats a theme"]),
    (label(themes=[{"theme_id": "damage", "evidence_quote": " "}]), ["themes[0] quote is blank"]),
    (label(themes=None, overall_sentiment="x"), ["unknown sentiment", "themes is no list"]),
    (label(other={"present": True, "phrase": None}), ["other phrase is blank"]),
    (label(other={"present": False, "phrase": "x"}), ["other phrase without other"]),
    (label(themes=[], abstain=True, label_confidence="low"), []),
    (label(abstain=True), ["abstention with themes", "abstention with confidence"]),
])
def test_label_faults(got, faults):
    assert L.label_faults(got, "a title", TEXT, L.Limits(), ("damage", "scent")) == faults


@pytest.mark.parametrize("got, faults", [
    ({"complaints": []}, []),
    ({"complaints": [{"quote": "smells awful", "aspect": "scent"}]}, []),
    ({"complaints": [{"quote": "smells awful", "aspect": "scent"}, {"quote": "Smells  awful", "aspect": "scent"}]}, ["complaints[1] repeats a quote"]),
    ({"complaints": [{"quote": "great", "aspect": "a b c d e f g"}]}, ["complaints[0] aspect is too long", "complaints[0] quote is no evidence"]),
    ({"complaints": [{"quote": 1, "aspect": "x"}]}, ["complaints[0] lacks quote or aspect"]),
    ("x", ["not an object with a list of complaints"]),
])
def test_phrase_faults(got, faults):
    assert L.phrase_faults(got, None, TEXT, L.Limits()) == faults


def answer(**change):
    return {"subject": "s", "subject_supported": True, "refused": False, "refusal_reason": None, "claims": [{"claim": "c", "citations": [{"cite_id": "R1", "window": "w"}]}]} | change


@pytest.mark.parametrize("got, faults", [
    (answer(), []),
    (answer(refused=True, subject_supported=False, claims=[], refusal_reason="none says so"), []),
    (answer(refused=True), ["refused contradicts subject_supported", "refusal with claims", "refusal reason is blank"]),
    (answer(claims=[{"claim": " ", "citations": [{"cite_id": "", "window": "w"}]}]), ["claims[0] is blank", "claims[0] citation 0 lacks handle or window"]),
    (answer(refusal_reason="x"), ["reason without refusal"]),
    (answer(claims="x"), ["claims is no list"]),
    (answer(refused=None), ["refused and subject_supported must be boolean"]),
])
def test_answer_faults(got, faults):
    assert L.answer_faults(got, None, None, L.Limits()) == faults


def test_checked_rows_and_their_census(spark):
    rows = [(1, json.dumps(label()), None, TEXT), (2, None, None, TEXT), (3, "{", None, TEXT), (4, json.dumps(label(themes=[], abstain=True, label_confidence="low")), None, None), (5, json.dumps(label(overall_sentiment="?")), None, "no pump"), (6, "", None, None)]
    got = L.checked(spark.createDataFrame([(*r, "clash") for r in rows], "id int, response string, title string, text string, faults string"), L.label_faults, ("damage",)).cache()
    assert {r.id: r.label_status for r in got.collect()} == {1: "succeeded", 2: "api_failed", 3: "parse_failed", 4: "model_abstained", 5: "parse_failed", 6: "parse_failed"}
    told = {(r.kind, r.name): r["rows"] for r in L.census(got, {"evidence": "quote", "sentiment": "sentiment"}).collect()}
    assert told == {("cause", "other"): 2, ("cause", "quote"): 1, ("cause", "sentiment"): 1, ("combination", "other"): 2, ("combination", "quote + sentiment"): 1, ("slot", "0"): 1}
    u = L.usage(got).first()
    assert (u["rows"], u.training, u.dropped, u.drop_rate) == (6, 2, 4, 0.6667)
    c = {r.status: r["rows"] for r in L.coverage(spark.createDataFrame([(1,), (3,), (99,)], "id int"), got).collect()}
    assert c == {"succeeded": 1, "parse_failed": 1, "absent": 1}


def test_failed_rows_teach_nothing_but_count_in_evaluation(spark):
    df = spark.createDataFrame([(1, "succeeded", ["a"]), (2, "succeeded", []), (3, "parse_failed", None), (4, "api_failed", None), (5, "model_abstained", [])], "id int, label_status string, themes array<string>")
    assert {r.id: r.themes for r in L.for_training(df).collect()} == {1: ["a"], 2: [], 5: []}
    assert {r.id: r.themes for r in L.for_evaluation(df).collect()} == {1: ["a"], 2: [], 3: [], 4: [], 5: []}
    with pytest.raises(Exception, match="answered row without themes: 7"):
        L.for_training(spark.createDataFrame([(7, "succeeded", None)], df.schema)).collect()


def test_bounded_retries(spark):
    rows = spark.createDataFrame([(1, "good", None, TEXT), (2, "bad", None, TEXT), (3, "down", None, TEXT)], "id int, prompt string, title string, text string")
    good = json.dumps(label())
    call = lambda p: {"good": good, "bad": "{", "down": None}[p]
    got = {r.id: (r.response, r.attempts) for r in L.inferred(rows, call, L.label_faults, ("damage",), attempts=3).collect()}
    assert got == {1: (good, 1), 2: ("{", 3), 3: (None, 3)}


def test_choice_of_a_system(spark):
    cols = "name string, version int, macro_f1 double, failure_rate double"
    assert L.chosen(spark.createDataFrame([("a", 1, 0.50, 0.1), ("b", 2, 0.505, 0.2), ("c", 3, 0.45, 0.0)], cols)).first().name == "a"
    assert L.chosen(spark.createDataFrame([("a", 1, 0.50, 0.1), ("b", 2, 0.52, 0.2)], cols)).first().name == "b"
    with pytest.raises(Exception, match="not scored: a"):
        L.chosen(spark.createDataFrame([("a", 1, None, 0.1)], cols)).collect()


def test_presence_and_intervals_and_keys(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "id int, present boolean")
    p = L.presence(r, spark.createDataFrame([(1, True), (2, True), (9, True)], "id int, present boolean")).first()
    assert (p.tp, p.fp, p.fn, p.tn, p.agreement) == (1, 1, 1, 1, 0.5)
    df = spark.createDataFrame([(0.1, 0.3, 0.3, 0.5, " The  Pump. "), (0.1, 0.2, 0.3, 0.5, None), (None, 0.2, 0.3, 0.5, "-x-")], "a double, b double, c double, d double, s string")
    assert [(x[0], x[1]) for x in df.select(L.overlapping(*(F.col(c) for c in "abcd")), L.aspect_key(F.col("s"))).collect()] == [(True, "the pump"), (False, None), (True, "x")]
    q = spark.createDataFrame([("q", "w", 1, "r1", "R1", "t", None), ("q", "w", 2, "r2", "R2", None, "x")], "question_id string, window string, rank int, review_id string, cite_id string, title string, text string")
    a, b = (L.retrieved_digest(x).first().digest for x in (q, q.orderBy(F.desc("rank"))))
    assert a == b != L.retrieved_digest(q.withColumn("rank", 3 - F.col("rank"))).first().digest
