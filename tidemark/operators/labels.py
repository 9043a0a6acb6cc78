"""Answers of a labelling model: shape and evidence checks, use of failed rows, and the census of failures.

The model is outside; what it returned is a JSON text.  Checks name every
fault, they repair nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Terminal states of a row, those without an answer, and what a label may say.
ANSWERED, UNANSWERED = ("succeeded", "model_abstained"), ("parse_failed", "api_failed")
SENTIMENTS, CONFIDENCES = ("positive", "negative", "mixed", "neutral"), ("high", "medium", "low")


@dataclass(frozen=True)
class Limits:
    items: int = 5
    quote_words: int = 15
    aspect_words: int = 6
    phrase_words: int = 8
    claims: int = 6
    citations: int = 6
    claim_words: int = 45
    reason_words: int = 60


def _plain(text: str | None) -> str:
    return " ".join((text or "").casefold().split())


def is_evidence(quote: str, title: str | None, text: str | None) -> bool:
    """Whether a quote stands in title or text, whatever its case and white space; a blank one doesn't."""
    q = _plain(quote)
    return bool(q) and (q in _plain(title) or q in _plain(text))


def _words(v: object, most: int, what: str) -> list[str]:
    if not isinstance(v, str) or not v.strip():
        return [f"{what} is blank"]
    return [f"{what} is too long"] if len(v.split()) > most else []


def _fields(v: object, names: set[str]) -> bool:
    return isinstance(v, dict) and set(v) == names


def phrase_faults(got: object, title: str | None, text: str | None, limits: Limits) -> list[str]:
    """Faults of ``{"complaints": [{"quote", "aspect"}]}``: size, words, evidence, repeated quotes."""
    if not _fields(got, {"complaints"}) or not isinstance(got["complaints"], list):
        return ["not an object with a list of complaints"]
    faults, seen = [], set()
    if len(got["complaints"]) > limits.items:
        faults.append("too many complaints")
    for k, x in enumerate(got["complaints"]):
        if not _fields(x, {"quote", "aspect"}) or not all(isinstance(v, str) for v in x.values()):
            faults.append(f"complaints[{k}] lacks quote or aspect")
            continue
        faults += _words(x["quote"], limits.quote_words, f"complaints[{k}] quote") + _words(x["aspect"], limits.aspect_words, f"complaints[{k}] aspect")
        if not is_evidence(x["quote"], title, text):
            faults.append(f"complaints[{k}] quote is no evidence")
        if _plain(x["quote"]) in seen:
            faults.append(f"complaints[{k}] repeats a quote")
        seen.add(_plain(x["quote"]))
    return faults


def label_faults(got: object, title: str | None, text: str | None, limits: Limits, taxonomy: tuple[str, ...]) -> list[str]:
    """Faults of a label: themes of the taxonomy, once each, with short verbatim quotes; ``other`` with a phrase; empty abstentions."""
    if not _fields(got, {"themes", "other", "abstain", "overall_sentiment", "label_confidence"}):
        return ["not an object with the five members of a label"]
    faults = [] if isinstance(got["abstain"], bool) else ["abstain is not boolean"]
    faults += [] if got["overall_sentiment"] in SENTIMENTS else ["unknown sentiment"]
    faults += [] if got["label_confidence"] in CONFIDENCES else ["unknown confidence"]
    themes, other = got["themes"], got["other"]
    if not isinstance(themes, list):
        faults.append("themes is no list")
        themes = []
    seen: list = []
    for k, x in enumerate(themes):
        if not _fields(x, {"theme_id", "evidence_quote"}):
            faults.append(f"themes[{k}] lacks theme or quote")
            continue
        faults += [] if x["theme_id"] in taxonomy else [f"themes[{k}] is outside the taxonomy"]
        faults += [f"themes[{k}] repeats a theme"] if x["theme_id"] in seen else []
        seen.append(x["theme_id"])
        blank_or_long = _words(x["evidence_quote"], limits.quote_words, f"themes[{k}] quote")
        faults += blank_or_long
        if isinstance(x["evidence_quote"], str) and x["evidence_quote"].strip() and not is_evidence(x["evidence_quote"], title, text):
            faults.append(f"themes[{k}] quote is no evidence")
    if not _fields(other, {"present", "phrase"}) or not isinstance(other["present"], bool):
        faults.append("other lacks present or phrase")
        other = {}
    elif other["present"]:
        faults += _words(other["phrase"], limits.phrase_words, "other phrase")
    elif other["phrase"] is not None:
        faults.append("other phrase without other")
    if got["abstain"] is True:
        faults += (["abstention with themes"] if themes else []) + (["abstention with other"] if other.get("present") or other.get("phrase") is not None else [])
        faults += ["abstention with confidence"] if got["label_confidence"] != "low" else []
    return faults


def answer_faults(got: object, title: str | None, text: str | None, limits: Limits) -> list[str]:
    """Faults in the shape of a cited answer; whether its citations hold is left to the contract."""
    if not _fields(got, {"subject", "subject_supported", "refused", "refusal_reason", "claims"}):
        return ["not an object with the five members of an answer"]
    if not isinstance(got["refused"], bool) or not isinstance(got["subject_supported"], bool):
        return ["refused and subject_supported must be boolean"]
    faults = [] if isinstance(got["subject"], str) and got["subject"].strip() else ["subject is blank"]
    faults += ["refused contradicts subject_supported"] if got["refused"] == got["subject_supported"] else []
    claims = got["claims"]
    if not isinstance(claims, list):
        return ["claims is no list"]
    faults += ["too many claims"] if len(claims) > limits.claims else []
    for k, c in enumerate(claims):
        if not _fields(c, {"claim", "citations"}):
            faults.append(f"claims[{k}] lacks claim or citations")
            continue
        faults += _words(c["claim"], limits.claim_words, f"claims[{k}]")
        if not isinstance(c["citations"], list):
            faults.append(f"claims[{k}] citations is no list")
            continue
        faults += [f"claims[{k}] has too many citations"] if len(c["citations"]) > limits.citations else []
        for j, x in enumerate(c["citations"]):
            good = _fields(x, {"cite_id", "window"}) and all(isinstance(v, str) and v.strip() for v in x.values())
            faults += [] if good else [f"claims[{k}] citation {j} lacks handle or window"]
    if got["refused"]:
        return faults + (["refusal with claims"] if claims else []) + _words(got["refusal_reason"], limits.reason_words, "refusal reason")
    return faults + (["reason without refusal"] if got["refusal_reason"] is not None else [])


def checked(rows: DataFrame, check: Callable, *more: object, limits: Limits = Limits()) -> DataFrame:
    """``rows`` (id, response, title, text) with ``label_status`` and ``faults`` (a list, empty where sound).

    A null response is a failed call, one that is no JSON or has faults a
    failed parse; a sound one that abstains is no failure.
    """
    ship(rows.sparkSession)

    def judge(response: str | None, title: str | None, text: str | None) -> tuple[str, list[str]]:
        if response is None:
            return "api_failed", []
        try:
            got = json.loads(response)
        except (ValueError, RecursionError):
            return "parse_failed", ["not JSON"]
        faults = check(got, title, text, limits, *more)
        if faults:
            return "parse_failed", faults
        return "model_abstained" if isinstance(got, dict) and got.get("abstain") is True else "succeeded", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.string()), pa.array([f for _, f in got], pa.list_(pa.string()))], ["id", "label_status", "faults"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "response", "title", "text").mapInArrow(run, f"id {kind}, label_status string, faults array<string>")


def inferred(rows: DataFrame, call: Callable[[str], str | None], check: Callable, *more: object, attempts: int = 2, limits: Limits = Limits()) -> DataFrame:
    """(id, response, attempts) of a pluggable model: the same prompt again while the response is null or faulty, ``attempts`` times at most.

    ``rows`` is (id, prompt, title, text).
    """
    ship(rows.sparkSession)

    def one(prompt: str, title: str | None, text: str | None) -> tuple[str | None, int]:
        got = None
        for k in range(1, attempts + 1):
            got = call(prompt)
            try:
                if got is not None and not check(json.loads(got), title, text, limits, *more):
                    break
            except ValueError:
                pass
        return got, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([n for _, n in got], pa.int32())], ["id", "response", "attempts"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "prompt", "title", "text").mapInArrow(run, f"id {kind}, response string, attempts int")


def for_training(labels: DataFrame) -> DataFrame:
    """(id, themes) that teach: rows without an answer are left out, an answer without themes teaches none.

    An answered row whose themes are null contradicts itself and is an error.
    """
    lost = F.raise_error(F.concat(F.lit("answered row without themes: "), F.col("id").cast("string")))
    kept = labels.where(F.col("label_status").isin(*ANSWERED))
    return kept.select("id", F.when(F.col("themes").isNull(), lost.cast("array<string>")).otherwise(F.col("themes")).alias("themes"))


def for_evaluation(labels: DataFrame) -> DataFrame:
    """(id, themes) that were predicted: a row without an answer predicted nothing."""
    none = F.array().cast("array<string>")
    return labels.select("id", F.when(F.col("label_status").isin(*ANSWERED), F.coalesce("themes", none)).otherwise(none).alias("themes"))


def usage(labels: DataFrame) -> DataFrame:
    """One row: rows, those that train, those dropped, and the rate of the latter."""
    a = labels.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("label_status").isin(*ANSWERED), 1)).alias("training"))
    return a.select("*", (F.col("rows") - F.col("training")).alias("dropped"), F.round(F.coalesce(F.try_divide(F.col("rows") - F.col("training"), "rows"), F.lit(0.0)), 4).alias("drop_rate"))


def coverage(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """(status, rows, share) of the selected ids; ids without a row are ``absent``."""
    total = selected.agg(F.count(F.lit(1))).scalar()
    j = selected.select("id").join(labels.select("id", "label_status"), "id", "left")
    return j.groupBy(F.coalesce("label_status", F.lit("absent")).alias("status")).agg(F.count(F.lit(1)).alias("rows")).select("status", "rows", F.round(F.col("rows") / total, 4).alias("share"))


def causes(faults: Column, named: dict[str, str]) -> Column:
    """The distinct causes of a list of faults, sorted: the first pattern that matches names each, else ``other``."""
    of = lambda f: F.coalesce(*(F.when(f.rlike(p), F.lit(n)) for p, n in named.items()), F.lit("other"))
    return F.array_sort(F.array_distinct(F.transform(faults, of)))


def census(checked_rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """(kind, name, rows) of failed rows: by cause, by combination of causes, and by place in the list that was hit."""
    x = checked_rows.where(F.size("faults") > 0).select("id", "faults", causes(F.col("faults"), named).alias("causes"))
    parts = [
        x.select(F.lit("cause").alias("kind"), F.explode("causes").alias("name")),
        x.select(F.lit("combination").alias("kind"), F.array_join("causes", " + ").alias("name")),
        x.select(F.lit("slot").alias("kind"), F.explode(F.transform("faults", lambda f: F.regexp_extract(f, r"\[(\d+)\]", 1))).alias("name")).where("name <> ''"),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("rows"))


def presence(reference: DataFrame, system: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, tn, agreement) over the ids of ``reference`` (id, present); a row the system lacks or failed counts as absent."""
    j = reference.select("id", F.coalesce("present", F.lit(False)).alias("r")).join(system.select("id", F.coalesce("present", F.lit(False)).alias("s")), "id", "left").na.fill(False, ["s"])
    n = lambda r, s: F.count(F.when((F.col("r") == r) & (F.col("s") == s), 1))
    a = j.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    return a.withColumn("agreement", F.round(F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), F.lit(0.0)), 4))


def chosen(systems: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """One row: the system with the best macro F1; within ``epsilon`` of it the one that failed least, then the earliest version.

    ``systems`` is (name, version, macro_f1, failure_rate); one without a score is an error, never ranked last.
    """
    bad = F.raise_error(F.concat(F.lit("not scored: "), F.col("name"))).cast("double")
    s = systems.withColumn("macro_f1", F.when(F.col("macro_f1").isNull(), bad).otherwise(F.col("macro_f1")))
    top = s.agg(F.max("macro_f1")).scalar()
    return s.where(top - F.col("macro_f1") < epsilon).orderBy("failure_rate", "version").limit(1)


def overlapping(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals meet; an open one is never called apart."""
    open_ = low_a.isNull() | high_a.isNull() | low_b.isNull() | high_b.isNull()
    return F.when(open_, True).otherwise((low_a <= high_b) & (low_b <= high_a))


def aspect_key(aspect: Column) -> Column:
    """An aspect in lower case, with single spaces and without outer punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(aspect), r"\s+", " ")), r"^[\s.,;:!?'\"-]+|[\s.,;:!?'\"-]+$", "")


def retrieved_digest(retrieved: DataFrame) -> DataFrame:
    """(question_id, digest): one hash of the ordered retrieved set, each row with a hash of its content."""
    content = F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    row = F.struct("window", "rank", "review_id", "cite_id", content.alias("content"))
    return retrieved.groupBy("question_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256).alias("digest"))
