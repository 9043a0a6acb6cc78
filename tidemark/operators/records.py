"""Loading raw JSON messages, with located reasons for those that fail (problem 5).

The grammar of RFC 8259 is parsed by recursive descent: one rule per value
kind, tokens recognised by anchored patterns, the rule stack kept as a list so
that nesting depth is bounded by memory only.  After a fault the parser
searches the next record-start anchor, an opening brace with a first member,
validates it by parsing a whole record from there, and goes on behind it.  So
a broken quote costs one record, not the rest of the payload.  Each fault tells
what was expected and where.  Text that has parsed isn't parsed again: records
inside a value that isn't one itself are taken from the value, so recovery is
linear in the payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, ship

_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_SCALAR = rf"(?:({_STRING})|({_NUMBER})|(true|false|null))"
blank = re.compile(r"[ \t\n\r]*").match
string = re.compile(_STRING).match
scalar = re.compile(_SCALAR).match
#: ``"key" : scalar`` and the separator behind it, the usual member of a flat record.
member = re.compile(rf"[ \t\n\r]*({_STRING})[ \t\n\r]*:[ \t\n\r]*{_SCALAR}[ \t\n\r]*([,}}])").match
name = re.compile(rf"[ \t\n\r]*({_STRING})[ \t\n\r]*:[ \t\n\r]*").match
anchor = re.compile(r'\{[ \t\n\r]*"[A-Za-z_]\w*"[ \t\n\r]*:').search
_escape = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))')
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": True, "false": False, "null": None}

#: Members of a review message.
FIELDS = ("rating", "title", "text", "images", "asin", "parent_asin", "user_id", "timestamp", "helpful_vote", "verified_purchase")
KEYS = ("user_id", "parent_asin", "timestamp")
#: 1995-01-01 in milliseconds.
EARLIEST_MS = 788918400000
_INT = re.compile(r"-?[0-9]+\Z").match
_LONG = 2**63 - 1


class Number(str):
    """A JSON number as it is written."""

    __slots__ = ()


class Fault(Exception):
    """What was expected, and at which character."""

    def __init__(self, at: int, expected: str):
        super().__init__(f"{expected} expected at {at}")
        self.at, self.expected = at, expected


def _text(quoted: str) -> str:
    body = quoted[1:-1]
    if "\\" not in body:
        return body
    out = _escape.sub(lambda m: chr(int(m[1], 16)) if m[1] else _PLAIN.get(m[2], m[2]), body)
    # surrogate pairs join; a lone surrogate, which the grammar allows, becomes U+FFFD
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _plain(m: re.Match, k: int):
    if (v := m[k]) is not None:
        return _text(v)
    if (v := m[k + 1]) is not None:
        return Number(v)
    return _WORDS[m[k + 2]]


def value(s: str, i: int) -> tuple[object, int]:
    """Rule ``value`` at ``s[i]``: the value and the position behind it, or ``Fault``."""
    stack: list[tuple] = []
    box: dict | list | None = None
    key = ""
    while True:
        if m := scalar(s, i):
            got, i = _plain(m, 1), m.end()
        elif s.startswith("{", i):
            stack.append((box, key))
            box = {}
            i += 1
            closed = False
            while m := member(s, i):  # rule ``object``, flat members
                box[_text(m[1])] = _plain(m, 2)
                i = m.end()
                if m[5] == "}":
                    closed = True
                    break
            if not closed:
                j = blank(s, i).end()
                if not box and s.startswith("}", j):
                    i = j + 1
                else:
                    if not (m := name(s, i)):
                        raise Fault(j, "member")
                    key, i = _text(m[1]), m.end()
                    continue
            got = box
            box, key = stack.pop()
        elif s.startswith("[", i):
            i = blank(s, i + 1).end()
            if not s.startswith("]", i):
                stack.append((box, key))
                box = []
                continue
            got, i = [], i + 1
        else:
            raise Fault(i, "value")
        while True:  # the value is complete: hand it to the enclosing rule
            if box is None:
                return got, i
            i = blank(s, i).end()
            c = s[i : i + 1]
            if type(box) is dict:
                box[key] = got
                if c == ",":
                    if not (m := name(s, i + 1)):
                        raise Fault(blank(s, i + 1).end(), "member")
                    key, i = _text(m[1]), m.end()
                    break
                if c != "}":
                    raise Fault(i, "comma or }")
            else:
                box.append(got)
                if c == ",":
                    i = blank(s, i + 1).end()
                    break
                if c != "]":
                    raise Fault(i, "comma or ]")
            got, i = box, i + 1
            box, key = stack.pop()


def inner(got: object) -> list[dict]:
    """The outermost records inside a parsed value, in the order of the text; a record has a known member."""
    out, todo = [], [got]
    while todo:
        v = todo.pop()
        if type(v) is dict:
            if not v.keys().isdisjoint(FIELDS):
                out.append(v)
            else:
                todo.extend(reversed(v.values()))
        elif type(v) is list:
            todo.extend(reversed(v))
    return out


def records(s: str) -> tuple[list[object], list[Fault]]:
    """All values of a payload and all faults; no fault and one value means well-formed."""
    found: list[object] = []
    faults: list[Fault] = []
    i, n = blank(s, 0).end(), len(s)
    if i == n:
        return [], [Fault(i, "value")]
    while i < n:
        try:
            got, i = value(s, i)
            found.append(got)
            i = blank(s, i).end()
        except Fault as f:
            faults.append(f)
            i = max(i + 1, f.at)
            while True:  # resume at the next anchor from which a whole record parses
                if not (m := anchor(s, i)):
                    return found, faults
                try:
                    got, i = value(s, m.start())
                except Fault as g:
                    faults.append(g)
                    i = max(m.start() + 1, g.at)
                    continue
                if whole := inner(got):
                    found.extend(whole)
                    i = blank(s, i).end()
                    break
    if len(found) > 1 and not faults:
        faults.append(Fault(0, "one value"))
    return found, faults


def _blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def whole_rating(v: object) -> int | None:
    """A whole number from 1 to 5, given as number or string; else null."""
    if not isinstance(v, str):
        return None
    m = re.fullmatch(_NUMBER, v.strip())
    try:
        r = float(m[0]) if m else 0.0
    except OverflowError:
        return None
    return int(r) if 1 <= r <= 5 and r == int(r) else None


def integer(v: object) -> int | None:
    """A number or string written as an integer, held within 64 bits; else null."""
    if not isinstance(v, str) or not _INT(v.strip() if not isinstance(v, Number) else v):
        return None
    t = v.strip()
    return (_LONG if t[0] != "-" else -_LONG) if len(t) > 19 else max(-_LONG, min(_LONG, int(t)))


def _checked(r: dict) -> tuple[str | None, int | None, str | None]:
    """(reason, timestamp, member at fault) of one record by the rules that don't need its arrival."""
    images = r.get("images")
    if images is not None and not (type(images) is list and all(type(x) is dict for x in images)):
        return "unparsable_json", None, "images"
    for k in KEYS:
        if _blank(r.get(k)):
            return "missing_key_field", None, k
    if whole_rating(r.get("rating")) is None:
        return "invalid_rating", None, "rating"
    ts = integer(r["timestamp"])
    if ts is None or ts < EARLIEST_MS:
        return "timestamp_out_of_range", ts, "timestamp"
    return None, ts, None


def located(payload: str | None) -> tuple[list[tuple[int | None, str]], list[dict], dict | None]:
    """(faults as position and what was expected, records recovered beside them, the record of a sound payload)."""
    if payload is None:
        return [(0, "payload")], [], None
    found, faults = records(payload)
    if not faults and type(found[0]) is not dict:
        faults = [Fault(0, "object")]
    if faults:
        return [(f.at, f.expected) for f in faults], [r for r in found if type(r) is dict and not r.keys().isdisjoint(FIELDS)], None
    _, _, member_at_fault = _checked(found[0])
    return [(None, member_at_fault)] if member_at_fault else [], [], found[0]


def judge(payload: str | None) -> tuple[str | None, int | None, dict | None, str | None, int]:
    """(reason, timestamp, record, first fault, records recovered) of one payload.

    The reason is the first that holds of the static ones; whether the
    timestamp is later than the arrival is left to the caller.
    """
    faults, beside, r = located(payload)
    if r is None:
        at, expected = faults[0]
        return "unparsable_json", None, None, f"{expected} expected at {at}", len(beside)
    reason, ts, at_fault = _checked(r)
    return reason, ts, r, at_fault, 0


_VERDICT = pa.schema([("reason", pa.string()), ("fault", pa.string()), ("recovered", pa.int32()), ("ts_ms", pa.int64())])
_TYPED = pa.schema(
    [
        ("user_id", pa.string()),
        ("parent_asin", pa.string()),
        ("asin", pa.string()),
        ("rating", pa.int32()),
        ("title", pa.string()),
        ("text", pa.string()),
        ("helpful_vote", pa.int64()),
        ("verified_purchase", pa.bool_()),
        ("image_count", pa.int32()),
    ]
)


def _as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else None


def _typed(r: dict | None, ok: bool) -> tuple:
    if not ok:
        return (None,) * len(_TYPED)
    v = r.get("verified_purchase")
    votes = integer(r.get("helpful_vote"))
    return (
        (_as_text(r.get("user_id")) or "").strip() or None,
        (_as_text(r.get("parent_asin")) or "").strip() or None,
        (_as_text(r.get("asin")) or "").strip() or None,
        whole_rating(r.get("rating")),
        _as_text(r.get("title")),
        _as_text(r.get("text")),
        votes,
        v if isinstance(v, bool) else None,
        len(images) if type(images := r.get("images")) is list else 0,
    )


def parse(df: DataFrame, typed: bool = False, payload: str = "payload") -> DataFrame:
    """Parse every row of ``df``: its other columns, then the verdict, then (``typed``) the record.

    A valid row has a null ``reason``.  The payload itself isn't passed on.
    Columns of ``df`` named like an output column are dropped in favour of it.
    """
    made = list(_VERDICT) + (list(_TYPED) if typed else [])
    ship(df.sparkSession)
    names = {f.name for f in made}
    keep = [c for c in df.columns if c != payload and c not in names]
    inner = "_payload"
    while inner in keep:
        inner += "_"
    source = df.select(*keep, F.col(payload).alias(inner))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), *(f"`{f.name}` {_DDL[f.type]}" for f in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(p) for p in b.column(len(keep)).to_pylist()]
            cols = [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.string()),
                pa.array([r[4] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
            ]
            if typed:
                t = list(zip(*(_typed(r[2], r[0] is None) for r in rows))) or [()] * len(_TYPED)
                cols += [pa.array(list(c), f.type) for c, f in zip(t, _TYPED)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], [*keep, *(f.name for f in made)])

    return source.mapInArrow(run, schema)


_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}


def _union(sources: tuple[DataFrame, ...]) -> DataFrame:
    """(delivery_id, kafka_partition, kafka_offset, ms, payload) of several tables; a table without delivery_id has a null one."""
    rows = None
    for s in sources:
        own = F.col("delivery_id") if "delivery_id" in s.columns else F.lit(None)
        ms = F.unix_millis(F.col("ingested_at").cast("timestamp"))
        part = s.select(own.cast("bigint").alias("delivery_id"), "kafka_partition", "kafka_offset", ms.alias("ms"), "payload")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _messages(parsed: DataFrame) -> DataFrame:
    """Failing messages of parsed deliveries: (kafka_partition, kafka_offset, reject_reason, fault)."""
    late = F.when(F.col("ts_ms").isNotNull() & (F.col("ts_ms") > F.col("arrived_ms")), "timestamp_out_of_range")
    messages = parsed.groupBy("kafka_partition", "kafka_offset").agg(
        F.min("reason").alias("reason"), F.min("fault").alias("fault"), F.max("ts_ms").alias("ts_ms"), F.min("ms").alias("arrived_ms")
    )
    return messages.select(
        "kafka_partition", "kafka_offset", F.coalesce("reason", late).alias("reject_reason"), F.coalesce("fault", F.lit("timestamp")).alias("fault")
    ).where("reject_reason is not null")


def failing(*sources: DataFrame) -> DataFrame:
    """Failing messages of several tables, once each: partition, offset, reason, first fault.

    Deliveries of one message are judged against its earliest arrival.  Should
    deliveries differ in payload, the first reason in alphabetical order of
    those that fail is given, and a message counts as failing if any does.
    Rows without a position can't be told apart: those of one (partition,
    offset), nulls included, are one message.  A message without any arrival
    isn't judged against it.
    """
    return _messages(parse(_union(sources).drop("delivery_id")))


def load(*sources: DataFrame) -> DataFrame:
    """Rows of several tables whose messages do not fail, as typed records, one per delivery.

    Payloads are parsed once; what ``failing`` says of the messages decides, so
    every delivery is either there or here, those without an arrival too.
    """
    rows = _union(sources)
    shared_dir(rows.sparkSession)
    parsed = parse(rows, typed=True).checkpoint()
    bad = _messages(parsed).select(F.col("kafka_partition").alias("_p"), F.col("kafka_offset").alias("_o"))
    same = F.col("kafka_partition").eqNullSafe(F.col("_p")) & F.col("kafka_offset").eqNullSafe(F.col("_o"))
    return parsed.where("reason is null").join(bad, same, "left_anti").select(
        "delivery_id", "kafka_partition", "kafka_offset", F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("event_ts"), *_TYPED.names
    )


def _each(df: DataFrame, schema: str, rows) -> DataFrame:
    """Map every payload of (kafka_partition, kafka_offset, payload) to any number of rows behind its position."""
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    whole = f"kafka_partition {kinds['kafka_partition']}, kafka_offset {kinds['kafka_offset']}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [rows(p) for p in b.column(2).to_pylist()]
            src = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            cols = list(zip(*(r for m in made for r in m))) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([b.column(0).take(src), b.column(1).take(src), *(pa.array(list(c), t) for c, (_, t) in zip(cols, out))], ["kafka_partition", "kafka_offset", *(n for n, _ in out)])

    by_name = {v: k for k, v in _DDL.items()}
    out = [(n, by_name[t]) for n, t in (x.split() for x in schema.split(", "))]
    return df.select("kafka_partition", "kafka_offset", "payload").mapInArrow(run, whole)


def faults(*sources: DataFrame) -> DataFrame:
    """Every located fault of every message: (kafka_partition, kafka_offset, fault_no, at, expected).

    ``at`` counts characters from 0 and is null where the text is sound JSON and
    a member breaks a rule, which ``expected`` then names.  Deliveries of one
    message with equal faults count once.  The timestamp isn't compared with
    the arrival here.
    """
    told = lambda p: [(k, at, what) for k, (at, what) in enumerate(located(p)[0], 1)]
    return _each(_union(sources), "fault_no int, at int, expected string", told).distinct()


def recovered(*sources: DataFrame) -> DataFrame:
    """Typed records found beside the faults of broken payloads: (kafka_partition, kafka_offset, record_no, reason, ts_ms, fields).

    ``reason`` judges the record by itself.  Records of equal deliveries count once.
    """

    def told(p: str | None) -> list[tuple]:
        return [(k, *_checked(r)[:2], *_typed(r, True)) for k, r in enumerate(located(p)[1], 1)]

    fields = ", ".join(f"{f.name} {_DDL[f.type]}" for f in _TYPED)
    return _each(_union(sources), f"record_no int, reason string, ts_ms bigint, {fields}", told).distinct()
