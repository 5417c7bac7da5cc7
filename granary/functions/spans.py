"""Spans: offsets of matches and markers, merged spans, normal forms."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def match_spans(c: Column, pattern: str, group: int = 0) -> Column:
    """Spans of all matches; Spark's own functions give texts but no offsets."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = re.compile(pattern).finditer
        for b in batches:
            yield pa.array([[{"start": m.start(group), "end": m.end(group)} for m in find(x.as_py() or "")] for x in b], _ARROW)

    return F.arrow_udf(run, _SPANS)(c)


def json_spans(c: Column) -> Column:
    """Spans of the outermost objects that parse, by balanced braces outside of strings."""

    def one(text: str) -> list[dict]:
        out, depth, start, quoted, skip = [], 0, 0, False, False
        for i, ch in enumerate(text):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"' and depth:
                quoted = True
            elif ch == "{":
                start = i if depth == 0 else start
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(text[start : i + 1])
                        out.append({"start": start, "end": i + 1})
                    except ValueError:
                        pass
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([one(x.as_py() or "") for x in b], _ARROW)

    return F.arrow_udf(run, _SPANS)(c)


def normal_form(c: Column) -> Column:
    """Unicode NFC with line feeds only; nulls stay."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if (t := x.as_py()) is None else unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n") for x in b], pa.string())

    return F.arrow_udf(run, "string")(c)


def marked_spans(tokens: Column, opens: str, closes: str) -> Column:
    """Spans from an open mark to its close, both included; a new open starts anew, one left open counts in `unclosed`."""
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        span = F.struct(a["at"].alias("start"), (x["i"] + 1).alias("end"))
        return F.when(x["t"] == opens, F.struct(x["i"].alias("at"), a["spans"].alias("spans"))).when(
            (x["t"] == closes) & (a["at"] >= 0), F.struct(F.lit(-1).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))
        ).otherwise(a)

    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    done = F.aggregate(numbered, start, step)
    return F.struct(done["spans"].alias("spans"), (done["at"] >= 0).alias("unclosed"))


def merge(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    start = F.array().cast(_SPANS)

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(a) == 0, F.array(s)).when(s["start"] <= last["end"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, step)
