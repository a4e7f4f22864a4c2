"""JSON inside model answers: fenced, embedded or cut off (JSN-1, JSN-2, JSN-4). Arrow-batched functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_PAIRS = {"{": "}", "[": "]"}


def _scan(text: str, start: int):
    """Walks JSON from an opening bracket; yields (place, open brackets) after each complete item or bracket."""
    held, quoted, skip = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, skip = (skip or c != '"'), (c == "\\" and not skip)
            continue
        if c == '"':
            quoted = True
        elif c in _PAIRS:
            held.append(_PAIRS[c])
        elif held and c == held[-1]:
            held.pop()
            yield i + 1, list(held)
            if not held:
                return
        elif c == "," and held:
            yield i, list(held)


def _first(text: str) -> int:
    return min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)


def extract(text: str | None) -> str | None:
    """The JSON value of an answer: in a fence, as a whole, or the first balanced object or list; null if none parses."""
    for part in [*(_FENCE.findall(text or "")), text or ""]:
        part = part.strip()
        at = _first(part)
        ends = [e for e, held in _scan(part, at) if not held] if at >= 0 else []
        for candidate in [part, *(part[at:e] for e in ends)]:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False)
            except ValueError:
                continue
    return None


def salvage(text: str | None) -> str | None:
    """A cut-off JSON value, closed after its last complete item; null if nothing is complete."""
    whole = extract(text)
    at = _first(text or "")
    if whole is not None or at < 0:
        return whole
    for end, held in reversed(list(_scan(text, at))):
        try:
            return json.dumps(json.loads(text[at:end] + "".join(reversed(held))), ensure_ascii=False)
        except ValueError:
            continue
    return None


def extract_json(text: Column) -> Column:
    return F.pandas_udf(lambda xs: xs.map(extract), T.StringType())(text)


def salvage_json(text: Column) -> Column:
    return F.pandas_udf(lambda xs: xs.map(salvage), T.StringType())(text)


def by_page(answers, first_page: str = "first_page", pages: str = "pages", text: str = "text"):
    """JSN-4: answers to several pages at once (pages: their numbers) as rows page_number, fact.

    text is JSON {"facts": [{"page_number": …, …}]}; a fact of no page, or of one that wasn't asked for, is the first page's.
    """
    facts = F.from_json(F.get_json_object(text, "$.facts"), "array<string>")
    rows = answers.withColumn("_fact", F.explode(facts))
    number = F.get_json_object("_fact", "$.page_number").try_cast("int")
    return rows.select(F.when(F.array_contains(pages, number), number).otherwise(F.col(first_page)).alias("page_number"), F.col("_fact").alias("fact"))
