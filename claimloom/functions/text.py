"""Text keys, claim keys and page signals as Column expressions (TXT-7..13, NRM-17, CLS-1..3, SRC-8, SRC-9, GRD-5, GRD-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUFFIX = r"\b(limited|ltd|private|pvt|incorporated|inc|corporation|corp|plc|llp|company|co)\b"


def collapse(text: Column) -> Column:
    """TXT-8."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Latin letters that are a plain letter with a mark.
_MARKED = {
    "a": "àáâãäåāăąǎ", "c": "çćĉċč", "d": "ďḍ", "e": "èéêëēĕėęě", "g": "ĝğġģǧ", "h": "ĥḥ", "i": "ìíîïĩīĭįǐ", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņňṅ", "o": "òóôõöōŏőǒ",
    "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüũūŭůűųǔ", "w": "ŵẁẃẅ", "y": "ýÿŷ", "z": "źżž",
}


def plain_letters(text: Column) -> Column:
    """Lower case, letters with marks as plain ones; combining marks dropped."""
    marked, plain = "".join(_MARKED.values()), "".join(k * len(v) for k, v in _MARKED.items())
    return F.regexp_replace(F.translate(F.lower(text), marked, plain), r"\p{M}+", "")


def slugify(text: Column) -> Column:
    """TXT-9."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(plain_letters(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit("unnamed"))


def alias_key(text: Column) -> Column:
    """TXT-10: no leading article, lower case, plain letters and digits only."""
    return F.trim(F.regexp_replace(plain_letters(F.regexp_replace(F.trim(text), r"(?i)^(the|a|an)\s+", "")), "[^a-z0-9]+", " "))


def entity_alias_key(text: Column) -> Column:
    """TXT-11: alias_key without corporate suffixes, unless nothing were left."""
    return F.coalesce(F.nullif(collapse(F.regexp_replace(alias_key(text), _SUFFIX, " ")), F.lit("")), alias_key(text))


def same_organisation(a: Column, b: Column) -> Column:
    """TXT-12: the same set of tokens."""
    tokens = lambda x: F.array_sort(F.array_distinct(F.split(entity_alias_key(x), " ")))
    return tokens(a) == tokens(b)


def claim_key(subject: Column, predicate: Column, qualifiers: Column, period: Column, basis: Column) -> Column:
    """NRM-17: what is claimed, without its value; qualifiers: map."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(qualifiers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.lower(F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (subject, predicate, pairs, period, basis)]))


def occurrences(text: Column, quote: Column) -> Column:
    """GRD-5: how often a quote occurs, overlaps not counted."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(0)


def truncated(text: Column, most: int) -> Column:
    """TXT-8: at most so many characters, an ellipsis last if some are cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def context(text: Column, start: Column, end: Column, radius: int = 400) -> Column:
    """TXT-7: the text around a span, from the first sentence that begins within it, unless that leaves less than the span."""
    left = F.greatest(start - radius, F.lit(0))
    snippet = F.substring(text, left + 1, end + radius - left)
    later = F.regexp_replace(snippet, r"^(?s).*?[.!?]\s+", "")
    cut = (left > 0) & snippet.rlike(r"[.!?]\s+") & (F.length(later) > end - start)
    return F.trim(F.regexp_replace(F.when(cut, later).otherwise(snippet), r"^\s+|\s+$", ""))


def content_hash(data: Column) -> Column:
    """TXT-13: SHA-256 of a text or of bytes."""
    return F.sha2(data, 256)


def stable_key(fields: dict[str, Column]) -> Column:
    """TXT-13: SHA-256 of a JSON object with its names in order, so that the order of the fields doesn't matter."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def page_signals(text: Column) -> dict[str, Column]:
    """CLS-2 for pages that are text alone: shares are rounded before anything is decided on them."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    numeric = F.size(F.filter(words, lambda w: w.rlike(r"^[(+-]?[$€£₹]?[0-9][0-9,.]*[%)]?$")))
    ratio = lambda a: F.when(n > 0, F.round(a / n, 3)).otherwise(0.0)
    rows = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    listed = F.regexp_count(text, F.lit(r"(?m)(?:\.{3,}|[ \t]{3,})[ \t]*[0-9]{1,4}[ \t]*$"))
    return {
        "words": n, "chars": F.length(text), "numeric_share": ratio(numeric), "sentence_density": F.when(n > 0, F.round(F.regexp_count(text, F.lit("[.!?](\\s|$)")) / n * 100, 3)).otherwise(0.0),
        "toc_score": F.when(rows >= 6, F.round(listed / rows, 3)).otherwise(0.0),
    }


def ruling_lines(drawings: Column, page_width: Column) -> Column:
    """SRC-8: drawings (x0, y0, x1, y1) that are flat and at least a quarter of the page wide."""
    return F.size(F.filter(drawings, lambda d: (d["x1"] - d["x0"] >= 0.25 * page_width) & (F.abs(d["y1"] - d["y0"]) <= 2.0)))


def area_ratio(boxes: Column, page_width: Column, page_height: Column) -> Column:
    """SRC-9, CLS-2: share of the page that boxes (x0, y0, x1, y1) cover by their areas' sum, 1 at most."""
    area = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0)))
    return F.when(page_width * page_height > 0, F.least(F.lit(1.0), area / (page_width * page_height))).otherwise(0.0)


def page_type(signals: dict[str, Column]) -> Column:
    """CLS-1: scanned, empty, toc, boilerplate, chart, table, mixed or prose. Signals that a page lacks count as 0."""
    s = {k: signals.get(k, F.lit(0.0)) for k in ("words", "chars", "numeric_share", "sentence_density", "toc_score", "table_coverage", "image_ratio", "vector_density", "ruling_lines", "tables")}
    tabular = (s["table_coverage"] >= 0.28) | ((s["tables"] >= 1) & (s["numeric_share"] >= 0.30)) | ((s["ruling_lines"] >= 4) & (s["numeric_share"] >= 0.25))
    drawn = (s["image_ratio"] >= 0.10) | (s["vector_density"] >= 0.35)
    return (
        F.when((s["words"] < 6) & (s["chars"] < 24) & (s["image_ratio"] >= 0.5), "scanned")
        .when(s["words"] < 6, "empty")
        .when(s["toc_score"] >= 0.3, "toc")
        .when((s["words"] < 25) & (s["sentence_density"] < 1.0) & (s["numeric_share"] < 0.25), "boilerplate")
        .when((s["sentence_density"] < 1.2) & (s["numeric_share"] >= 0.18) & (s["words"] < 400) & drawn, "chart")
        .when(tabular, F.when(s["sentence_density"] < 2.0, "table").otherwise("mixed"))
        .when((s["numeric_share"] >= 0.15) & (s["sentence_density"] >= 1.2), "mixed")
        .otherwise("prose")
    )


def extractable(kind: Column) -> Column:
    """CLS-1: whether facts are looked for on a page of this type."""
    return kind.isin("chart", "table", "mixed", "prose")


def vision_candidate(kind: Column, image_ratio: Column, drawings: Column) -> Column:
    """CLS-3: a chart page with graphics that its text doesn't show."""
    return (kind == "chart") & ((image_ratio >= 0.08) | (drawings >= 40))


def quote_boxes(words: Column, quote: Column) -> Column:
    """GRD-10: boxes (x0, y0, x1, y1) of the first place where a page's words (text, x0, y0, x1, y1) are those of the quote.

    Neighbours of one line (tops within 3, a gap below 12) become one box; no place gives no box.
    """
    tidy = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}%]+", "")
    wanted = F.filter(F.transform(F.split(quote, r"\s+"), tidy), lambda w: w != "")
    own = F.filter(words, lambda w: tidy(w["text"]) != "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own) - F.size(wanted) + 1, F.lit(1))), lambda i: F.transform(F.slice(own, i, F.size(wanted)), lambda w: tidy(w["text"])) == wanted)
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    def add(boxes: Column, w: Column) -> Column:
        last = F.try_element_at(boxes, F.lit(-1))
        near = (F.abs(last["y0"] - w["y0"]) < 3) & (w["x0"] - last["x1"] < 12)
        wider = box(F.least(last["x0"], w["x0"]), F.least(last["y0"], w["y0"]), F.greatest(last["x1"], w["x1"]), F.greatest(last["y1"], w["y1"]))
        joined = F.concat(F.slice(boxes, 1, F.greatest(F.size(boxes) - 1, F.lit(0))), F.array(wider))
        return F.when(F.coalesce(near, F.lit(False)), joined).otherwise(F.concat(boxes, F.array(box(w["x0"], w["y0"], w["x1"], w["y1"]))))

    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    found = F.slice(own, F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(1)), F.size(wanted))
    return F.when((F.size(starts) > 0) & (F.size(wanted) > 0), F.aggregate(found, none, add)).otherwise(none)
