"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

Every k-word shingle of a text is hashed to 64 bits and every hash below a fixed fraction of the
range is kept. report() keeps the whole range, so |A∩B|/|A| is the share of A's shingles that B has,
however short or unequal the two are. With a smaller fraction (bits > 0) sketches are samples and the
share is an estimate; a text that leaves no hash below the threshold keeps its least hash, which a
longer text's sketch doesn't hold, so such short texts must not be compared with others.

next_document() finds each row's successor in descending doc_id without a global sort in one task:
ids are dealt to ranges by approximate quantiles and equal parts of them, the window runs within a range, and only the
first row of each range (a bounded number) is looked up across ranges.

Defined cases: null text is empty; word-free texts have the empty fingerprint, alike (1.0) among
themselves and unlike (0.0) every other; fewer words than a shingle are one shingle; a null doc_id
comes after all others; equal ids follow each other by the text's hash; a single row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import plain

SHINGLE = 5
#: Of 2**BITS hashes one is kept: all of them.
BITS = 0
#: Rows that a range of doc_ids should hold, and the most ranges.
RANGE_ROWS = 1_000
QUANTILES = 128
MAX_RANGES = 65_536


def with_sketch(df: DataFrame, text: str, out: str, k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """df with the sketch of a text column: sorted distinct hashes below 2**(63 - bits).

    A word is hashed once, in a column of its own; a shingle hashes its words' hashes. The sign bit is dropped.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n, w = F.size("_w"), F.col("_w")
    at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    shingle = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]), 1))
    df = df.withColumn("_h", F.when(n > 0, shingle).otherwise(F.array().cast("array<bigint>")))
    below = F.filter("_h", lambda h: h <= (1 << (63 - bits)) - 1)
    kept = F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).when(n > 0, F.array(F.array_min("_h"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, kept).drop("_w", "_h")


def containment(a: str, b: str) -> Column:
    """Share of a's shingles that b has, estimated where the sketches are samples; 1.0 if both are empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).when(F.size(b) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def merged(a: str, b: str) -> Column:
    """Sketch of the shingles that either of two texts has."""
    return F.array_sort(F.array_union(a, b))


def encoded(sketch: str) -> Column:
    """16 hexadecimal digits for each hash, ascending."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _quantile(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are ≤ value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _range_of(cuts: list[int], least: int, most: int, parts: int) -> Column:
    """Range number, ascending in doc_id: a quantile's number, and one of so many equal parts within it."""
    edges = [least, *cuts, most + 1]
    at = _quantile(cuts, F.col("doc_id"))
    if parts == 1:
        return at
    pick = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), at)
    part = F.floor((F.col("doc_id") - pick(edges[:-1])) * parts / pick([max(1, b - a) for a, b in zip(edges, edges[1:])]))
    return at * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))


def next_document(docs: DataFrame, carry: list[str], range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """docs (doc_id, text, *carry) with next_<name> of text and every carried column."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_th"))
    quantiles = [i / QUANTILES for i in range(1, QUANTILES)]
    known = ids.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.percentile_approx("doc_id", quantiles, 10_000).alias("q")).first()
    cuts = sorted(set(known["q"] or []))
    if known["n"] <= range_rows:
        cuts = []
    parts = max(1, min(max_ranges, known["n"] // range_rows) // (len(cuts) + 1))
    placed = F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(cuts, known["a"] or 0, known["b"] or 0, parts)).cast("int")
    # the first row of each range, at most one more than max_ranges of them
    heads = sorted(ids.groupBy(placed.alias("_r")).agg(F.max(F.struct("doc_id", F.bitwise_not("_th").alias("_nth"))).alias("h")).collect(), key=lambda r: -r["_r"])
    after = [(heads[i]["_r"], heads[(i + 1) % len(heads)]["h"]) for i in range(len(heads))]
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "_th": F.xxhash64("text"), "_r": placed, "_ghost": F.lit(0)})
    if after:
        # every range ends with a ghost of the row that follows its last one
        targets = docs.sparkSession.createDataFrame([(r, h["doc_id"], ~h["_nth"]) for r, h in after], "_t int, _d long, _h long")
        ghosts = rows.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h"))).dropDuplicates(["_t"]).withColumns({"_r": F.col("_t"), "_ghost": F.lit(1)}).select(*rows.columns)
        rows = rows.unionByName(ghosts)
    w = Window.partitionBy("_r").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_th")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ["text", *carry]}).where("_ghost = 0").drop("_ghost", "_th", "_r")


def report(docs: DataFrame) -> DataFrame:
    """Only texts are shuffled: sketches, larger than their texts, are made after the rows have met."""
    own = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = next_document(own, []).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    for text, out in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):
        both = with_sketch(both, text, out)
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), encoded("sketch").alias("fingerprint"), encoded("edited_sketch").alias("edited_fingerprint"),
        containment("sketch", "edited_sketch").alias("near_edited"), containment("sketch", "next_sketch").alias("near_next"),
    )
