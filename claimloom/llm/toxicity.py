"""Toxicity by multiple-instance learning: sentences are scored, only documents are labelled.

A document is a bag of its distinct sentences. A sentence's probability is logistic in its words and word
beginnings; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Weights are learned by
maximising the likelihood of the document labels, so the gradient itself decides which sentences of
a toxic document carry the blame; the same sentence scores then locate offending sentences.

Fitting uses at most TRAIN_POSITIVE and TRAIN_NEGATIVE labelled documents of TRAIN_BYTES in all (whole
texts, the least by a hash of the id), weighted back to the labels' true ratio; rows of the held-out fold never enter.
Scoring is one narrow pass over all documents with the model, whose size is bounded by the sample,
sent to the tasks. Labels, language, source and id are never inputs of a score.

Defined cases: null, empty and word-free text has no sentence and scores 0; a null label or id, or
a label without document, isn't learned from; repeated labels of an id count once, toxic if any
is; without labels of both classes every score is 0; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import extended, map_arrow, plain, shielded

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
TRAIN_POSITIVE, TRAIN_NEGATIVE = 2_000, 3_000
#: Most text of them in bytes; beyond it, the documents of largest hash don't train.
TRAIN_BYTES = 64 << 20
#: A feature must occur in so many training documents; and the most features kept (by count in toxic documents).
LEAST_DOCUMENTS, MOST_FEATURES = 3, 200_000
#: Words whose weight a task remembers.
MEMO_WORDS = 300_000
EPOCHS, RATE, L1 = 100, 0.25, 2e-5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_START = -6.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(word: str) -> list[str]:
    """A word and its beginnings (marked, so that they differ from words)."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def sentences(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """(start, end, distinct words) of each sentence that has a word; sentences of the same words share one set."""
    out, seen, same = [], {}, {}
    for m in _SENTENCE.finditer(text):
        s = m[0].lower()
        words = seen.get(s)
        if words is None:
            words = frozenset(_WORD.findall(s))
            words = seen[s] = same.setdefault(words, words)
        if words:
            out.append((m.start(), m.end(), words))
    return out


def distinct(found: list[tuple[int, int, frozenset[str]]]) -> list[frozenset[str]]:
    """The bag: every distinct sentence once, so that repeating a line adds no evidence."""
    return list({id(ws): ws for _, _, ws in found}.values())


@dataclass
class Model:
    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)

    def sentence_scores(self, bag: list[frozenset[str]], memo: dict[str, float]) -> list[float]:
        out = []
        for words in bag:
            z = self.bias
            for w in words:
                v = memo.get(w)
                if v is None:
                    v = sum(self.weights.get(f, 0.0) for f in features(w))
                    if len(memo) < MEMO_WORDS:
                        memo[w] = v
                z += v
            out.append(1 / (1 + math.exp(-z)) if z > -500 else 0.0)
        return out


def noisy_or(scores: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(np.array(scores), 1 - 1e-12)).sum())) if scores else 0.0


def train(rows: list[tuple[str, int, float]]) -> Model:
    """rows: text, label, weight."""
    if len({y for _, y, _ in rows}) < 2:
        return Model()
    in_toxic, in_all = Counter(), Counter()
    for text, y, _ in rows:  # texts are parsed twice, so that no more than one is held parsed
        own = {f for w in {w for ws in distinct(sentences(text)) for w in ws} for f in features(w)}
        in_all.update(own)
        if y:
            in_toxic.update(own)
    kept = sorted((f for f in in_toxic if in_all[f] >= LEAST_DOCUMENTS), key=lambda f: (-in_toxic[f], f))[:MOST_FEATURES]
    number = {f: i for i, f in enumerate(kept)}
    del in_all, in_toxic
    sent, feat, doc, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], 0
    for d, (text, _, _) in enumerate(rows):
        for ws in distinct(sentences(text)):
            own = np.array(sorted({number[f] for w in ws for f in features(w) if f in number}), np.int32)
            feat.append(own)
            sent.append(np.full(len(own), n, np.int32))
            doc.append(d)
            n += 1
    sent, feat, doc = np.concatenate(sent), np.concatenate(feat), np.array(doc, np.int64)
    y, weight = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    w, b = np.zeros(len(kept)), _START
    seen_w, seen_b, total = np.full(len(kept), 1e-8), 1e-8, weight.sum()
    for _ in range(EPOCHS):
        z = np.bincount(sent, w[feat], n) + b
        p = np.clip(1 / (1 + np.exp(-z)), 1e-12, 1 - 1e-9)
        log_none = np.bincount(doc, np.log1p(-p), len(rows))
        blame = np.where(y > 0, np.exp(log_none) / np.maximum(-np.expm1(log_none), 1e-6), -1.0) * weight
        g = p * blame[doc] / total
        gw, gb = np.bincount(feat, g[sent], len(kept)), g.sum()
        seen_w, seen_b = seen_w + gw**2, seen_b + gb**2
        step = RATE / np.sqrt(seen_w)
        w = w + step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b += 0.3 * gb / np.sqrt(seen_b)
    return Model(float(b), {f: float(w[i]) for f, i in number.items() if w[i]})


def fit(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVE, negatives: int = TRAIN_NEGATIVE, most_bytes: int = TRAIN_BYTES) -> Model:
    known = plain(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model()
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.where("toxic > 0").orderBy(order, "doc_id").limit(positives).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(negatives))
    # at most positives + negatives ids, by the limits
    own = plain(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = own.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(order).alias("o")).collect()
    total, ids = 0, []
    for r in sorted(sizes, key=lambda r: (r["o"], r["doc_id"])):
        total += r["bytes"] or 0
        if total <= most_bytes:
            ids.append(r["doc_id"])
    if len(ids) < len(sizes):
        own = own.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")
    rows = sorted((r["doc_id"], r["text"] or "", int(r["toxic"] > 0)) for r in own.select("doc_id", "text", "toxic").collect())
    share = {k: counts[k] / max(1, sum(r[2] == k for r in rows)) for k in (0, 1)}
    return train([(t, y, share[y]) for _, t, y in rows])


_EXTRA = [("_score", T.DoubleType()), ("_offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))]


def score(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """docs with _score and _offending: the sentences that score `least` or more, by place."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, bad = [], []
        for text in batch.column("text").to_pylist():
            found = sentences(text or "")
            bag = distinct(found)
            each = held.value.sentence_scores(bag, memo)
            scores.append(noisy_or(each))
            high = {id(ws): p for ws, p in zip(bag, each) if p >= least}
            bad.append([{"start": s, "end": e, "score": high[id(ws)]} for s, e, ws in found if id(ws) in high] if high else [])
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(bad, struct)], names=[*batch.schema.names, "_score", "_offending"])

    return map_arrow(docs, run, extended(docs, _EXTRA))


def offending(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """One row per offending sentence: doc_id, start, end, score, sentence."""
    found = score(plain(docs, "doc_id", "text"), model, least).select("doc_id", "text", F.explode("_offending").alias("o"))
    return found.select("doc_id", "o.start", "o.end", "o.score", F.substring("text", F.col("o.start") + 1, F.col("o.end") - F.col("o.start")).alias("sentence"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that are predicted toxic, columns unchanged."""
    held, restored = shielded(docs, "text")
    return restored(score(held, model).where(F.col("_score") < THRESHOLD))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(plain(docs, "doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("_offending").cast("long").alias("n_offending"))
