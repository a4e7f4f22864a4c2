"""Personal data: candidate generators, boosted trees on format and context, calibrated thresholds.

Base spans come from fixed patterns and checks and always stay. Loose generators then propose
overlapping candidates (broken or unusual addresses and numbers, credentials); a candidate's format
(lengths, digits, separators, checksum) and context (words before it, the character after it) feed
gradient-boosted trees, and a candidate is added if its score passes the threshold of its kind,
calibrated to a stated precision on held-out candidates. Nobody labelled spans, so positives are base
spans as they are and as people disguise or mistype them (an address with "(at)", a number without
its plus, with a digit wrong or with other separators), each in the context it was found in; negatives are
candidates that overlap no base span of any kind. What the base checks test is therefore no label,
and a candidate they refuse can be taken. A credential has no base kind: there the label is that
its value has six digits or more, and the digits aren't among the features.

Native: matching, features, scores, selection and redaction are DataFrame functions over arrays in
the row of the text; no text is shuffled. Matches get positions by marking them with a noncharacter and
splitting there. Trees and thresholds come from the candidates of every document: those with equal features
and label are counted, by distinct texts, and the driver fits on the counts. Where a kind has more than
MOST_VECTORS of them, its lengths and counts are rounded down to a coarser step, when fitted and when scored, until it
has fewer; every candidate still counts.

Quantifiers are possessive where that cannot change a match: Java then loops instead of recursing,
so texts of any length are safe.

Defined cases: null text is empty and has no spans; repeated rows are rows of their own; without
candidates to learn from nothing is added; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.boosting import Boosted, threshold
from claimloom.llm.common import plain, shielded, staged

KINDS = ("email", "ip", "card", "phone")
#: Kinds of which only candidates exist; they follow the base kinds.
MORE_KINDS = ("secret",)
#: Documents that sample() draws, and the precision that thresholds must reach.
SAMPLE_DOCS = 2_000
PRECISION = 0.97
#: Distinct features of a kind that the driver gets, and matches a text may have before their places are summed by doubling.
MOST_VECTORS, FEW = 20_000, 64

# The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth a scan.
NEEDS = {"email": "@", "phone": "+"}
LOOSE = {
    "email": r"[^\s@<>,;:]{1,64}(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)[^\s@<>,;:]{1,255}",
    "ip": r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11,21}",
    "phone": r"(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}",
    "secret": r"(?i)(?:password|passwd|token|secret|api[_-]?key)[\x20\"':=]{1,4}[A-Za-z0-9_+/=-]{8,200}",
}
CONTEXT = {"email": "mail|write|contact", "ip": "ip|host|server|addr", "card": "card|visa|pay|account", "phone": "phone|call|tel|fax|mobile|dial", "secret": "pass|token|secret|key|auth"}
FEATURES = ("length", "digits", "letters", "marks", "groups", "plus", "luhn", "octets", "dots_after_at", "word_before", "digit_before", "word_after", *(f"near_{k}" for k in CONTEXT))

#: How a base span is disguised or mistyped: pattern and replacement, for each kind.
DISGUISES = {
    "email": [("@", " (at) "), ("@", " @ "), ("@", "[at]"), (r"\.([A-Za-z0-9-]+)$", " .$1")],
    "ip": [(r"^([0-9]+)\.", "$1."), (r"^[0-9]+", "3$0"), (r"\.", ":")],
    "card": [(r"[0-9]$", "0"), (r"[0-9]$", "5"), (r"([0-9]{4})(?=[0-9])", "$1."), ("[ -]", ".")],
    "phone": [(r"^\+", ""), (r"^\+", "00"), (r"^\+[0-9]{1,2}[ .-]?", "")],
}

# Noncharacters: they never stand for text, and no pattern can match them.
MARK, STAND_IN = "\ufdd0", "\ufdd1"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(values: Column, combine) -> Column:
    """Running sums (or maxima: combine) of an int array, which begins from 0, in runs of the square root of its length.

    Growing one array element by element would copy it as often; runs are short, and so is the list of runs.
    """
    grow = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(combine(F.element_at(acc, -1), n))))

    def joined(runs: Column) -> Column:
        before = grow(F.transform(runs, lambda r: F.element_at(r, -1)))
        return _let(before, lambda starts: F.flatten(F.transform(runs, lambda r, j: F.transform(F.slice(r, 2, F.size(r)), lambda v: combine(F.get(starts, j), v)))))

    def cut(x: Column) -> Column:
        run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), run), lambda i: grow(F.slice(x, i, run)))

    return F.when(F.size(values) > 0, _let(_let(values, cut), joined)).otherwise(F.array().cast("array<int>"))


def _found(df: DataFrame, out: str, pattern: str, needs: Column, context: bool) -> DataFrame:
    """df with matches of pattern in _text: array of struct(s, e, m) and, with context, b and a (text around)."""
    marked = F.when(needs, F.split(F.regexp_replace("_text", pattern, f"{MARK}$0{MARK}"), MARK))
    df = df.withColumn("_parts", marked)
    lengths = F.transform("_parts", F.char_length)
    short = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    long = F.concat(F.array(F.lit(0)), scanned(lengths, lambda a, b: a + b))
    df = df.withColumn("_ends", F.when(F.size("_parts") > FEW, long).when(F.size("_parts") > 1, short))
    part, end = (lambda i: F.get("_parts", i)), (lambda i: F.get("_ends", i))
    fields = lambda i: [end(i).alias("s"), end(i + 1).alias("e"), part(i).alias("m")] + ([F.right(part(i - 1), F.lit(24)).alias("b"), F.left(part(i + 1), F.lit(1)).alias("a")] if context else [])
    spans = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1, F.lit(2)), lambda i: F.struct(*fields(i)))
    empty = "array<struct<s:int,e:int,m:string" + (",b:string,a:string" if context else "") + ">>"
    return df.withColumn(out, F.when(F.size("_parts") > 1, spans).otherwise(F.array().cast(empty))).drop("_parts", "_ends")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["m"])


def with_base(df: DataFrame, context: bool = False) -> DataFrame:
    """df with _text (no mark inside) and base_<kind>: array of struct(s, e, m) and, with context, b and a (text around)."""
    df = df.withColumn("_text", F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, STAND_IN))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    for kind in KINDS:
        needs = F.contains("_text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("_digit")
        df = _found(df, f"_all_{kind}", BASE[kind], needs, context)
        df = df.withColumn(f"base_{kind}", F.filter(f"_all_{kind}", _valid_of(kind))).drop(f"_all_{kind}")
    return df


def _features(kind: str, c: Column) -> list[Column]:
    m, one = c["m"], (lambda b: b.cast("double"))
    digits = _digits(m)
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    n = F.char_length(digits)
    return [
        F.char_length(m).cast("double"), n.cast("double"), count("[A-Za-z]"), count("[^A-Za-z0-9]"), count("[A-Za-z0-9]+"), one(m.startswith("+")),
        one(n.between(13, 19) & F.call_function("luhn_check", F.when(n > 0, digits).otherwise("1"))), one(_valid("ip", m)), count(r"@.*?\."),
        one(c["b"].rlike("[A-Za-z]$")), one(c["b"].rlike("[0-9.]$")), one(c["a"].rlike("[A-Za-z0-9]")),
        *[one(F.lower(c["b"]).rlike(w)) for w in CONTEXT.values()],
    ]


_COUNTS = [FEATURES.index(f) for f in ("length", "digits", "letters", "marks", "groups", "dots_after_at")]
_DIGIT_FEATURES = [FEATURES.index("digits"), FEATURES.index("luhn"), FEATURES.index("octets")]


def _candidate_of(kind: str):
    """Function from a match to the candidate: kind, place, whether a base span is there, and features."""

    def shaped(c: Column) -> Column:
        over = [F.exists(f"base_{k}", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])) for k in KINDS]
        own = over[KINDS.index(kind)] if kind in KINDS else F.lit(False)
        x = _features(kind, c)
        if kind not in KINDS:  # what its label is made of is no feature of a credential
            x = [F.lit(0.0) if i in _DIGIT_FEATURES else v for i, v in enumerate(x)]
        label = own if kind in KINDS else F.regexp_count(c["m"], F.lit("[0-9]")) >= 6
        return F.struct(F.lit(kind).alias("k"), c["s"].alias("s"), c["e"].alias("e"), own.alias("base"), (over[0] | over[1] | over[2] | over[3]).alias("any"), label.alias("label"), F.array(*x).alias("x"))

    return shaped


def with_candidates(df: DataFrame) -> DataFrame:
    """with_base()'s rows with cand: array of struct(k, s, e, base, any, label, x: features)."""
    pieces = []
    for kind, pattern in LOOSE.items():
        needs = F.col("_text").rlike("@|[(\\[]at[)\\]]") if kind == "email" else F.col("_text").rlike("(?i)pass|token|secret|api") if kind == "secret" else F.col("_digit")
        df = _found(df, f"_loose_{kind}", pattern, needs, True)
        df = df.withColumn(f"_loose_{kind}", F.transform(f"_loose_{kind}", _candidate_of(kind)))
        pieces.append(f"_loose_{kind}")
    return df.withColumn("cand", F.concat(*pieces)).drop(*pieces)


def _disguised_of(kind: str):
    """Function from a base span to examples of it, as it is and disguised, with the text around it."""

    def shaped(c: Column) -> Column:
        forms = F.array_distinct(F.array(c["m"], *[F.regexp_replace(c["m"], p, r) for p, r in DISGUISES[kind]]))
        return F.transform(forms, lambda m: _example(F.lit(kind), F.lit(True), F.array(*_features(kind, {"m": m, "b": c["b"], "a": c["a"]}))))

    return shaped


def _example(kind: Column, label: Column, x: Column) -> Column:
    return F.struct(kind.alias("k"), label.alias("label"), x.cast("array<int>").alias("x"))  # all features are whole numbers


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(_o, text) of at most sample_docs distinct texts that may hold candidates: those of least hash. For quick looks; fit() takes all."""
    some = docs.where(F.col("text").rlike("[0-9]|@|(?i)pass|token|secret")).select(F.xxhash64("text").alias("_o"), "text")
    least = some.select("_o").distinct().orderBy("_o").limit(sample_docs).agg(F.max("_o")).first()[0]
    return some.where(F.col("_o") <= F.lit(least)).dropDuplicates(["_o"])


def counted(docs: DataFrame) -> DataFrame:
    """(k, held, label, x, n) of every document's examples: n distinct texts have one of these features; a third of the texts is held out."""
    rows = with_candidates(with_base(docs.select("text", F.xxhash64("text").alias("_o")), context=True))
    secret = lambda c: c["k"].isin(*MORE_KINDS)
    own = F.transform(F.filter("cand", lambda c: secret(c) | ~c["any"]), lambda c: _example(c["k"], secret(c) & c["label"], c["x"]))
    base = [F.flatten(F.transform(f"base_{k}", _disguised_of(k))) for k in KINDS]
    # outer: a plain explode would have its array computed once more, in a filter of its own
    each = rows.select("_o", F.explode_outer(F.concat(own, *base)).alias("c")).where("c is not null")
    return each.select("_o", (F.pmod("_o", F.lit(3)) == 0).alias("held"), "c.k", "c.label", "c.x").groupBy("k", "held", "label", "x").agg(F.countDistinct("_o").alias("n"))


def _rounded(value: Column, feature: int, step: int) -> Column:
    """A length or count rounded down to a step; flags stay."""
    return F.floor(value / step) * step if step > 1 and feature in _COUNTS else value


def _collected(examples: DataFrame, most: int) -> dict[str, tuple[int, list]]:
    """{kind: (step, examples of it at this step)}, at most `most` of a kind."""
    examples, steps = staged(examples, "pii-examples"), dict.fromkeys(LOOSE, 1)
    while True:
        step = F.create_map(*[F.lit(v) for kv in steps.items() for v in kv])[F.col("k")]
        x = F.array(*[F.floor(F.get("x", F.lit(i)) / step) * step if i in _COUNTS else F.get("x", F.lit(i)) for i in range(len(FEATURES))])
        rounded = examples.withColumn("x", x).groupBy("k", "held", "label", "x").agg(F.sum("n").alias("n"))
        over = [r["k"] for r in rounded.groupBy("k").count().where(F.col("count") > most).collect()]
        if not over:
            rows = rounded.collect()
            return {k: (steps[k], [r for r in rows if r["k"] == k]) for k in LOOSE}
        steps |= {k: 2 * steps[k] for k in over}


def fit(docs: DataFrame, precision: float = PRECISION, most: int = MOST_VECTORS) -> dict[str, tuple[Boosted, float]]:
    """Trees and threshold of each kind, from the candidates of all documents."""
    out = {}
    for kind, (step, kept) in _collected(counted(docs), most).items():
        x, y = np.array([r["x"] for r in kept], float).reshape(len(kept), len(FEATURES)), np.array([r["label"] for r in kept], float)
        held, n = np.array([r["held"] for r in kept], bool), np.array([r["n"] for r in kept], float)
        if n @ y < 5 or not held.any() or held.all():
            continue
        model = Boosted.fit(x[~held], y[~held], weight=n[~held])
        model.step = step
        out[kind] = model, threshold(model.predict(x[held]), y[held], precision, n[held])
    return out


def with_spans(docs: DataFrame, models: dict[str, tuple[Boosted, float]] | None = None) -> DataFrame:
    """docs with base_<kind> and spans: array of struct(o, k, s, e), base and added, by kind and start."""
    models = fit(plain(docs, "text")) if models is None else models
    df = with_base(docs)
    order = {k: i for i, k in enumerate((*KINDS, *MORE_KINDS))}

    def span_of(k: str):
        return lambda c: F.struct(F.lit(order[k]).alias("o"), F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"))

    def passing(k: str, model: Boosted, cut: float):
        def test(c: Column) -> Column:
            new = (c["k"] == k) & ~c["base"]  # where a base span is, that span stands
            return F.when(new, model.column(lambda f: _rounded(F.get(c["x"], F.lit(f)), f, model.step)) >= cut).otherwise(False)

        return test

    parts = [F.transform(f"base_{k}", span_of(k)) for k in KINDS]
    if models:
        df = with_candidates(df)
        for k, (model, cut) in models.items():
            df = df.withColumn(f"_add_{k}", F.filter("cand", passing(k, model, cut)))
            parts.append(F.transform(f"_add_{k}", span_of(k)))
    return df.withColumn("spans", F.array_sort(F.concat(*parts))).drop("cand", "_digit", *[f"_add_{k}" for k in models])


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["k"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, models: dict[str, tuple[Boosted, float]] | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, overlapping spans by the first's; n_chars follows if present."""
    held, restored = shielded(docs, "text", "n_chars")
    df = with_spans(held, models)
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("ne"), c["e"].alias("e"), c["k"].alias("k"))))
    df = df.withColumn("_sorted", by_start)
    none = F.array().cast("array<struct<s:int,e:int,k:string>>")

    def merged(x: Column) -> Column:
        """Groups of overlapping spans: a span opens one unless it begins before the greatest end so far."""
        spans, reach = x["spans"], x["reach"]
        opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["s"] >= F.get(reach, i - 1)))
        return F.element_at(F.transform(F.array(opens), lambda at: F.transform(at, lambda i, j: F.struct(F.get(spans, i)["s"].alias("s"), F.coalesce(F.get(reach, F.get(at, j + 1) - 1), F.element_at(reach, -1)).alias("e"), F.get(spans, i)["k"].alias("k")))), 1)

    reach = scanned(F.transform("_sorted", lambda c: c["e"]), lambda a, b: F.greatest(a, b))
    groups = F.element_at(F.transform(F.array(F.struct(F.col("_sorted").alias("spans"), reach.alias("reach"))), merged), 1)
    df = df.withColumn("_merged", F.when(F.size("_sorted") > 0, groups).otherwise(none))
    before = lambda c, i: F.coalesce(F.get("_merged", i - 1)["e"], F.lit(0))
    body = F.col("text")
    pieces = F.transform("_merged", lambda c, i: F.concat(F.substring(body, before(c, i) + 1, c["s"] - before(c, i)), F.lit("["), F.upper(c["k"]), F.lit("]")))
    tail = F.substring(body, F.element_at("_merged", -1)["e"] + 1, F.lit(2**31 - 1))
    df = df.withColumn("_new", F.when(F.size("_merged") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(body))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size("_merged") > 0, F.char_length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(df.withColumn("text", F.col("_new")))


def report(docs: DataFrame) -> DataFrame:
    rows = with_spans(plain(docs, "doc_id", "text"))

    def named(k: str):
        return lambda c: F.struct(F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"))

    base = F.concat(*[F.transform(f"base_{k}", named(k)) for k in KINDS])
    return rows.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
