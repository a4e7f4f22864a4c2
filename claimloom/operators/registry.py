"""Registries of measures and entities: alias lookup, nearest rows, creation, slugs (REG-1..8, JON-10, JON-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Cosines from which a measure is linked, up to which it is new; from which an entity is linked.
LINK, NEW, ENTITY_LINK = 0.94, 0.80, 0.92
MOST_ALIASES = 40
#: Bytes of registry vectors that one pass compares every surface with.
BLOCK_BYTES = 64 << 20


def resolve(surfaces: DataFrame, registry: DataFrame, entity: bool = False) -> DataFrame:
    """JON-10, REG-3: surfaces (surface) with the id whose alias they equal; registry: (id, aliases). The least id wins.

    An entity is looked up by its alias, then without its legal form.
    """
    out = surfaces
    keys = {"_plain": T.alias_key} | ({"_short": T.entity_alias_key} if entity else {})
    for name, key in keys.items():
        known = registry.select("id", F.explode("aliases").alias("a")).groupBy(key(F.col("a")).alias(name)).agg(F.min("id").alias(f"{name}_id"))
        out = out.withColumn(name, key(F.col("surface"))).join(known, name, "left").drop(name)
    return out.withColumn("id", F.coalesce(*[f"{k}_id" for k in keys])).drop(*[f"{k}_id" for k in keys])


def create(unresolved: DataFrame, taken: DataFrame, entity: bool = False) -> DataFrame:
    """REG-5, REG-7: one row per new alias key: name, slug (suffixed -2, -3 … past all taken ones), sorted aliases (40 at most)."""
    key = (T.entity_alias_key if entity else T.alias_key)(F.col("surface"))
    rows = unresolved.groupBy(key.alias("key")).agg(F.lower(F.min("surface")).alias("name"), F.slice(F.array_sort(F.collect_set("surface")), 1, MOST_ALIASES).alias("aliases"))
    rows = rows.withColumn("base", T.slugify(F.col("name")))
    # a slug is free if it isn't taken as it stands: of the numbers 1 (the base alone), 2, 3 … the first that are not in use
    plain = taken.select(F.col("slug").alias("base"), F.lit(1).alias("n"))
    numbered = taken.where(F.col("slug").rlike(r"-[1-9]\d{0,8}$")).select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), F.regexp_extract("slug", r"-(\d+)$", 1).cast("int").alias("n")).where("n > 1")
    used = plain.unionByName(numbered).groupBy("base").agg(F.collect_set("n").alias("used"))
    of_base = Window.partitionBy("base")
    placed = rows.join(used, "base", "left").withColumns({"place": F.row_number().over(of_base.orderBy("name", "key")), "many": F.count(F.lit(1)).over(of_base), "used": F.coalesce("used", F.array().cast("array<int>"))})
    n = F.element_at(F.array_except(F.sequence(F.lit(1), F.size("used") + F.col("many").cast("int")), "used"), F.col("place"))
    made = placed.withColumn("n", n).withColumn("slug", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")))
    # a name that ends in a number can meet another's numbered slug: the first keeps it
    twin = F.row_number().over(Window.partitionBy("slug").orderBy("base", "key"))
    return made.withColumn("twin", twin).select("name", F.when(F.col("twin") > 1, F.concat_ws("-", "slug", F.lit("x"), F.col("twin").cast("string"))).otherwise(F.col("slug")).alias("slug"), "aliases")


def with_aliases(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """REG-4, REG-6, JSN-6: registry (id, aliases, unit_class) with surfaces seen (id, surface, unit_class, position): sorted, 40 at most; a null class takes the first one seen."""
    more = seen.groupBy("id").agg(F.collect_set("surface").alias("more"), F.min_by("unit_class", F.when(F.col("unit_class").isNotNull(), F.col("position"))).alias("first_class"))
    both = F.slice(F.array_sort(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>")))), 1, MOST_ALIASES)
    return registry.join(more, "id", "left").withColumns({"aliases": both, "unit_class": F.coalesce("unit_class", "first_class")}).drop("more", "first_class")


def compatible(a: Column, b: Column) -> Column:
    """REG-2: a class that is unknown on either side fits all."""
    return a.isNull() | b.isNull() | (a == b)


def nearest(surfaces: DataFrame, registry: DataFrame, least: float = LINK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """JON-11: the registry row of compatible unit class with the highest cosine (ties: the least id), if high enough.

    The registry is a dimension; it is sent to the tasks in blocks of a checked size in bytes, and the condition is the same at
    every size.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    reg = registry.select(F.col("id").alias("measure_id"), F.col("vector").alias("rv"), F.col("unit_class").alias("rc"))
    size = reg.agg(F.sum(8 * F.size("rv") + 32)).first()[0] or 0
    blocks = int((size - 1) // block_bytes + 1) if size else 1
    best = None
    for i in range(blocks):
        some = reg.where(F.pmod(F.xxhash64("measure_id"), F.lit(blocks)) == i)
        scored = surfaces.join(F.broadcast(some), compatible(F.col("rc"), F.col("unit_class"))).withColumn("cosine", dot("vector", "rv") / F.sqrt(dot("vector", "vector") * dot("rv", "rv")))
        part = scored.groupBy("surface").agg(F.max_by(F.struct("measure_id", "cosine"), F.struct("cosine", -F.col("measure_id"))).alias("b"))
        best = part if best is None else best.unionByName(part)
    best = best.groupBy("surface").agg(F.max_by("b", F.struct("b.cosine", -F.col("b.measure_id"))).alias("b"))
    return best.where(F.col("b.cosine") >= least).select("surface", "b.measure_id", "b.cosine")


def decided(surfaces: DataFrame, registry: DataFrame, answers: DataFrame | None = None, entity: bool = False) -> DataFrame:
    """REG-1, REG-3, REG-8: surfaces (surface, vector, unit_class) with decision (alias, linked, created, asked) and id.

    Aliases first. Then a measure of high cosine is linked, one of low cosine is new, and between the two an answer
    (surface, id; null: new) decides if its unit class fits, else it is new. An entity is linked from ENTITY_LINK on
    if its words are the same set.
    """
    named = resolve(surfaces, registry, entity)
    best = nearest(named.where("id is null"), registry, -1.0)
    rows = named.join(best, "surface", "left")
    if entity:
        other = registry.select(F.col("id").alias("measure_id"), F.element_at("aliases", 1).alias("_alias"))
        rows = rows.join(other, "measure_id", "left")
        linked = (F.col("cosine") >= ENTITY_LINK) & T.same_organisation(F.col("surface"), F.col("_alias"))
        return rows.select("surface", F.when(F.col("id").isNotNull(), "alias").when(linked, "linked").otherwise("created").alias("decision"), F.coalesce("id", F.when(linked, F.col("measure_id"))).alias("id"))
    between = F.col("cosine").between(NEW, LINK) & (F.col("cosine") > NEW) & (F.col("cosine") < LINK)
    if answers is None:
        asked = F.lit(None).cast("long")
    else:
        classes = registry.select(F.col("id").alias("_answer"), F.col("unit_class").alias("_class"))
        rows = rows.join(answers.select("surface", F.col("id").alias("_answer")), "surface", "left").join(classes, "_answer", "left")
        asked = F.when(compatible(F.col("_class"), F.col("unit_class")), F.col("_answer"))
    kind = F.when(F.col("id").isNotNull(), "alias").when(F.col("cosine") >= LINK, "linked").when(between & asked.isNotNull(), "asked").otherwise("created")
    chosen = F.coalesce("id", F.when(F.col("cosine") >= LINK, F.col("measure_id")), F.when(between, asked))
    return rows.select("surface", kind.alias("decision"), chosen.alias("id"))
