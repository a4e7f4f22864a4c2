"""Incremental reconciliation: arriving facts are paired with the corpus and among themselves (STR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.operators import reconcile


def reconcile_stream(arriving: DataFrame, corpus_path: str, relations_path: str, checkpoint: str):
    """Starts a query that, for each micro-batch, appends decided, informative relations and then the facts themselves.

    A batch's output goes under its number, so a batch that is run again after a failure replaces its own files; batches are
    partitions of the corpus, and a rerun batch's own partition isn't read. Of the corpus only facts of measures that arrive are paired.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, own = rows.sparkSession, f"{number:010d}"
        rows = rows.persist()
        try:
            schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.StringType())])
            old = spark.read.schema(schema).parquet(corpus_path).where(F.col("batch") != own).drop("batch")
            old = old.join(rows.select("measure_id").distinct(), "measure_id", "left_semi").select(*rows.columns)
            both = old.withColumn("arrived", F.lit(False)).unionByName(rows.withColumn("arrived", F.lit(True)))
            pairs = reconcile.measure_pairs(both, F.col("arrived"))
            decided = reconcile.informative(reconcile.classify(pairs)).select("l_id", "r_id", "relation_type", "dimension", "rule_id")
            decided.write.mode("overwrite").parquet(f"{relations_path}/batch={own}")
            rows.write.mode("overwrite").parquet(f"{corpus_path}/batch={own}")
        finally:
            rows.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
