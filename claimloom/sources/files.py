"""File sources and sinks: document registration, cached responses, exports, replace-by-document (SRC-2, SRC-11..15, SNK-1..8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC-11, SRC-12: files below a folder, one row per distinct content; empty files and other formats are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = files.where((F.col("length") > 0) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).select(F.sha2("content", 256).alias("sha256"), "path", "length")
    return rows.groupBy("sha256").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("byte_size"))


#: Largest upload in bytes.
MOST_BYTES = 100 << 20


def refusals(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """SRC-11: files (content, length) with refused: empty (400), too_large (413), no_pdf (415), or null."""
    pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return files.withColumn("refused", F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(~pdf, "no_pdf"))


def page_subset(pages: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """SRC-2: the named pages, or all."""
    return pages if numbers is None else pages.where(F.col("page_number").isin(numbers))


def not_ingested(files: DataFrame, documents: DataFrame) -> DataFrame:
    return files.join(documents.select("sha256"), "sha256", "left_anti")


RESPONSE = "data string, raw_text string, provider string, model string, input_tokens long, output_tokens long"


def responses(spark: SparkSession, paths: list[str], providers: tuple[str, ...] = ("gemini", "openrouter", "ollama")) -> DataFrame:
    """SRC-14, SNK-5: cached responses keyed by file name; of equal keys the first folder wins."""
    out = None
    for i, p in enumerate(paths):
        part = spark.read.schema(RESPONSE).option("multiLine", "true").option("recursiveFileLookup", "true").json(p).withColumn("key", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).withColumn("order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    out = out.where(F.lower(F.trim("provider")).isin(*providers))
    return out.groupBy("key").agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("key", "order")]), "order").alias("r")).select("key", "r.*")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-1..3: CSV with quoted commas and quotes, or JSON lines; parallel files, order within the writer's partitions."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else writer.json(path)


def json_array(df: DataFrame, out) -> int:
    """SNK-3: writes df's rows to a text stream as one JSON array, a partition at a time; returns their number."""
    n = 0
    out.write("[\n")
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        out.write((",\n" if n else "") + r["j"])
        n += 1
    out.write("\n]\n")
    return n


def snapshot(lists: dict[str, DataFrame], path: str) -> dict[str, int]:
    """SNK-4: each list as JSON lines below path, in its own order; returns their counts."""
    for name, df in lists.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    return {name: next(iter(lists.values())).sparkSession.read.text(f"{path}/{name}").count() for name in lists}


def restored(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """SRC-15: the lists of a snapshot, with their schemas."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def replace_documents(df: DataFrame, path: str, documents: list[int] | None = None) -> None:
    """SNK-7: rows of the given documents replace what the table holds of them; other documents stay.

    documents: those that are replaced, which may have no rows any more; without it, those that df has rows of.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)
    spark = df.sparkSession
    left = {r["document_id"] for r in df.select("document_id").distinct().collect()} if documents else set()
    for number in documents or []:  # a stated list: documents of one call
        if number not in left:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/document_id={number}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def delete_documents(facts: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-8: facts and relations without the documents' own and crossing rows."""
    gone = ids.select("document_id").distinct()
    left = relations.join(gone.select(F.col("document_id").alias("l_document_id")), "l_document_id", "left_anti")
    return facts.join(gone, "document_id", "left_anti"), left.join(gone.select(F.col("document_id").alias("r_document_id")), "r_document_id", "left_anti")
