import os

from pyspark.sql import functions as F

from claimloom.plans import catalogue
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_cases_take_every_pair_of_a_measure(spark, tmp_path):
    """Two measures of 400 facts each: the best cases lie outside the runs of 41 facts that other queries pair."""
    for name in os.listdir(SF):
        if name != "orders.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 400")
    orders.withColumn("o_custkey", (1 + F.col("o_orderkey") % 2).cast(orders.schema["o_custkey"].dataType)).write.parquet(str(tmp_path / "part"))
    (tmp_path / "orders.parquet").symlink_to(tmp_path / "part")
    sql = catalogue.oracle_sql()["cases_reconciled"]
    assert "l_place" not in sql.split("p1 AS")[0].split("every AS")[1].split("WHERE")[-1]
    by_file = sql.replace("FROM orders", f"FROM read_parquet('{tmp_path}/part/*.parquet')")
    assert compare(spark, str(tmp_path), catalogue.queries()["cases_reconciled"], by_file) == 3
