"""The driver's tables as point clouds: id, gx, gy, gz, morton and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.morton import encode
from lattica.operators.running import settled  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    grid = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gx"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("gy"),
        (F.col("o_totalprice") / F.lit(100.0)).cast("long").alias("gz"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )
    return grid.withColumn("morton", encode("gx", "gy", "gz"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    grid = li.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("id"), F.col("l_partkey").alias("gx"), F.col("l_suppkey").alias("gy"),
        (F.col("l_extendedprice") / F.lit(100.0)).cast("long").alias("gz"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"),
    )
    return grid.withColumn("morton", encode("gx", "gy", "gz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    grid = e.select(
        F.col("event_id").alias("id"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(60000000)).cast("long").alias("gx"), F.col("user_id").alias("gy"),
        F.col("value").cast("long").alias("gz"), F.col("event_type").alias("type"), "value",
    )
    return grid.withColumn("morton", encode("gx", "gy", "gz"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    axis = lambda k: ((F.col("embedding")[k].cast("double") + F.lit(1.0)) * F.lit(1000.0)).cast("long")
    return v.select(F.col("vec_id").alias("id"), axis(0).alias("gx"), axis(1).alias("gy"), axis(2).alias("gz"), "label").withColumn("morton", encode("gx", "gy", "gz"))


def _interleave(bits: int = 20) -> str:
    one = lambda k: f"(((gx >> {k}) & 1) + 2 * ((gy >> {k}) & 1) + 4 * ((gz >> {k}) & 1)) * {8**k}"
    return " + ".join(one(k) for k in range(bits))


#: SQL of the orders cloud, as common table expressions; `pts` has id, gx, gy, gz, morton and the attributes.
ORDERS_SQL = f"""grid AS (SELECT o_orderkey AS id, o_custkey AS gx, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS gy,
    CAST(trunc(o_totalprice / 100.0) AS BIGINT) AS gz, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders),
pts AS (SELECT *, CAST({_interleave()} AS BIGINT) AS morton FROM grid)"""
EMBEDDINGS_SQL = f"""grid AS (SELECT vec_id AS id, CAST(trunc((CAST(embedding[1] AS DOUBLE) + 1.0::DOUBLE) * 1000.0::DOUBLE) AS BIGINT) AS gx, CAST(trunc((CAST(embedding[2] AS DOUBLE) + 1.0::DOUBLE) * 1000.0::DOUBLE) AS BIGINT) AS gy,
    CAST(trunc((CAST(embedding[3] AS DOUBLE) + 1.0::DOUBLE) * 1000.0::DOUBLE) AS BIGINT) AS gz, label FROM embeddings),
pts AS (SELECT *, CAST({_interleave()} AS BIGINT) AS morton FROM grid)"""
