"""Writers. Spark's commit protocol makes a table appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON manifest beside tables, through Spark, so that any store will do."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def append_summary(summary: DataFrame, path: str, **labels: str) -> None:
    """Add a posterior summary to a table, labelled with constants such as data set and method."""
    summary.withColumns({k: F.lit(v) for k, v in labels.items()}).write.mode("append").parquet(path)


def complete_shards(draws: DataFrame, shards: int) -> DataFrame:
    """draws, refused if a shard is missing or shards differ in length."""
    sizes = draws.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if sizes["held"] != shards or sizes["least"] != sizes["most"]:
        raise ValueError(f"{sizes['held']} of {shards} shards, with {sizes['least']} to {sizes['most']} draws")
    return draws


def unfinished(work: DataFrame, done_path: str, *keys: str) -> DataFrame:
    """Rows of work whose keys the table at done_path lacks; all of them if there is no such table yet."""
    spark = work.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return work
    return work.join(spark.read.parquet(done_path).select(*keys).distinct(), list(keys), "left_anti")
