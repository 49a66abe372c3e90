"""Running band statistics of a stream of pixels.

Moments add up, so each micro-batch adds one row a band to a state table; a reader sums it.  A batch that is
run again after a failure overwrites its own rows and is not counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_statistics(cubes: DataFrame, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps, in the folder `state`, (n, mean, m2) by band and micro-batch."""

    def add(batch: DataFrame, number: int) -> None:
        x = batch.select(F.posexplode("bands").alias("band", "x")).groupBy(F.col("band").cast("long").alias("band"))
        v = F.col("x").cast("double")
        x.agg(F.count("x").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("x")).alias("m2")).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return cubes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_statistics(spark: SparkSession, state: str) -> DataFrame:
    """(band, n, mean, std_dev) of all pixels so far."""
    s = spark.read.parquet(state)
    all_ = s.groupBy("band").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    m2 = s.join(all_.select("band", F.col("mean").alias("mu")), "band").groupBy("band").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))).alias("m2"))
    return all_.join(m2, "band").select("band", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std_dev"))
