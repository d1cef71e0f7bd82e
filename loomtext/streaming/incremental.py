"""Cleaning an arriving corpus with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomtext.plans.clean import DEFAULT, clean


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """The files of a folder as they come."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_at_once) if files_at_once else r).parquet(path)


def clean_stream(docs: DataFrame, out: str, checkpoint: str, steps: tuple[str, ...] = DEFAULT) -> StreamingQuery:
    """Cleans what is there and has not been cleaned, then ends; run again, it goes on where it stopped. No state, no shuffle."""
    texts, _ = clean(docs, steps)
    return texts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_suggestions(items: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each (doc_id, find, replace) once within the time that state is kept."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["doc_id", "find", "replace"])


def running_stats(stats: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Sums by hour of arrival, step and key; rows later than `lateness` are dropped."""
    w = F.window("ts", width)
    stats = stats.withColumn("ts", F.col("ts").cast("timestamp"))
    return stats.withWatermark("ts", lateness).groupBy(w, "step", "key").agg(F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "step", "key", "total")


def last_sums(stats: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of running sums over what there is, in update mode: every batch's changed sums go to files of its own; the table of each sum's last value.

    A batch that runs again overwrites its own files. Nothing goes to the driver, and
    state is kept as long as the sums' watermark says.
    """
    by = [c for c in stats.columns if c != "total"]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stats.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stats.schema.fields, T.StructField("batch", T.LongType())])
    return stats.sparkSession.read.schema(schema).parquet(path).groupBy(*by).agg(F.max_by("total", "batch").alias("total"))


def lasting_sums(stats: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour", width: str = "1 hour") -> StreamingQuery:
    """Sums by hour of arrival, step and key that need no state in memory: every batch's own sums are files, and a batch that runs again overwrites them.

    A row is late if it is older than the newest row of all earlier batches by more
    than `lateness`: it isn't summed but written to the side table `path`/late.
    `path`/sums has, for each batch, hour, step, key and `late`, the total, the number
    of rows and the newest arrival, from which later batches know what is late. Ends
    when all that is there has been summed; run again, it goes on.
    """
    spark = stats.sparkSession
    schema = T.StructType([*(T.StructField(c, T.TimestampType()) for c in ("hour", "newest")), *(T.StructField(c, T.StringType()) for c in ("step", "key")), T.StructField("late", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("total", "n", "batch"))])
    allowed = F.expr(f"interval {lateness}")

    def keep(batch: DataFrame, number: int) -> None:
        earlier = None
        if number:
            # One value reaches the driver. The batches before this one are whole, and a run again reads the same ones.
            earlier = spark.read.schema(schema).parquet(f"{path}/sums").where(F.col("batch") < number).agg(F.unix_micros(F.max("newest") - allowed)).first()[0]
        ts = F.col("ts").cast("timestamp")
        late = F.lit(False) if earlier is None else F.coalesce(F.unix_micros(ts) < earlier, F.lit(False))
        told = batch.withColumn("ts", ts).withColumn("late", late)
        told.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        # A window has no place for a missing time: such rows stand under a null hour.
        hour = F.window(F.coalesce("ts", F.timestamp_seconds(F.lit(0))), width)["start"]
        sums = told.groupBy(hour.alias("at"), F.col("ts").isNull().alias("untimed"), "step", "key", "late")
        sums = sums.agg(F.sum("value").cast("long").alias("total"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
        sums = sums.withColumn("hour", F.when(~F.col("untimed"), F.col("at"))).drop("at", "untimed")
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    return stats.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summed(spark: SparkSession, path: str) -> DataFrame:
    """hour, step, key, total (of the rows in time), late (how many rows were not) from what lasting_sums wrote."""
    total = F.coalesce(F.sum(F.when(~F.col("late"), F.col("total"))), F.lit(0))
    late = F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0))
    return spark.read.parquet(f"{path}/sums").groupBy("hour", "step", "key").agg(total.alias("total"), late.alias("late"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into a table in memory, for small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
