"""Windows and state on event streams; each has a batch twin with the same result once all data has arrived."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strophe.session import checkpoint_dir


def event_stream(spark: SparkSession, path: str, schema=None, per_trigger: int | None = None) -> DataFrame:
    """A file stream over parquet; the schema is given or taken from the files once."""
    schema = schema or spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    # a trailing class makes a pattern of the path, which a file stream needs for a single file
    return r.parquet(path[:-1] + f"[{path[-1]}]")


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need a timestamp with zone: the column is cast at this boundary."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.window(ts, width), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").alias("start"), *keys, *aggs)


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.window(ts, width, step), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").alias("start"), *keys, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    s = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last state of each key; as a stream it runs in complete or update mode."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, "s.*")


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all data there is, checkpointed in the shared folder, and returns what it wrote.

    append: the file sink, exactly once. update and complete: every micro-batch goes to a folder of its own; of complete, only the
    last batch is the result. ``each`` sees every batch first.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if mode == "append" and each is None:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    batches: list[int] = []

    def write(df: DataFrame, n: int) -> None:
        if each:
            each(df, n)
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        batches.append(n)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    all_ = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out)
    return all_.parquet(f"{out}/batch={batches[-1]}" if mode == "complete" else out)


def closed(df: DataFrame, ts: str, path: str, after: str = "30 days") -> str:
    """Writes a table as the files of a stream that has come to its end: last comes a mark so much later than all rows, which moves the
    watermark past every window of theirs. The mark's own window is never complete, so it is in no result."""
    df.write.parquet(path)
    end = df.agg((F.max(ts).cast("timestamp") + F.expr(f"interval {after}")).alias("t"))
    end.select(*[F.col("t").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(path)
    return path


def not_done(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that an earlier run has not finished (incremental processing by output)."""
    return new.join(done.select(key).distinct(), key, "left_anti")
