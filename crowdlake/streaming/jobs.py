"""Streaming jobs: micro-batches that run the batch operators and write idempotently.

A batch that is retried after a failure overwrites its own output, so every sink below is safe to
repeat.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crowdlake import constants as K
from crowdlake.operators import autoregressive, fleet, forecast
from crowdlake.operators.scale import join_keys, keep_latest
from crowdlake.operators.temporal import mode_gate
from crowdlake.streaming.processors import lateness_stream


def with_lateness(df: DataFrame, event_time: str, delay: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """Rows in time, each camera's stale sequence numbers left out. :func:`write_with_lateness` keeps the late ones too."""
    return lateness_stream(df, event_time, delay, keep).where("not late").drop("late")


def write_with_lateness(
    df: DataFrame, event_time: str, path: str, checkpoint: str, delay: str = "10 minutes", keep: str = "1 hour", **options: str
):
    """Rows in time go to ``path`` under ``late=false``, late ones to the side table under ``late=true``, per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch_id={batch_id}")

    return lateness_stream(df, event_time, delay, keep, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_with_lateness(spark: SparkSession, path: str) -> DataFrame:
    """Both tables of :func:`write_with_lateness`, with ``batch_id`` and ``late``."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("late", F.col("late").cast("boolean"))


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows in time and late ones of each micro-batch that :func:`write_with_lateness` wrote."""
    return read_with_lateness(spark, path).groupBy("batch_id").agg(F.count_if(~F.col("late")).alias("in_time"), F.count_if("late").alias("late"))


def session_summary(df: DataFrame, event_time: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Gap sessions per camera with Spark's session window."""
    return (
        df.withWatermark(event_time, delay)
        .groupBy("camera_id", F.session_window(event_time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), F.max("count").alias("peak_count"))
        .select("camera_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "peak_count")
    )


def append_batches(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", transform=None):
    """Write each micro-batch to its own folder ``batch_id=<n>``, after ``transform(batch)``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def gated_updates(updates: DataFrame, modes_path: str, path: str, checkpoint: str):
    """Updates with the mode in force, matched per micro-batch against the table of mode changes."""
    spark = updates.sparkSession
    return append_batches(
        updates, path, checkpoint, transform=lambda batch: mode_gate(batch, spark.read.parquet(modes_path))
    )


class _Folder:
    """Small files of a state table's folder, through Hadoop, wherever it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path, spark.sparkContext._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        found = self.fs.globStatus(self.at(f"{folder}/*")) or []
        return [s.getPath().getName() for s in found]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write beside and rename: readers see the whole file or none."""
        draft = self.at(f"{name}.draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(draft, self.at(name)):
            raise OSError(f"cannot rename {draft} to {name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifests(folder: _Folder, before: int | None = None) -> list[int]:
    found = [int(n.removesuffix(".json")) for n in folder.names("manifests") if n.endswith(".json")]
    return sorted(v for v in found if before is None or v < before)


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest whole version of a state table, or the newest below ``before``."""
    folder = _Folder(spark, path)
    found = _manifests(folder, before)
    return _read_buckets(spark, path, json.loads(folder.read(f"manifests/{found[-1]}.json"))) if found else None


def _read_buckets(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame | None:
    files = [f"{path}/data/v={v}/_bucket={b}" for b, v in sorted(places.items())]
    return spark.read.parquet(*files) if files else None


def current_state_stream(
    updates: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ("t", "event_id"), versions: int = 3, buckets: int = 64
):
    """Maintain one row per camera, in ``buckets`` files by a hash of the camera.

    A micro-batch is reduced to its newest rows; only the buckets that they fall into are read, merged and written anew. Then
    a manifest, a file that names the version of every bucket, appears at once: readers see the state after a whole batch.
    Buckets that none of the newest ``versions`` manifests names are dropped; until then readers at work keep theirs, and a batch
    that is run again starts from the manifest before it.
    """
    spark = updates.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        folder = _Folder(spark, path)
        found = _manifests(folder, batch_id)
        places = json.loads(folder.read(f"manifests/{found[-1]}.json")) if found else {}
        bucket = F.pmod(F.xxhash64("camera_id"), F.lit(buckets)).cast("int")
        newest = fleet.current_state(batch, order).withColumn("_bucket", bucket).persist()
        touched = [str(r[0]) for r in newest.select("_bucket").distinct().collect()]
        if touched:
            old = _read_buckets(spark, path, {b: places[b] for b in touched if b in places})
            both = newest.drop("_bucket") if old is None else newest.drop("_bucket").unionByName(old)
            merged = fleet.current_state(both, order).withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={batch_id}")
        newest.unpersist()
        folder.put(f"manifests/{batch_id}.json", json.dumps({**places, **dict.fromkeys(touched, batch_id)}))
        _drop_unnamed(folder, versions)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _drop_unnamed(folder: _Folder, versions: int) -> None:
    """Drop old manifests, and the buckets that no manifest names any more."""
    found = _manifests(folder)
    for v in found[:-versions]:
        folder.drop(f"manifests/{v}.json")
    named = {(v, b) for m in found[-versions:] for b, v in json.loads(folder.read(f"manifests/{m}.json")).items()}
    for name in folder.names("data"):
        v = int(name.removeprefix("v="))
        held = [n.removeprefix("_bucket=") for n in folder.names(f"data/{name}") if n.startswith("_bucket=")]
        gone = [b for b in held if (v, b) not in named]
        for b in gone:
            folder.drop(f"data/{name}/_bucket={b}")
        if len(gone) == len(held):
            folder.drop(f"data/{name}")


#: Models that a stream computes beside Holt and the recent level; they vote in the ensemble if not in ``shadow``.
STREAM_MODELS = ("daily_seasonal", "autoregressive")


def latest_forecasts(tail: DataFrame, keys: Sequence[str] = forecast.KEYS, shadow: Sequence[str] = STREAM_MODELS) -> DataFrame:
    """Forecasts of all models from the newest sample of each history tail (``t, event_id, value``).

    ``rn``, if the tail has it, is the sample's number in its whole history; else the tail is the whole. A
    tail of a day is enough for all models; older samples weigh nothing in the level and trend.
    Plugged-in models see the tail. ``shadow`` models stay out of the ensemble.
    """
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    if "rn" not in tail.columns:
        # A tail is bounded by the number of rows kept per key.
        tail = tail.withColumn("rn", F.row_number().over(w).cast("bigint"))
    last = F.max("rn").over(Window.partitionBy(*keys))
    numbered = tail.withColumn("_newest", F.col("rn") == last)
    plain = numbered.drop("_newest")
    extra = {
        "daily_seasonal": forecast.daily_seasonal(plain, keys),
        "autoregressive": autoregressive.ar_ridge(numbered, keys, origin="_newest"),
        **forecast.registered_models(plain),
    }
    newest = numbered.where("_newest").select(*keys, "rn")
    return forecast.candidates(plain, extra, shadow, keys).join(newest, [*keys, "rn"])


def forecast_stream(
    samples: DataFrame, path: str, checkpoint: str, tail_rows: int = 5760, shadow: Sequence[str] = STREAM_MODELS
):
    """Forecast every camera a micro-batch touches from the newest rows of its history.

    ``samples`` are accepted, smoothed samples (``camera_id, session_id, t, event_id, value``). The
    history is appended below ``path/history``, partitioned by day of the batch's times. Rows per camera and day
    are counted from the key columns alone; of the values a batch reads only the days its tails reach, however
    long a camera was silent. A tail has ``tail_rows`` rows, a day of samples at least, which the daily model
    looks back to. Models in ``shadow`` are predicted but stay out of the ensemble; with ``shadow=()`` all vote.
    """
    spark = samples.sparkSession
    day = 86_400.0
    tail_rows = max(tail_rows, round(day / K.SAMPLE_INTERVAL), autoregressive.SERIES)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("day", F.floor(F.col("t") / day))
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{path}/history/batch_id={batch_id}")
        history = spark.read.option("basePath", f"{path}/history").parquet(f"{path}/history")
        touched = history.where(F.col("batch_id") == batch_id).select(*forecast.KEYS).distinct()
        known = join_keys(history.where(F.col("batch_id") <= batch_id), touched, forecast.KEYS, "left_semi")
        newer = Window.partitionBy(*forecast.KEYS).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
        counts = known.groupBy(*forecast.KEYS, "day").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).persist()
        days = [r["day"] for r in counts.where(F.col("_newer") < tail_rows).select("day").distinct().collect()]
        if not days:
            counts.unpersist()
            return
        # Rows without a time are the oldest ones, as they are in the order of the tail.
        reached = reduce(lambda a, b: a | b, [F.col("day").eqNullSafe(F.lit(d)) for d in days])
        tail = known.where(reached).select(*forecast.KEYS, "t", "event_id", "value")
        tail = keep_latest(tail, forecast.KEYS, tail_rows, ["t", "event_id"])
        total = counts.groupBy(*forecast.KEYS).agg(F.sum("n").alias("_total"))
        back = F.row_number().over(Window.partitionBy(*forecast.KEYS).orderBy(F.desc("t"), F.desc("event_id")))
        tail = join_keys(tail, total, forecast.KEYS).withColumn("rn", (F.col("_total") - back + 1).cast("bigint")).drop("_total")
        tail.persist()
        latest_forecasts(tail, shadow=shadow).write.mode("overwrite").parquet(f"{path}/forecasts/batch_id={batch_id}")
        tail.unpersist()
        counts.unpersist()

    return samples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
