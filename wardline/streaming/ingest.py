"""Events that arrive as a stream, merged into a table by batch, and counts over windows of their arrival."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardline.session import cut_lineage


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrivals(events: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """start, normalized_term, n, delay_s: rows and mean delay by window of loaded_at; windows close ``late`` after the newest row."""
    events = events.withColumns({c: F.col(c).cast("timestamp") for c in ("loaded_at", "charted_at")})
    delay = F.unix_seconds("loaded_at") - F.unix_seconds("charted_at")
    w = events.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window).alias("w"), "normalized_term")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(delay).alias("delay_s")).select(F.col("w.start").alias("start"), "normalized_term", "n", "delay_s")


def without_repeats(events: DataFrame, late: str = "60 days") -> DataFrame:
    """Rows of a stream whose content was not seen before within the watermark."""
    content = [c for c in events.columns if c not in ("event_id", "loaded_at")]
    return events.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(content)


def latest(events: DataFrame, key: str = "event_id", by: str = "loaded_at") -> DataFrame:
    """The newest row of every key; ties by all columns."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), F.xxhash64(*events.columns))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Parts that a table is cut into by a hash of its key.
PARTS = 64


def upsert(spark: SparkSession, table: str, key: str = "event_id", by: str = "loaded_at", parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces rows of the same key, rewriting only the parts of the table that the batch touches.

    A version of the table is a folder with the parts written by one batch; the newest version of each part counts, and
    a version counts once it is complete. So a batch that is run again after a failure writes the same version once more
    and readers never see half of it. Of every part the newest two versions are kept, older ones are removed. The number
    of parts of a table can't be changed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        new = cut_lineage(latest(batch, key, by).withColumn("part", part))
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # at most ``parts``
        if not touched:
            return
        old = current(spark, table, batch_id, touched)
        whole = new if old is None else new.unionByName(old.join(new.select(key), key, "left_anti").withColumn("part", part))
        whole.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/v={batch_id:09d}")
        forget(spark, table)

    return write


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of a table."""
    jvm = spark.sparkContext._jvm
    found = _folders(spark, table, "v=")
    fs = jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/v={v:09d}/_SUCCESS"))]


def written(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The complete versions of each part, from the oldest."""
    out: dict[int, list[int]] = {}
    for v in versions(spark, table):
        for p in _folders(spark, f"{table}/v={v:09d}", "part="):
            out.setdefault(p, []).append(v)
    return out


def current(spark: SparkSession, table: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The newest version of every part, or of some parts, or the newest below ``before``."""
    have = {p: [v for v in vs if before is None or v < before] for p, vs in written(spark, table).items() if parts is None or p in parts}
    paths = [f"{table}/v={vs[-1]:09d}/part={p}" for p, vs in sorted(have.items()) if vs]
    return spark.read.parquet(*paths) if paths else None


def forget(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` versions of every part."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for p, vs in written(spark, table).items():
        for v in vs[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{table}/v={v:09d}/part={p}"), True)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Takes in all that is there, batch by batch, and stops."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
