"""Incremental ingestion: new survey files become events as they arrive.

Each file is complete in itself, so a stream of files needs no state; ids that
run over all files of a layer continue from the highest one stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshline.operators import features, layers
from meshline.sources import survey

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Survey files of a folder, each once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", survey.GLOB).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder).select("path", "content")


def event_stream(spark: SparkSession, folder: str, zone: int | None = None, encoding: str = "shift_jis") -> DataFrame:
    """Events of a stream of files; stateless, so any sink and mode will do."""
    return features.events(survey.frame(file_stream(spark, folder), zone), encoding)


def _numbered(batch: DataFrame, output: str, batch_id: int) -> DataFrame:
    """A batch's features with ids after those stored by earlier batches. A batch that runs again does not count itself."""
    spark = batch.sparkSession
    fresh = layers.with_user_ids(batch)
    try:
        old = spark.read.parquet(output).where(F.col("batch") < batch_id)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return fresh
    highest = old.groupBy(*layers.KEY).agg(F.max("user_id").alias("_top")).withColumnsRenamed({c: f"_{c}" for c in layers.KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in layers.KEY]
    return fresh.join(highest, same, "left").withColumn("user_id", F.col("user_id") + F.coalesce("_top", F.lit(0))).drop("_top", *(f"_{c}" for c in layers.KEY))


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, zone: int | None = None, encoding: str = "shift_jis", once: bool = True) -> StreamingQuery:
    """Stores new files' features under ``output``, a folder per batch, with ids that run on per layer.

    A batch's folder is replaced when the batch runs again, so each file's
    features are there exactly once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        found = batch.where("event = 'feature'").persist()  # counted and joined: framed once
        try:
            _numbered(found, output, batch_id).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        finally:
            found.unpersist()

    writer = event_stream(spark, folder, zone, encoding).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
