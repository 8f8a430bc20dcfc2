"""Solutions that arrive as a stream of files: each appended once, however late it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, row_id: str, loaded_at: str) -> DataFrame:
    """A stream of rows as they come; ``append_to`` knows repeats by the column marked here as id."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn(loaded_at, F.col(loaded_at).cast("timestamp")).withMetadata(row_id, {"row_id": True})


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files and stop.

    Each batch leaves out the ids that are stored already, so no row is lost for its age, repeats are known after any time, and
    a batch that is run again adds nothing. That reads the stored ids once a batch, and asks for one writer per folder. Rows without an id
    can't be told from repeats and are all kept. A folder written by Spark's own file sink is refused: its readers wouldn't see the new files.
    """
    row_id = next(f.name for f in stream.schema.fields if f.metadata.get("row_id"))
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_spark_metadata")):
        raise ValueError(f"{folder} was written by a file sink")

    def add(batch: DataFrame, _: int) -> None:
        known = batch.filter(F.col(row_id).isNotNull()).dropDuplicates([row_id])
        if fs.exists(path):
            stored = batch.sparkSession.read.schema(batch.schema).parquet(folder).select(row_id)
            known = known.join(stored, row_id, "left_anti").select(*batch.columns)
        known.unionByName(batch.filter(F.col(row_id).isNull())).write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
