"""The cleaning pipeline over a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import CleanConfig
from corpusloom.functions.text import split_lines
from corpusloom.plans.clean import clean_pages


def clean_folder(spark: SparkSession, source: str, out: str, checkpoint: str, config: CleanConfig | None = None, schema: str = "doc_id string, text string") -> StreamingQuery:
    """Clean Parquet rows (doc_id, text; a form feed ends a page) as they arrive; ends when all there is is done.

    Each row is cleaned by itself, so no watermark is needed; batches are appended exactly once.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    pages = rows.select("doc_id", F.transform(F.split("text", "\f", -1), split_lines).alias("pages"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return clean_pages(pages, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
