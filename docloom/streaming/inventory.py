"""New documents as a stream: each micro-batch is converted once and appended; the checkpoint remembers what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import inventory
from ..options import Options
from ..plans.convert import convert
from ..sources.files import from_bytes


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "page_id long, url string, html string", options: Options = Options(), once: bool = True) -> StreamingQuery:
    """Convert Parquet rows of pages that arrive in ``source``; append their inventory and Markdown to ``target``.

    Writes are by batch number, so a batch that is tried again after a failure replaces itself.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        docs = from_bytes(batch, F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), "page_id")
        done = convert(docs, options, ["html"]).results()
        rows = done.select(F.col("name").alias("path"), "markdown", F.lit(None).cast("string").alias("error"), F.lit(0).alias("elapsed_ms"))
        inventory(rows).write.mode("overwrite").parquet(f"{target}/inventory/batch={number}")
        done.select("doc_id", "markdown").write.mode("overwrite").parquet(f"{target}/markdown/batch={number}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
