"""Structured Streaming form of the page job: new page files arriving in a folder are
turned into page text (P1) and event links (P3-P5) per micro-batch with
``foreachBatch``, each batch written to a folder of its own in the Parquet outputs. The checkpoint location keeps
progress, so a restarted query resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pages import page_links, page_texts, resolve_links

PAGE_SCHEMA = "page_id bigint, url string, html string"


def start_page_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint_dir: str,
                      available_now: bool = True):
    """Start the stream; ``available_now`` processes what is there and stops."""
    src = spark.readStream.schema(PAGE_SCHEMA).parquet(pages_dir)

    def process(batch: DataFrame, epoch_id: int) -> None:
        # a folder per batch, replaced as a whole: a batch that runs again doubles nothing
        page_texts(batch).write.mode("overwrite").parquet(f"{out_dir}/page_text/epoch={epoch_id}")
        resolve_links(page_links(batch)).select("page_id", "pos", "link") \
            .write.mode("overwrite").parquet(f"{out_dir}/links/epoch={epoch_id}")

    writer = src.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
