"""Structured Streaming form of the page job, driven to completion with availableNow."""

import os
import shutil
import tempfile

from unievents.streaming.pages_stream import start_page_stream

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_page_stream(spark):
    root = tempfile.mkdtemp(prefix="unievents-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    shutil.copy(PAGES, os.path.join(src, "part-0.parquet"))
    q = start_page_stream(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    n_pages = spark.read.parquet(PAGES).count()
    texts = spark.read.parquet(os.path.join(root, "out", "page_text"))
    assert texts.count() == n_pages
    assert spark.read.parquet(os.path.join(root, "out", "links")).count() > 0
