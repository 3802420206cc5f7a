"""Streams that keep state give what batches give, in whatever order pages arrive."""

import datetime
import random

from pyspark.sql import functions as F

from weftscan.operators import shapes
from weftscan.streaming import first_pages

SCHEMA = "site_id string, url string, page_seq long, text_hash string, landed_at timestamp"


def test_first_pages_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(21)
    start = datetime.datetime(2024, 5, 1)
    rows = [(f"s{rng.randrange(3)}", f"u{rng.randrange(12)}", k // 2, f"h{rng.randrange(9)}", start + datetime.timedelta(minutes=rng.randrange(50))) for k in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = {(r.site_id, r.url): (r.page_seq, r.text_hash, r.copies) for r in shapes.keep_first(table.drop("landed_at"), ["site_id", "url"], ["page_seq", "text_hash"]).collect()}
    for order in (1, 2):
        rng.shuffle(rows)
        for k in range(0, 120, 40):
            spark.createDataFrame(rows[k : k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{order}")
        pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{order}")
        query = first_pages.follow_first_pages(pages, f"{tmp_path}/out{order}", f"{tmp_path}/state{order}")
        assert query.awaitTermination(180) and query.exception() is None
        updates = spark.read.parquet(f"{tmp_path}/out{order}")
        assert updates.select("batch").distinct().count() >= 3
        last = updates.groupBy("site_id", "url").agg(F.max_by(F.struct("page_seq", "text_hash", "copies"), "batch").alias("x")).select("site_id", "url", "x.*")
        assert {(r.site_id, r.url): (r.page_seq, r.text_hash, r.copies) for r in last.collect()} == want
