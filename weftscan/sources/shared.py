"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation


def landed_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``landed``, and aggregates over the rows that Spark observes in the job that writes them, without a pass of their own."""
    seen = Observation()
    written = landed(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return written, dict(seen.get)


def landed(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: it is computed once, and its lineage ends.

    Only a local session may lack that setting and then uses a temporary folder; on a cluster that is an error, as
    other machines would not see it.
    """
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/weftscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
