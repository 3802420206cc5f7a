"""Tables that cut lineage, written to the folder the cluster shares.

The folder is ``spark.checkpoint.dir``. Only a local session may have none: then a temporary folder of this
machine is used and remembered. On a cluster that is an error, as other machines would not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new, unused folder path below the shared checkpoint folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="weftscan-")
        base = _local[sc.applicationId]
    return f"{base.rstrip('/')}/weftscan-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage to ``df``, so an executor lost later costs a file read
    and not a recomputation.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_clashes(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` without the columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambda variables are bound, not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)
