"""Token ids as Parquet files that can be read selectively.

Files hold one row for each document in ascending document order: metadata columns
beside a list column of ids. Lists are dictionary-encoded (or delta-encoded, in format
version 2), row groups and pages are small, and Parquet's page indexes are written, so a
reader of some documents or of the metadata alone touches few pages.

Documents are dealt to tasks by ranges of doc_id, sorted there, encoded and written in the
same stage; the text is shuffled once. A task numbers its ids from 0, and the few totals
of the tasks (as many as there are ranges) turn that into positions in the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftscan.llm.chunks import library_encoder, pack_ids
from weftscan.llm.store import shared_folder

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    encoder, end = library_encoder(path), b"" if end_id is None else pack_ids([end_id])
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        for k in range(0, b.num_rows, 512):
            piece = b.slice(k, 512)
            ids = [x + end for x in encoder.encode(piece.column(1).to_pylist())]
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), lists],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1000,
    page_bytes: int = 256 << 10,
    ranges: int | None = None,
) -> None:
    """Encode ``docs`` (doc_id, text) and write token files in ascending doc_id order.

    ``encoding`` is "dictionary" or "delta"; ``ranges`` is the number of files (the
    session's shuffle partitions unless given).

    Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows with
    the same doc_id are ordered by a hash of their text, equal rows in any order; an empty
    table writes no rows; other columns are not read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    encoded = sorted_rows.mapInArrow(lambda it: _encode(it, tokenizer_path, end_id), FILE_SCHEMA)
    writer = encoded.write.mode("overwrite").option("compression", "zstd")
    for k, v in {
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.page.size": page_bytes,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids.

    Selecting only metadata does not read the id pages. The totals that are broadcast have one row
    for each file that was written.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    joined = files.join(F.broadcast(before), "part")
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of each document read from token files."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write token files into the shared folder, read them back and digest them."""
    path = shared_folder(docs.sparkSession)
    write_token_files(docs, path, tokenizer_path, **options)
    return token_file_digest(read_token_files(docs.sparkSession, path))
