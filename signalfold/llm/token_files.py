"""Token ids of documents as Parquet files that allow selective reads of tokens and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalfold.llm.bpe import encoder, text_blocks
from signalfold.llm.worker import giving_back


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 5000,
) -> None:
    """Encode every whole text and write the ids in ascending document order.

    Each file holds a range of ids: `doc_id`, `n_tokens`, `part` (number of the file), `before`
    (tokens of earlier documents of the file) and `ids` (list of 32-bit integers, `end_id` last).
    Token ids are dictionary-coded, the metadata columns delta-coded; row groups and pages have
    the given sizes, and the page indexes let a reader skip to the documents it asks for.

    A null or empty text has the end id alone.  Rows without an id come first.  Rows that share
    an id stay separate, ordered by the hash of their text, so one id may hold any share of the
    rows.  An empty table gives files without rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in text_blocks(batch):
                raw = [ids + end for ids in bpe.encode(some.column("text").to_pylist())]
                sizes = np.array([len(ids) // 4 for ids in raw], np.int64)
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(sizes), pa.array(np.full(len(raw), part, np.int64)),
                     pa.array(before + ends - sizes), ids],
                    names=["doc_id", "n_tokens", "part", "before", "ids"],
                )
                before += int(ends[-1])

    encoded = ordered.mapInArrow(giving_back(encode), "doc_id long, n_tokens long, part long, before long, ids array<int>")
    writer = encoded.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2")
    for name in ("doc_id", "n_tokens", "part", "before"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    (writer.option("parquet.enable.dictionary", "true").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).parquet(path))


def token_starts(files: DataFrame) -> DataFrame:
    """Number of tokens before each file, from the metadata columns alone: (part, first)."""
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    # One row per file, not per document.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            sums = [zlib.crc32(values[a * 4 : b * 4]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_tokens", "part", "before")] + [pa.array(sums, pa.int64())],
                names=["doc_id", "n_tokens", "part", "before", "ids_crc32"],
            )

    files = spark.read.parquet(path)
    rows = files.mapInArrow(giving_back(digest), "doc_id long, n_tokens long, part long, before long, ids_crc32 long")
    return rows.join(token_starts(files), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
