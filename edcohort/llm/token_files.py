"""Token-id files: whole documents as coded id blocks.

File format: a Parquet table. Each row is a run of consecutive documents:

| column | content |
| --- | --- |
| shard, segment | order of the rows: range partition, then number in it |
| doc_ids, doc_tokens | the documents in order, and their ids' number (with the end id) |
| n_ids | number of ids in the row |
| prior_ids, prior_freqs | the fixed id frequencies all blocks of the row start from |
| block_ids, block_bytes, block_crc32 | per block: number of ids, bytes of code, checksum of the ids |
| payload | the blocks' codes one after another (see ``token_coder``) |

Blocks cut the row's ids every ``BLOCK`` ids; each is coded by itself and read
by itself. Documents stand in ascending doc_id over (shard, segment, place).

Plan: documents are range-partitioned by id (the only shuffle of texts) and
sorted within partitions; one map pass tokenises, codes and yields rows, which
Spark's Parquet writer commits, so lost or repeated tasks leave no trace. A
task holds one group of blocks (``GROUP_IDS`` ids, or one longer document).
Reading is a map over rows; places of documents come from the rows' sizes: sums
within a shard, then over shards (one number per partition).

Defined cases: a null or empty text is the end id alone; rows with a repeated
doc_id stand one after another, ordered by a hash of their text; null doc_ids
come first; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_coder as coder
from .common import Workspace, id_text
from .tokens import WORD_BPE, word_tokenizer

END_ID = 1
#: Ids of one row, at least; a document is never cut between rows.
ROW_IDS = 1 << 20
#: Ids coded side by side by one task.
GROUP_IDS = 1 << 23
SCHEMA = ("shard int, segment int, doc_ids array<long>, doc_tokens array<long>, n_ids long, "
          "prior_ids array<int>, prior_freqs array<int>, block_ids array<int>, block_bytes array<int>, "
          "block_crc32 array<long>, payload binary")
ARROW = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("prior_ids", pa.list_(pa.int32())),
    ("prior_freqs", pa.list_(pa.int32())), ("block_ids", pa.list_(pa.int32())),
    ("block_bytes", pa.list_(pa.int32())), ("block_crc32", pa.list_(pa.int64())), ("payload", pa.binary())])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).data)


class _Group:
    """Documents of the rows that a task codes together."""

    def __init__(self, shard: int):
        self.shard, self.segment = shard, 0
        self.rows: list[tuple[list, list, list]] = []
        self.size = self.row_size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if not self.rows or self.row_size >= ROW_IDS:
            self.rows.append(([], [], []))
            self.row_size = 0
        ids_of, tokens, parts = self.rows[-1]
        ids_of.append(doc_id)
        tokens.append(len(ids) // 4)
        parts.append(ids)
        self.size += len(ids) // 4
        self.row_size += len(ids) // 4

    def coded(self) -> pa.RecordBatch:
        out, blocks, priors = [], [], []
        for _, _, parts in self.rows:
            ids = np.frombuffer(b"".join(parts), "<u4")
            own = [ids[a:a + coder.BLOCK] for a in range(0, len(ids), coder.BLOCK)]
            blocks.append(own)
        # one prior for the blocks coded side by side; each row carries it
        prior = coder.Prior.of([b for own in blocks for b in own])
        codes = iter(coder.encode([b for own in blocks for b in own], prior))
        for (doc_ids, tokens, _), own in zip(self.rows, blocks, strict=True):
            mine = [next(codes) for _ in own]
            out.append([self.shard, self.segment, doc_ids, tokens, sum(tokens), prior.ids, prior.freqs,
                        [len(b) for b in own], [len(c) for c in mine], [_crc(b) for b in own], b"".join(mine)])
            self.segment += 1
        self.rows, self.size = [], 0
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def encoded(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """The rows of the token file for ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        group = _Group(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.batch(batch.column("text")), strict=True):
                group.add(doc_id, ids + end)
                if group.size >= GROUP_IDS:
                    yield group.coded()
        if group.size:
            yield group.coded()

    ordered = (id_text(docs).repartitionByRange("doc_id").withColumn("tie", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "tie").drop("tie"))
    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> None:
    encoded(docs, tokenizer, end_id).write.mode("error").parquet(path)


def _blocks_of(rows: list[dict]) -> tuple[list[bytes], list[int]]:
    codes, lengths = [], []
    for row in rows:
        at = 0
        for n, size in zip(row["block_ids"], row["block_bytes"], strict=True):
            codes.append(row["payload"][at:at + size])
            lengths.append(n)
            at += size
    return codes, lengths


def _documents(rows: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    """(row, its ids) for rows that share a prior."""
    prior = coder.Prior(np.array(rows[0]["prior_ids"]), np.array(rows[0]["prior_freqs"]))
    codes, lengths = _blocks_of(rows)
    blocks = iter(coder.decode(codes, lengths, prior))
    for row in rows:
        own = [next(blocks) for _ in row["block_ids"]]
        for block, crc in zip(own, row["block_crc32"], strict=True):
            if _crc(block) != crc:
                raise ValueError(f"checksum mismatch in shard {row['shard']}, segment {row['segment']}")
        yield row, np.concatenate(own)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    held: list[dict] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and (size + row["n_ids"] > 2 * GROUP_IDS or row["prior_ids"] != held[0]["prior_ids"]
                         or row["prior_freqs"] != held[0]["prior_freqs"]):
                yield from _documents(held)
                held, size = [], 0
            held.append(row)
            size += row["n_ids"]
    if held:
        yield from _documents(held)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, ids array<long> of every document of a token file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _read_rows(batches):
            parts = np.split(ids, np.cumsum(row["doc_tokens"])[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))],
                ["doc_id", "ids"])

    return files.mapInArrow(run, "doc_id long, ids array<long>")


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the decoded ids of a token file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _read_rows(batches):
            n = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(n)
            crc = [_crc(ids[b - k:b]) for b, k in zip(ends, n, strict=True)]
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * rows, pa.int32()), pa.array([row["segment"]] * rows, pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    sizes = files.select("shard", "segment", "n_ids")
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: as many as the writer had partitions
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = shards.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("shard_start"))
    starts = (sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("row_start"))
              .join(shard_start, "shard"))
    digests = files.mapInArrow(run, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return digests.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("shard_start") + F.col("row_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op2: writes the token file, reads it back: doc_id, start, n_tokens, ids_crc32."""
    files = Workspace(spark, "tokens").put(encoded(docs), "files")
    return token_digests(files)
