"""Token counts from flat, unindexed token files: a vectorised search for end-of-document ids, stitched by a prefix scan.

A token file is a run of little-endian ids cut into blocks without regard to documents. Each block is searched on its own;
what a document has in front of a block comes from a prefix scan over per-block sums (ids so far, separators so far, last
separator), taken in two levels so that no task holds all blocks of a long file.

Defined cases: an empty or null text is a document of 0 ids; ids behind a file's last separator form one document marked
``ended = false``; an empty file has no documents; a block may hold no separator, or one document many blocks; very long texts
are whole, and very long runs of white space in them are given to the tokenizer as the pieces that it would cut them to, since
its pattern can't hold them; repeated rows and null ids are documents of their own; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import tokens
from .common import Scratch, slices, text_buffer, trim

BLOCK_BYTES = 1 << 20
#: Blocks that one first-level scan covers.
SPAN = 4096


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token files of all documents: rows (file, block, data) and, apart, which documents a file holds (first, doc_ids).

    One file per input partition; a text's ids come whole, followed by ``end_id``.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.byte_encoder(tokenizer)
        file, block, count, rest = TaskContext.get().partitionId(), 0, 0, bytearray()
        end = np.array([end_id], dtype).tobytes()
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(id_type))])

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal block, rest
            while len(rest) >= least and rest:
                yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "data": bytes(rest[:block_bytes])}], schema)
                del rest[:block_bytes]
                block += 1

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = memoryview(data)
            for a, b in slices(offsets):
                for i in range(a, b):
                    rest += np.array(tokens.whole_ids(encoder, str(raw[offsets[i] : offsets[i + 1]], "utf-8")), dtype).tobytes() + end
                yield from cut(block_bytes)
            for at in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(at, 1000)
                yield pa.RecordBatch.from_pylist([{"file": file, "first": count, "doc_ids": ids.to_pylist()}], schema)
                count += len(ids)
        yield from cut(1)
        trim()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return docs.select("doc_id", "text").mapInArrow(run, f"file long, block long, data binary, first long, doc_ids array<{kind.simpleString()}>")


def search_blocks(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Per block: its ids, its separators, the ids behind the last one, and the lengths of documents that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, last, lengths = [], [], []
            data, offsets = text_buffer(batch.column(2))
            raw = memoryview(data)
            for i in range(batch.num_rows):
                ids = np.frombuffer(raw[offsets[i] : offsets[i + 1]], dtype)
                at = np.flatnonzero(ids == end_id)
                n.append(len(ids)), last.append(int(at[-1]) if len(at) else -1)
                lengths.append(np.diff(at, prepend=-1) - 1)
            counts = np.array([len(x) for x in lengths])
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate([*lengths, np.zeros(0)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(counts, pa.int64()), pa.array(last, pa.int64()), flat], names=["file", "block", "n", "ends", "last", "lengths"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, n long, ends long, last long, lengths array<long>")


def stitched(found: DataFrame) -> DataFrame:
    """Adds, per block, ``start`` (ids before it), ``ordinal`` (documents ended before it) and ``carry`` (ids of its first document before it)."""
    found = found.withColumn("span", F.floor(F.col("block") / SPAN))
    in_span = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    near = found.withColumn("s", zero(F.sum("n").over(in_span))).withColumn("o", zero(F.sum("ends").over(in_span)))
    near = near.withColumn("e", F.when(F.col("last") >= 0, F.col("s") + F.col("last") + 1)).withColumn("p", F.max("e").over(in_span))
    tops = near.groupBy("file", "span").agg(F.sum("n").alias("tn"), F.sum("ends").alias("te"), F.max("e").alias("tl"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("ts", zero(F.sum("tn").over(before))).withColumn("to", zero(F.sum("te").over(before)))
    tops = tops.withColumn("tp", zero(F.max(F.col("ts") + F.col("tl")).over(before))).select("file", "span", "ts", "to", "tp")
    out = near.join(tops, ["file", "span"]).withColumn("start", F.col("ts") + F.col("s")).withColumn("ordinal", F.col("to") + F.col("o"))
    return out.withColumn("carry", F.col("start") - F.coalesce(F.col("ts") + F.col("p"), F.col("tp"))).select("file", "block", "n", "ends", "last", "lengths", "start", "ordinal", "carry")


def document_lengths(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, n_tokens, ended: the documents of token files (file, block, data), in order, without their end ids."""
    s = stitched(search_blocks(blocks, end_id, dtype))
    tail = Window.partitionBy("file").orderBy(F.col("block").desc())
    each = s.select("file", "ordinal", "carry", F.posexplode("lengths").alias("k", "x"))
    ended = each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), (F.col("x") + F.when(F.col("k") == 0, F.col("carry")).otherwise(F.lit(0))).alias("n_tokens"), F.lit(True).alias("ended"))
    final = s.groupBy("file").agg(F.max_by(F.struct("n", "ends", "last", "ordinal", "carry"), "block").alias("z")).select("file", "z.*")
    rest = F.when(F.col("last") >= 0, F.col("n") - F.col("last") - 1).otherwise(F.col("n") + F.col("carry"))
    open_ = final.select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended")).where(F.col("n_tokens") > 0)
    return ended.unionByName(open_)


def count_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 50256) -> DataFrame:
    """doc_id, n_tokens, file, ordinal of every document, counted by scanning the token files that are written first."""
    scratch = Scratch(docs.sparkSession, "tokens")
    stored = scratch.keep(write_token_files(docs, tokenizer or tokens.tokenizer_path("byte_bpe_50k.tiktoken"), end_id))
    counts = document_lengths(stored.where(F.col("data").isNotNull()), end_id)
    ids = stored.where(F.col("doc_ids").isNotNull()).select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
