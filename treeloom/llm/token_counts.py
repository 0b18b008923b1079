"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of token ids of fixed width without an index; each document ends with the end-of-document id.
Files are read in blocks of fixed size that know nothing of documents. One vectorised search finds the separators of a
block, and a prefix scan over the blocks of a file (windows over one small row per block) says how many documents end
before a block and how many tokens of an open document reach into it.

Cases: an empty document counts 0; a document longer than a block is stitched over all its blocks; tokens after the last
separator are a document that has not ended (`ended` is false); an empty file or table gives no rows; null texts count as
empty; repeated rows are documents of their own; further columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import lean, saved, shared_dir, utf8

#: <|endoftext|> of the vocabulary word_bpe_49k.
END_OF_DOCUMENT = 49407
BLOCK_TOKENS = 1 << 18
#: Blocks that a task reads, one after the other, about.
TASK_BLOCKS = 64

FLAT = "kind int, file long, at long, path string, docs array<long>"


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the place in it; it must be one that pyarrow opens by its address (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def flatten(docs: DataFrame, folder: str, path: str | None = None, end: int = END_OF_DOCUMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to flat token files of uint16 below folder (which all tasks must reach), one per partition, and tells of them:
    rows of kind 0 are the files (at: the length in bytes), rows of kind 1 list the documents that were written (at: the first
    one's place in the file). Each attempt of a task writes a file of its own, so a lost one leaves no more than a file that no
    row names; save the rows, since to read them again is to write again. Special tokens in a text are plain text."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = bpe.coder(path), TaskContext.get()
        schema = pa.schema([("kind", pa.int32()), ("file", pa.int64()), ("at", pa.int64()), ("path", pa.string()), ("docs", pa.list_(pa.int64()))])
        stop = np.array([end], np.uint16).tobytes()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        out, place, length = None, 0, 0

        def row(kind: int, at: int, ids: list[int] | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([task.partitionId()], pa.int64()), pa.array([at], pa.int64()), pa.array([name]), pa.array([ids], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in bpe.sub_batches(batch.column(1)):
                if out is None:
                    store, inner = _opened(name)
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(inner)
                coded = b"".join(np.frombuffer(c, np.int32).astype(np.uint16).tobytes() + stop for c in own.encode_texts(texts, False))
                out.write(coded)
                length += len(coded)
                yield row(1, place, ids[at : at + len(texts)])
                at, place = at + len(texts), place + len(texts)
        if out is not None:
            out.close()
            yield row(0, length, None)
        own.memo.clear()

    return docs.select(F.col(key).cast("long"), utf8(text)).mapInArrow(lean(run), FLAT)


def blocks_of(files: DataFrame, dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files (file, path, length in bytes) of any length -> blocks (file, at, tokens). The byte ranges of all blocks are dealt out, and
    each task reads its ranges."""
    size = np.dtype(dtype).itemsize * block_tokens
    kind = dict(files.dtypes)["file"]
    ranges = files.where("length > 0").select("file", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("at"))
    # The rows are few and small whatever they stand for: their number of tasks comes from the bytes to read.
    tasks = 1 + int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // (TASK_BLOCKS * size)
    dealt = ranges.repartition(tasks, F.col("path"), F.col("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (name, length, at) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                store, inner = _opened(name)
                with store.open_input_file(inner) as f:
                    raw = f.read_at(min(size, length - at * size), at * size)
                if len(raw) != min(size, length - at * size):
                    raise OSError(f"{name} ends before its listed length")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([at], pa.int64()), pa.array([raw], pa.binary())], names=["file", "at", "tokens"])

    return dealt.mapInArrow(run, f"file {kind}, at long, tokens binary")


def blocks_of_files(spark: SparkSession, path: str, dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of all raw flat files that Spark lists below path; file is the file's path."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "path", "length")
    return blocks_of(listed, dtype, block_tokens)


def scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "uint16") -> DataFrame:
    """file, place (of the document in its file, from 0), n_tokens (without the separator) and ended."""
    kind = dict(blocks.dtypes)["file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                stops = np.flatnonzero(ids == end)
                n = len(stops)
                for column, value in zip(out, (len(ids), n, int(stops[0]) if n else len(ids), int(stops[-1]) + 1 if n else -1, np.diff(stops) - 1 if n else [])):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["file", "at", "n", "stops", "head", "last", "inner"])

    found = saved(blocks.select("file", "at", "tokens").mapInArrow(run, f"file {kind}, at long, n long, stops long, head long, last long, inner array<long>"), "found")
    # The windows see one narrow row per block; the lengths of whole documents within a block join their block again.
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.drop("inner").withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "place": F.coalesce(F.sum("stops").over(before), F.lit(0)), "next": F.lead("at").over(order)})
    placed = placed.withColumn("stop_at", F.when(F.col("stops") > 0, F.col("start") + F.col("last")))
    carried = placed.withColumn("open", F.col("start") - F.coalesce(F.max("stop_at").over(before), F.lit(0)))
    left = F.when(F.col("stops") > 0, F.col("n") - F.col("last")).otherwise(F.col("open") + F.col("n"))
    met = carried.where("stops > 0").select("file", "at", "place", (F.col("open") + F.col("head")).alias("first")).join(found.select("file", "at", "inner"), ["file", "at"])
    ended = F.concat(F.array("first"), F.col("inner"))
    whole = met.select("file", "place", F.posexplode(ended).alias("i", "n_tokens")).select("file", (F.col("place") + F.col("i")).alias("place"), "n_tokens", F.lit(True).alias("ended"))
    rest = carried.where(F.col("next").isNull() & (left > 0)).select("file", (F.col("place") + F.col("stops")).alias("place"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def token_counts(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each document: its flat files are written to the shared folder, then read in blocks and scanned."""
    folder = f"{shared_dir(docs.sparkSession)}/treeloom-{uuid.uuid4().hex}/tokens"
    flat = saved(flatten(docs, folder, path), "flat")
    files = flat.where("kind = 0").select("file", "path", F.col("at").alias("length"))
    counted = saved(scan(blocks_of(files, block_tokens=block_tokens)), "counted")
    listed = flat.where("kind = 1").select("file", "at", F.posexplode("docs").alias("i", "doc_id")).select("file", (F.col("at") + F.col("i")).alias("place"), "doc_id")
    lost = F.raise_error(F.lit("a document's separator is missing")).cast("long")
    return listed.join(counted, ["file", "place"], "left").select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens"))
