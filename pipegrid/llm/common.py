"""What the training-data operators share: reading, checkpoints, packed columns and text columns."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, besides a single longer text.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text alone, a null text as empty; other columns, whatever their names, do not come along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; a temporary one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder: for loops, whose plans and size estimates then start afresh."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewrite(docs: DataFrame, run, limit: int = BLOCK_BYTES) -> DataFrame:
    """docs with the same columns, each block of rows (of limit bytes of text) through run (an Arrow table to one with the same columns)."""
    names = docs.columns

    def each(batches):
        for t in blocks(batches, limit):
            for batch in run(t).select(names).combine_chunks().to_batches():
                yield batch

    plain = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return plain.mapInArrow(each, docs.schema)


def with_text(t: pa.Table, texts_: list[str]) -> pa.Table:
    """The table t with other texts, and n_chars to match where it has that column."""
    t = t.set_column(t.schema.get_field_index("text"), t.schema.field("text"), pa.array(texts_, t.schema.field("text").type))
    k = t.schema.get_field_index("n_chars")
    return t if k < 0 else t.set_column(k, t.schema.field("n_chars"), pa.array([len(x) for x in texts_], t.schema.field("n_chars").type))


def buckets(df: DataFrame) -> int:
    """How many groups packed rows are dealt to: as many as the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of Arrow batches in blocks whose text column holds about limit bytes (a longer text is a block)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        size = t.column("text").combine_chunks()
        size = size.chunk(0) if isinstance(size, pa.ChunkedArray) else size
        lens = np.asarray(pc.binary_length(size))
        group = (np.cumsum(lens, dtype=np.int64) - lens) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), t.num_rows]
        for a, b in itertools.pairwise(edges):
            yield t.slice(a, b - a)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one after the other, and the n + 1 offsets."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def packed(values, kind) -> pa.Array:
    return pa.array(values, type=kind)
