"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut). The plan is best-fit decreasing over
counts: for each length, longest first, whole groups of sequences with the tightest sufficient room take as many pieces as
fit, so that its cost depends on the number of lengths (at most ``capacity``), never on the number of documents. Each piece
then takes the planned slot of its rank within its length. Ranks come from per-partition counts and their running sums, so
that no length, however common, is gathered in one task.

Null text is empty and still a piece (its end token). A null doc_id is a row like any other, repeated rows are packed as
often as they occur, an empty table gives no pieces, and columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.llm.common import cut, spread, table
from pipegrid.llm.tokens import by_block, joined


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Slots by length. A row (first rank, first sequence, pieces per sequence, offset) holds from its rank to the next row's."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences: first, count
    rooms: list[int] = []  # the keys of room with runs, sorted
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used = 0

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rest, rank = histogram[length], 0
        rows = slots[length] = []
        while rest:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, count = room[left].pop()
                if not room[left]:
                    rooms.pop(k)
            else:
                left, first = capacity, used
                count = -(-rest // (capacity // length))
                used += count
            each = left // length
            full = min(count, rest // each)
            part = rest - full * each if full < count else 0
            rows.append((rank, first, each, capacity - left))
            put(left - each * length, first, full)
            if part:
                put(left - part * length, first + full, 1)
            put(left, first + full + bool(part), count - full - bool(part))
            rank += full * each + part
            rest -= full * each + part
    return {length: np.array(rows, dtype=np.int64).reshape(-1, 4) for length, rows in slots.items()}


def _pieces(capacity: int, end: int):
    """A block's documents as pieces, their ids gathered from the ids of the block's words."""

    def run(t: pa.Table) -> pa.Table:
        docs, per, which, counts, flat = joined(t)
        first, ends = np.cumsum(counts) - counts, np.cumsum(per)
        last = np.array([end], "<u4").tobytes()
        doc, piece, start, length, body = [], [], [], [], []
        for i, a, b in zip(docs["ids"], (ends - per).tolist(), ends.tolist(), strict=True):
            some = which[a:b]
            ids = flat[spread(first[some], counts[some])].astype("<u4").tobytes() + last
            for p, a in enumerate(range(0, len(ids) // 4, capacity)):
                part = ids[4 * a : 4 * (a + capacity)]
                doc.append(i), piece.append(p), start.append(a), length.append(len(part) // 4), body.append(part)
        return pa.table([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(body, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece; each document ends with end.

    Every distinct word is encoded once for the whole corpus; blocks of documents get their words' ids by block.
    """
    return by_block(docs, vocabulary, True).applyInArrow(_pieces(capacity, end), "doc_id long, piece int, start long, length long, ids binary")


def _place(slots):
    def run(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(x)) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own, rows = np.flatnonzero(length == x), slots.value[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (any columns, among them length, 1 to capacity) with rank within length, sequence_id and offset."""
    kept = cut(pieces.withColumn("part", F.spark_partition_id()))
    kept = kept.withColumn("within", F.row_number().over(Window.partitionBy("part", "length").orderBy(F.lit(0))) - 1)
    counts = kept.groupBy("length", "part").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    if any(x < 1 or x > capacity for x in histogram):
        raise ValueError(f"a length lies outside 1 to {capacity}")
    slots = pieces.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    ranked = kept.join(bases, ["length", "part"]).withColumn("rank", F.col("within") + F.col("base")).select(*pieces.columns, "rank")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in ranked.dtypes)
    return ranked.mapInArrow(_place(slots), f"{schema}, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
