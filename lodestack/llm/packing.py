"""Filling containers of fixed capacity: variable-capacity best-fit.

Items are dealt evenly to blocks, whatever their keys, and each block is packed by itself, all jobs at once, so that only (key,
size) travels and no task holds many more than BLOCK_ROWS items; a block costs at most about one badly filled bin per job.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.small import control_rows

BLOCK_ROWS = 10_000
#: Tasks that pack blocks at most; beyond that a task has several blocks, one after the other.
MOST_TASKS = 20_000
#: The permitted sequence lengths as shares of a job's capacity.
LENGTHS = tuple(k / 8 for k in range(1, 9))
_OUT = "job_id int, doc_id long, piece int, piece_start long, piece_tokens long, bin_id long, bin_start long, bin_tokens long"


def best_fit(sizes: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and place in the bin of each item, and each bin's length. lengths: permitted, ascending; no item exceeds the last.

    Items come largest first. Each goes where the least room remains after it. If it fits nowhere, a bin is opened of the length
    that will lose least: the room beside the item that the largest waiting item fitting there leaves; the longer one on ties. At
    the end each bin shrinks to the least length that holds its contents.
    """
    order = np.argsort(-sizes, kind="stable")
    waiting = (-sizes[order]).tolist()  # ascending negatives; those behind i still wait
    where, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    filled: list[int] = []
    opened: list[int] = []
    for i, item in enumerate(order.tolist()):
        size = -waiting[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for length in lengths:
                if length >= size:
                    gap = length - size
                    j = max(i + 1, bisect_left(waiting, -gap))
                    lost = gap + waiting[j] if j < len(waiting) else gap
                    if best is None or (lost, -length) < best:
                        best = (lost, -length)
            left, b = -best[1], len(opened)
            opened.append(left)
            filled.append(0)
        where[item], start[item] = b, filled[b]
        filled[b] += size
        if left > size:
            insort(room, (left - size, b))
    return where, start, [lengths[bisect_left(lengths, f)] for f in filled]


def _pack(tab: pa.Table, jobs: list[tuple[int, int]]) -> pa.Table:
    block = tab.column("block")[0].as_py()
    order = np.lexsort((tab.column("size").to_numpy(), tab.column("doc_id").fill_null(-(1 << 62)).to_numpy()))
    doc, size = tab.column("doc_id").take(pa.array(order)), tab.column("size").to_numpy()[order]
    parts = []
    for job, capacity in jobs:
        lengths = sorted({max(1, int(capacity * x)) for x in LENGTHS})
        n = np.maximum(1, -(-size // capacity))
        item = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        tokens = np.minimum(capacity, size[item] - piece * capacity)
        where, start, length = best_fit(tokens, lengths)
        parts.append(pa.table([
            pa.array(np.full(len(item), job, np.int32)), doc.combine_chunks().take(pa.array(item)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(tokens),
            pa.array((block << 32) + where), pa.array(start), pa.array(np.array(length, np.int64)[where] if len(where) else where),
        ], ["job_id", "doc_id", "piece", "piece_start", "piece_tokens", "bin_id", "bin_start", "bin_tokens"]))
    return pa.concat_tables(parts)


def pack(documents: DataFrame, jobs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where each piece of each document lies: job_id, doc_id, piece, piece_start, piece_tokens, bin_id, bin_start, bin_tokens.

    Tokens are the UTF-8 bytes of text. A document larger than the capacity, and only such, is cut into pieces of the
    capacity and a rest; the others have the one piece 0. NULL texts are left out; an empty text takes a place of 0 tokens; a
    row that occurs twice is two items; jobs without a capacity above 0 have no rows. No documents or no jobs: no rows. Items of one
    size lie in the order of doc_id, NULL first.
    """
    todo = sorted((r.job_id, r.capacity_tokens) for r in control_rows(jobs.select("job_id", "capacity_tokens")) if r.job_id is not None and (r.capacity_tokens or 0) > 0)
    items = documents.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").cast("long").alias("size"))
    if not todo:
        return items.sparkSession.createDataFrame([], _OUT)
    blocks = max(1, -(-items.count() // block_rows))
    # The row's place in the files tells repeated and NULL keys apart.
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)))
    # By number, so that blocks aren't put together in one task because few bytes travel.
    return dealt.repartition(min(blocks, MOST_TASKS), "block").groupBy("block").applyInArrow(lambda tab: _pack(tab, todo), _OUT)


def split_documents(packed: DataFrame) -> DataFrame:
    """job_id and doc_id of the documents of which pieces were put into more than one bin.

    A row that occurs twice lies in two bins without being cut; only documents with a second piece count.
    """
    by = packed.groupBy("job_id", "doc_id").agg(F.min("bin_id").alias("lo"), F.max("bin_id").alias("hi"), F.max("piece").alias("piece"))
    return by.where((F.col("lo") < F.col("hi")) & (F.col("piece") > 0)).select("job_id", "doc_id")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per job: bins, their tokens, the tokens filled, and the share unused."""
    bins = packed.groupBy("job_id", "bin_id").agg(F.max("bin_tokens").alias("bin_tokens"), F.sum("piece_tokens").alias("filled"))
    out = bins.groupBy("job_id").agg(F.count("*").alias("bins"), F.sum("bin_tokens").alias("bin_tokens"), F.sum("filled").alias("filled_tokens"))
    return out.withColumn("unused_share", F.round(1 - F.try_divide("filled_tokens", "bin_tokens"), 6))
