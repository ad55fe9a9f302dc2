"""Best-fit packing by sums of squares (operator 5).

Documents are tokenized, closed with an end id, cut into pieces of at most one sequence, and the pieces that don't fill a sequence are packed.
A piece goes where the squared counts of open bins per residual gap become smallest: moving a bin from gap g to g - s changes the sum by
2 (N[g-s] - N[g]) + 2, opening one by 2 N[B-s] + 1, so a placement needs the counts alone, 4096 numbers at any input size.
Each task packs what it reads, longest pieces first; tasks read about PIECES_PER_TASK pieces, so what is lost at their ends stays a fixed share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices, staged, thin_batches
from .encoder import word_tokenizer

SEQUENCE, END_ID, PIECES_PER_TASK = 4096, 1, 100_000


def _pieces(path: str, limit: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for batch in slices(batches, 1, 1 << 22):
            ids, at = tok.encode(batch.column(1), END_ID)
            sizes = np.diff(at)
            count = -(-sizes // limit)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * limit
            length = np.minimum(limit, sizes[row] - start)
            low, raw = (at[row] + start).tolist(), memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * lo : 4 * (lo + n)]) for lo, n in zip(low, length.tolist())]
            cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length in turn, and the number of bins. Ties go to the smallest gap, and an open bin is preferred to a new one."""
    count = np.zeros(limit + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # an exact fit leaves no gap to count: its change is 1 - 2 N[s]
        change = 2 * (count[: limit - s] - count[s:limit]) + 2
        if len(change):
            change[0] -= 1
        change[count[s:limit] == 0] = np.iinfo(np.int64).max
        g = s + int(change.argmin()) if len(change) else 0
        if len(change) and change[g - s] < np.iinfo(np.int64).max and (change[g - s] <= 2 * count[limit - s] + 1 or s == limit):
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b = limit, bins
            bins += 1
        where[i], offset[i] = b, limit - g
        if g > s:
            count[g - s] += 1
            open_bins[g - s].append(b)
    return where, offset, bins


def _pack(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        length = table["length"].to_numpy()
        order = np.argsort(-length, kind="stable")
        where, offset, _ = sum_of_squares(length[order], limit)
        seq, at = np.empty_like(where), np.empty_like(offset)
        seq[order], at[order] = where + (TaskContext.get().partitionId() << 36), offset
        yield from table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(at)).to_batches(50_000)

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """documents (doc_id long, text string, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    Null and empty texts give one piece that holds the end id alone. Repeated rows are packed each. An empty table gives an empty result.
    Texts of any length are cut into pieces of `limit` ids. Other columns are ignored.
    """
    docs = thin_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = staged(docs.mapInArrow(lean("tokens", _pieces(tokenizer_path, limit)), shape), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    return pieces.coalesce(tasks).mapInArrow(_pack(limit), shape + ", sequence_id long, offset long")
