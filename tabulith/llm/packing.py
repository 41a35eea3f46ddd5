"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import documents, picked, use_worker
from tabulith.llm.tokenizing import encoder, slices

#: Windows of a block, the longest piece of a document, and the share of a block's room that is dealt out.
BLOCK_WINDOWS, LONGEST_PIECE, DEALT = 128, 1024, 0.9985
#: Shorter pieces that follow each other are dealt out together until they have so many tokens; pieces from which a block ends early.
BUNDLE, BLOCK_PIECES = 64, 65_536
#: Words whose ids a worker remembers.
MEMO_ENTRIES = 450_000


def differencing(lengths: list[int], windows: int) -> list[int]:
    """The window of each length, so that the windows' sums are nearly equal.

    Every length starts as a partial partition with one filled window. The two partial
    partitions with the largest spread are merged, the fullest window of one with the
    emptiest of the other, until one partition is left.
    """
    if windows == 1 or not lengths:
        return [0] * len(lengths)
    n = len(lengths)
    left, right = np.full(2 * n * windows, -1, np.int32), np.full(2 * n * windows, -1, np.int32)
    nodes = n  # the first n nodes are the lengths; a later one joins two others
    heap = []
    for i, length in enumerate(lengths):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1, np.int32)
        sums[0], held[0] = length, i
        heap.append((-length, i, sums, held))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, other, other_held = heapq.heappop(heap)
        sums, other_held = sums + other[::-1], other_held[::-1]
        both = np.flatnonzero((held >= 0) & (other_held >= 0))
        merged = np.where(held >= 0, held, other_held)
        if len(both):
            made = np.arange(nodes, nodes + len(both), dtype=np.int32)
            left[made], right[made], merged[both] = held[both], other_held[both], made
            nodes += len(both)
        by = np.argsort(-sums, kind="stable")
        sums, merged = sums[by], merged[by]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, merged))
        order += 1
    found = [0] * n
    for window, root in enumerate(heap[0][3].tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                found[node] = window
            else:
                stack += [int(left[node]), int(right[node])]
    return found


def pack(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    """The window of each length and the number of windows; it rises while one is over capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, windows)
        most = int(np.bincount(found, weights=lengths, minlength=1).max()) if lengths else 0
        if most <= capacity:
            return found, windows
        windows = max(windows + 1, int(windows * (1 + 0.25 * (most - capacity) / capacity)))


class Packer:
    """Takes documents one by one, gives out pieces with their windows block by block.

    A piece: (document, start, length, sequence, offset). Full windows of a long document
    stand alone; its rest, cut into pieces, shares windows with others. A block ends after
    BLOCK_WINDOWS windows, or from BLOCK_PIECES pieces on with the window that is begun, and
    short pieces are dealt out in bundles, so what a block holds is bounded.
    """

    def __init__(self, first_sequence: int, capacity: int):
        self.next, self.capacity = first_sequence, capacity
        self.piece = min(LONGEST_PIECE, max(1, capacity // 4))
        self.bundle = min(BUNDLE, self.piece)
        self.waiting: list[tuple[int, int, int]] = []
        self.total = 0
        self.room = self._room(BLOCK_WINDOWS)

    def _room(self, windows: int) -> int:
        """Tokens that are dealt out to so many windows."""
        return max(1, int(windows * self.capacity * DEALT))

    def add(self, document: int, tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
        at = 0
        while tokens - at >= self.capacity:
            yield document, at, self.capacity, self.next, 0
            self.next += 1
            at += self.capacity
        while at < tokens:
            n = min(self.piece, tokens - at, self.room - self.total)
            self.waiting.append((document, at, n))
            self.total += n
            at += n
            if len(self.waiting) == BLOCK_PIECES:
                begun = next(w for w in range(1, BLOCK_WINDOWS + 1) if self._room(w) >= self.total)
                self.room = self._room(begun)
            if self.total == self.room:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, int, int, int]]:
        if not self.waiting:
            return
        lengths, of = [], []  # of bundles, and the bundle of each piece
        open_ = -1
        for _, _, n in self.waiting:
            if n >= self.bundle or open_ < 0 or lengths[open_] >= self.bundle:
                lengths.append(0)
                if n < self.bundle:
                    open_ = len(lengths) - 1
            here = len(lengths) - 1 if n >= self.bundle else open_
            lengths[here] += n
            of.append(here)
        found, windows = pack(lengths, self.capacity)
        used = [0] * windows
        for (document, at, n), bundle in zip(self.waiting, of, strict=True):
            window = found[bundle]
            yield document, at, n, self.next + window, used[window]
            used[window] += n
        self.next += windows
        self.waiting, self.total, self.room = [], 0, self._room(BLOCK_WINDOWS)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most capacity tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32,
    doc_tokens (with end_id), sequence_id, offset in the sequence; with_ids adds the ids.
    A null text counts as empty and still gives end_id; rows with one doc_id are documents
    of their own; null doc_ids stay null; no rows give no pieces; other columns are left
    out. Each input partition packs its own rows in blocks, without a shuffle; a sequence
    number holds the partition's number in its upper half, so a task that runs again
    gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("packing")
        enc = encoder(tokenizer, keeps_blanks=False, memo_entries=MEMO_ENTRIES)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        held: dict[int, tuple] = {}  # documents with pieces that wait for a window
        number = 0

        def rows(pieces: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            parts = [held[d][1][4 * at : 4 * (at + n)] for d, at, n, _, _ in pieces]
            columns = [
                pa.array([held[p[0]][0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array(map(zlib.crc32, parts), pa.int64()),
                pa.array([len(held[p[0]][1]) // 4 for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([p[2] for p in pieces])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

        for batch in batches:
            doc_ids, row = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1), 4 << 20):
                out = []
                ids, ends = enc.encode(texts, end_id)
                raw, begin = ids.tobytes(), 0
                for doc_id, end in zip(doc_ids[row : row + len(texts)], (ends * 4).tolist(), strict=True):
                    held[number] = (doc_id, raw[begin:end])
                    out += packer.add(number, (end - begin) // 4)
                    number += 1
                    begin = end
                row += len(texts)
                if out:
                    yield rows(out)
                    waits = {d for d, _, _ in packer.waiting}
                    held = {d: x for d, x in held.items() if d in waits}
        if last := list(packer.flush()):
            yield rows(last)

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed() of all documents, 4096 tokens a sequence."""
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """packed() of docs; nulls, repeats, no rows and other columns are as described there."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))
