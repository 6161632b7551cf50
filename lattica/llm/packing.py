"""Operator 6: hierarchical packing of documents into context windows of several lengths.

The tiers are powers of two up to the longest window. Each task packs the documents it reads:

* A document longer than the longest window gives whole windows of its own; what is left of it, or a shorter document,
  goes to the tier with the shortest window that holds it.
* A pool of such rests is packed from the longest tier to the shortest. Each window starts from the longest rest of
  its tier; its gap is filled from shorter rests, the longest that fits first, and in the end by cutting one, so that
  windows are full. What no window of its own tier needs moves on to shorter tiers.
* The last rests of a task are cut to powers of two, so nothing is padded. That gives a task a few windows shorter than
  the shortest tier, at least one token long: of each power of two one at most.

Windows of a tier form step groups of equal token counts. What a task's tiers have left over at its end fills groups
across tiers, so of a task one group at most has fewer tokens. Nothing is shuffled: documents stay in their tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lattica.llm.common import sliced, texts_of, tidy
from lattica.llm.token_fst import transducer

ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
Piece = tuple  # doc_id, start, ids, tokens of the document


class Packer:
    """Packs the documents of one task. add() and close() give rows (doc_id, start, length, crc, tokens, sequence, offset, tier, group)."""

    def __init__(self, task: int, longest: int = 2048, shortest: int = 256, pool_tokens: int = 2_000_000, step_tokens: int = 65_536):
        self.tiers = [longest >> k for k in range((longest // shortest).bit_length())]
        self.longest, self.pool_tokens, self.step_tokens = longest, pool_tokens, step_tokens
        self.pool: list[Piece] = []
        self.pooled = 0
        self.base, self.made = task << 36, 0
        self.waiting: dict[int, list[list[tuple]]] = {}
        self.groups = 0

    def _window(self, pieces: list[Piece]) -> Iterator[tuple]:
        length = sum(len(p[2]) for p in pieces)
        tier = 1 << max(length - 1, 0).bit_length()
        sequence, at = self.base | self.made, 0
        self.made += 1
        rows = []
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, tier))
            at += len(ids)
        waiting = self.waiting.setdefault(tier, [])
        waiting.append(rows)
        if len(waiting) * tier >= self.step_tokens:
            yield from self._group(waiting)
            waiting.clear()

    def _group(self, windows: list[list[tuple]]) -> Iterator[tuple]:
        """The rows of these windows as one step group."""
        group = self.base | self.groups
        self.groups += 1
        for rows in windows:
            for row in rows:
                yield *row, group

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Take a document's ids (little-endian unsigned 32 bit)."""
        total, at = len(ids), 0
        while total - at >= self.longest:
            yield from self._window([(doc, at, ids[at : at + self.longest], total)])
            at += self.longest
        if at < total:
            self.pool.append((doc, at, ids[at:].copy(), total))  # not a view that keeps the whole text's ids
            self.pooled += total - at
        if self.pooled > self.pool_tokens:
            yield from self._pack(last=False)

    def close(self) -> Iterator[tuple]:
        yield from self._pack(last=True)
        # Powers of two from the longest on fill groups exactly; only the last one may hold fewer tokens.
        windows, tokens = [], 0
        for tier in sorted(self.waiting, reverse=True):
            for rows in self.waiting[tier]:
                windows.append(rows)
                tokens += tier
                if tokens >= self.step_tokens:
                    yield from self._group(windows)
                    windows, tokens = [], 0
        self.waiting.clear()
        if windows:
            yield from self._group(windows)

    def _pack(self, last: bool) -> Iterator[tuple]:
        self.pool.sort(key=lambda p: len(p[2]))
        pool, sizes = self.pool, [len(p[2]) for p in self.pool]
        self.pool, self.pooled = [], 0

        def take(i: int) -> Piece:
            sizes.pop(i)
            return pool.pop(i)

        for tier in self.tiers:
            while pool and (sizes[-1] > tier // 2 or tier == self.tiers[-1]):
                window = [take(-1)]
                gap = tier - len(window[0][2])
                while gap and pool:
                    i = bisect.bisect_right(sizes, gap) - 1
                    # A last gap that the best rest doesn't fill well, or that none fits, is filled by cutting the next longer one.
                    if i >= 0 and (sizes[i] == gap or gap - sizes[i] >= sizes[0] or i + 1 == len(sizes)):
                        window.append(take(i))
                        gap -= len(window[-1][2])
                        continue
                    doc, start, ids, total = take(i + 1)
                    window.append((doc, start, ids[:gap], total))
                    rest = ids[gap:]
                    at = bisect.bisect_left(sizes, len(rest))
                    sizes.insert(at, len(rest))
                    pool.insert(at, (doc, start + gap, rest, total))
                    gap = 0
                if gap and not last:  # to be filled together with later documents
                    self.pool += window
                elif gap:
                    yield from self._powers(window)
                else:
                    yield from self._window(window)
        self.pooled = sum(len(p[2]) for p in self.pool)

    def _powers(self, pieces: list[Piece]) -> Iterator[tuple]:
        """Windows of powers of two that together hold these pieces, and no padding."""
        left = sum(len(p[2]) for p in pieces)
        queue = list(pieces)
        while left:
            size, window = 1 << left.bit_length() - 1, []
            left -= size
            while size:
                doc, start, ids, total = queue.pop(0)
                window.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    queue.insert(0, (doc, start + size, ids[size:], total))
                size -= len(window[-1][2])
            yield from self._window(window)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Pieces of all documents in sequences of at most `longest` tokens; a document is its ids and then end_id.

    A null or empty text is end_id alone; a null id stays null (its pieces then can't be told from those of another
    null id); repeated rows are documents of their own; other columns are not read; an empty table gives no rows. A very
    long text fills windows of its own. Of rests of equal length any may come first.
    A task holds a pool of a few million tokens, besides the text it reads. sequence_id is unique over all tasks.
    """
    @tidy("tokens")
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), longest)
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        end = np.array([end_id], np.uint32)
        for batch in sliced(batches, "text", 1 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), machine.ids(texts_of(batch.column("text")))):
                rows += packer.add(doc, np.concatenate([ids, end]).astype("<u4"))
            if len(rows) >= 10_000:
                yield out()
                rows = []
        rows += packer.close()
        yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(pack, ROWS)
