"""Operator 2: text quality by a byte-level convolutional network in numpy.

Filters over WIDTH bytes slide over the whole document. Their responses are max-pooled over overlapping chunks of two
blocks (the second block of one chunk is the first of the next), rectified, and combined: the mean and the maximum
over all chunks go into one logistic unit. A filter works on one-hot bytes, so its response is a sum of WIDTH table
rows, one for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_of, sliced, texts_of, tidy
from lattica.llm.toxicity import training_rows

WIDTH, FILTERS, BLOCK = 5, 16, 256
LOWEST = np.float32(-1e9)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole blocks; blocks of each text; which positions hold a text's bytes.

    A filter at a text's last byte sees only padding behind it, so a text's score doesn't depend on others.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks = np.where(size > 0, -(-(size + WIDTH - 1) // BLOCK), 0)
    start = (np.cumsum(blocks) - blocks) * BLOCK
    data = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    real = np.zeros(int(blocks.sum()) * BLOCK, bool)
    for a, n, t in zip(start.tolist(), size.tolist(), texts):
        data[a : a + n] = np.frombuffer(t, np.uint8)
        real[a : a + n] = True
    return data, blocks, real


def responses(data: np.ndarray, taps: np.ndarray, a: int, b: int) -> np.ndarray:
    """Filter responses at positions a to b."""
    out = np.take(taps[0], data[a:b], axis=0)
    row = np.empty_like(out)
    for k in range(1, WIDTH):
        np.take(taps[k], data[a + k : b + k], axis=0, out=row, mode="clip")
        out += row
    return out


class Net:
    """Filter tables, filter biases, and the logistic unit over means and maxima."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def block_maxima(self, data: np.ndarray, real: np.ndarray, places: bool = False, piece: int = 64 * BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """The highest response of each filter in each block, and its place there; worked out for a piece of the bytes at a time."""
        n = len(real)
        out, best = np.empty((n // BLOCK, FILTERS), np.float32), np.empty((n // BLOCK, FILTERS), np.int64)
        for a in range(0, n, piece):
            b = min(a + piece, n)
            part = responses(data, self.taps, a, b)
            if not real[a:b].all():
                part[~real[a:b]] = LOWEST
            part = part.reshape(-1, BLOCK, FILTERS)
            out[a // BLOCK : b // BLOCK] = part.max(1)
            if places:
                best[a // BLOCK : b // BLOCK] = part.argmax(1)
        return out, best

    def features(self, maxima: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Mean and maximum over each text's chunks; zeros for an empty text."""
        out = np.zeros((len(blocks), 2 * FILTERS), np.float32)
        full = np.flatnonzero(blocks)
        if len(full):
            edge = (np.cumsum(blocks) - blocks)[full]
            chunk = maxima.copy()
            inner = np.ones(len(maxima), bool)
            inner[edge + blocks[full] - 1] = False  # the last block has no next one
            at = np.flatnonzero(inner)
            chunk[at] = np.maximum(maxima[at], maxima[at + 1])
            chunk = np.maximum(chunk + self.shift, 0)
            out[full, :FILTERS] = np.add.reduceat(chunk, edge, 0) / blocks[full, None]
            out[full, FILTERS:] = np.maximum.reduceat(chunk, edge, 0)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, blocks, real = laid_out(texts)
        odds = self.features(self.block_maxima(data, real)[0], blocks) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -60, 60)))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 4) -> Net:
        """Train on whole texts by Adam; either class weighs as much as its share."""
        if len(set(y.tolist())) < 2:
            share = (float(y.sum()) + 1) / (len(y) + 2)
            self.out[:] = 0
            self.bias[:] = np.log(share / (1 - share))
            return self
        rng = np.random.default_rng(seed)
        params = [self.taps, self.shift, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                part = [i for i in order[k : k + batch] if texts[i]]
                if not part:
                    continue
                grads = self._gradients([texts[i] for i in part], y[part])
                step += 1
                now = rate * (1 - step / (total + 1))
                for p, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.005 * (g * g - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        data, blocks, real = laid_out(texts)
        maxima, best = self.block_maxima(data, real, True)
        edge = np.cumsum(blocks) - blocks
        nxt = np.arange(len(maxima)) + 1
        nxt[edge + blocks - 1] -= 1
        second = maxima[nxt] > maxima
        chunk = np.maximum(np.where(second, maxima[nxt], maxima) + self.shift, 0)
        mean = np.add.reduceat(chunk, edge, 0) / blocks[:, None]
        high = np.maximum.reduceat(chunk, edge, 0)
        feats = np.concatenate([mean, high], 1)
        error = (1 / (1 + np.exp(-np.clip(feats @ self.out + self.bias[0], -60, 60))) - y).astype(np.float32) / len(y)
        back = np.repeat(error[:, None] * self.out[:FILTERS] / blocks[:, None], blocks, 0)
        is_high = (chunk == np.repeat(high, blocks, 0)) & (chunk > 0)
        ties = np.maximum(np.add.reduceat(is_high.astype(np.float32), edge, 0), 1)
        back = (back + np.repeat(error[:, None] * self.out[FILTERS:] / ties, blocks, 0) * is_high) * (chunk > 0)
        block = np.where(second, nxt[:, None], np.arange(len(maxima))[:, None])
        filters = np.broadcast_to(np.arange(FILTERS), block.shape)
        where = block * BLOCK + best[block, filters]
        taps = np.stack([np.bincount(data[where + k].astype(np.int64).ravel() * FILTERS + filters.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
        return [taps.astype(np.float32), back.sum(0), error @ feats, np.array([error.sum()], np.float32)]


def quality(docs: DataFrame, labels: DataFrame, most_bad: int = 1000, most_good: int = 1600, most_chars: int = 12_000_000, threshold: float = 0.7) -> DataFrame:
    """Score every whole text of docs (doc_id, text); learn from labels (doc_id, quality).

    Labels whose crc32(doc_id) mod 4 is 2 are held out. The fit takes at most most_bad and most_good whole texts of
    most_chars characters in all; scoring has no bound: a very long text is read in chunks to its end. Every row gives
    one row: a null or empty text gets the score of no evidence; a null id is scored, with held_out null; repeated rows
    stay and get equal scores; a score of exactly the threshold is predicted 1; an empty table gives no rows; other
    columns are not read. With no labels, or of one class only, every text gets the smoothed share of good labels.
    """
    texts, y = training_rows(docs, labels, "quality", 4, 2, (most_bad, most_good), most_chars)
    net = Net().fit([t.encode("utf-8", "replace") for t in texts], y)

    @tidy("quality")
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            score = net.score([t.encode("utf-8", "replace") for t in texts_of(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of("doc_id") % 4 == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")
