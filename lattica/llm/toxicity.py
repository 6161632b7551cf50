"""Operator 7: toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into a fixed number of buckets, each with a vector. The
average of the subword vectors of a stretch of text goes into a linear softmax over clean and toxic. A text of up to
WINDOW words is one such bag. A longer one is read in overlapping windows, and its log odds are the average over all of
them, weighted by the softmax of the same log odds, so that a toxic passage in a long text isn't averaged away. Vectors
and softmax are fitted together, through that pooling. Misspellings share n-grams with what was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import crc_of, free_prefix, sampled, sliced, spent, texts_of, tidy, written

SHORTEST, LONGEST, BITS, DIM = 3, 6, 18, 8
BUCKETS = 1 << BITS
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Subwords in fewer texts than this have no vector.
LEAST = 6
#: Where in a gap between clean and toxic texts the cut lies: misspellings are in the gap, so nearer to the clean ones.
LOW = 0.35
#: The weight of a subword without a vector in a word's average.
UNKNOWN = 0.3
#: Words of a window; it begins at every half of that.
WINDOW = 8
#: How much the highest windows count beyond others.
SHARP = 3.0
STRIP = ".,;:!?\"'()[]{}<>|*#$%&_-–—…«»“”‘’"


def bags(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, edges marked, and of the whole word; and which word each belongs to."""
    marked = [f"<{w.strip(STRIP)}>" for w in vocabulary]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(marked)), size)
    end = np.cumsum(size)
    left = end[word] - np.arange(len(points))  # code points up to the word's end
    rolled, hashes, owners = points.copy(), [], []
    for n in range(2, LONGEST + 1):
        rolled = rolled[:-1] * PRIME if n == 2 else rolled[: len(points) - n + 1] * PRIME
        rolled = rolled[: len(points) - n + 1] + points[n - 1 :]
        if n >= SHORTEST:
            inside = left[: len(rolled)] >= n
            hashes.append(rolled[inside] + np.uint64(n))
            owners.append(word[: len(rolled)][inside])
    power = np.cumprod(np.full(int(size.max()) if len(size) else 1, PRIME, np.uint64))
    place = np.arange(len(points)) - (end - size)[word]
    hashes.append(np.add.reduceat(points * power[place], end - size) if len(size) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(marked)))
    every = np.concatenate(hashes)
    every ^= every >> np.uint64(29)
    return ((every * PRIME) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def weights(known: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a word's sum is divided by: subwords with a vector count whole, others (as in a misspelling) less."""
    return np.maximum(known + UNKNOWN * (total - known), 1)


def words(text: str) -> list[str]:
    return text.lower().split()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with these numbers of words, all in a row, where windows begin and end, and how many each text has; of no words: none."""
    half = WINDOW // 2
    count = np.where(lengths > 0, np.maximum(-(-(lengths - half) // half), 1), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    begin = (np.cumsum(lengths) - lengths)[text] + number * half
    return begin, np.minimum(begin + WINDOW, np.cumsum(lengths)[text]), count


def pooled(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's average over its windows' values, weighted by their softmax, and the weights; every text has a window."""
    edge = np.cumsum(count) - count
    share = np.exp(SHARP * (value - np.repeat(np.maximum.reduceat(value, edge), count)))
    share /= np.repeat(np.add.reduceat(share, edge), count)
    return np.add.reduceat(share * value, edge), share


def ranged(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ranges."""
    total = np.concatenate([[0.0], np.cumsum(flat, dtype=np.float64)])
    return total[end] - total[begin]


class Model:
    """Vectors of the buckets and a softmax over two classes; what texts need of both is one number for each bucket."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.05, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.array([1.0, -1.0], np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.02, decay: float = 2e-3, keep: float = 0.6, seed: int = 2) -> Model:
        """Train on whole texts, with as many of either class in each batch; a share of the words is left out at random."""
        if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of toxic labels, or a half
            share = (float(labels.sum()) + 1) / (len(labels) + 2)
            self.out[:] = 0
            self.bias = np.log(np.array([1 - share, share], np.float32))
            return self
        index: dict[str, int] = {}
        coded = [np.array([index.setdefault(w.strip(STRIP), len(index)) for w in words(t)], np.int32) for t in texts]
        in_texts = np.bincount(np.concatenate([np.unique(c) for c in coded]), minlength=len(index))
        # Words are coded in parts: what all their subwords need at once is a bucket each.
        vocabulary, part, counts = list(index), 30_000, np.zeros(BUCKETS)
        parts, totals = [], []
        for k in range(0, len(vocabulary), part):
            found, owner = bags(vocabulary[k : k + part])
            parts.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
            totals.append(np.bincount(owner, minlength=len(vocabulary[k : k + part])))
            counts += np.bincount(parts[-1], np.repeat(in_texts[k : k + part], totals[-1]), BUCKETS)
        # What hardly occurs could only be learned by heart: it has no vector. The rest is trained by itself.
        active = np.flatnonzero(counts >= LEAST)
        place = np.full(BUCKETS, -1, np.int32)
        place[active] = np.arange(len(active))
        sizes = []
        for k, n in enumerate(totals):
            found = place[parts[k]]
            sizes.append(np.bincount(np.repeat(np.arange(len(n)), n)[found >= 0], minlength=len(n)))
            parts[k] = found[found >= 0]
        none = [np.zeros(0, np.int64)]
        bucket, total, size_of = np.concatenate(parts or none), np.concatenate(totals or none), np.concatenate(sizes or none)
        del parts, vocabulary
        weight = weights(size_of, total)
        first = np.cumsum(size_of) - size_of
        vectors = self.vectors[active]
        rng = np.random.default_rng(seed)
        params = [vectors, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        sides = [np.flatnonzero(labels == c) for c in (0, 1)]
        for step in range(1, steps + 1):
            part = np.concatenate([rng.choice(s, min(batch // 2, len(s)), replace=False) for s in sides])
            some = [c[rng.random(len(c)) < keep] if len(c) > 3 else c for c in (coded[i] for i in part)]
            full = [k for k, c in enumerate(some) if len(c)]
            y = labels[part[full]]
            rows = np.concatenate([some[k] for k in full])
            begin, end, count = windows(np.array([len(some[k]) for k in full]))
            uniq, back = np.unique(rows, return_inverse=True)
            size = size_of[uniq]
            at = np.concatenate([[0], np.cumsum(size)])
            flat = bucket[np.arange(at[-1]) + np.repeat(first[uniq] - at[:-1], size)]
            diff = self.out[:, 1] - self.out[:, 0]
            total_of = ranged((vectors @ diff)[flat], at[:-1], at[1:])
            bag = ranged(weight[uniq][back], begin, end)
            value = ranged(total_of[back], begin, end) / bag
            logit, share = pooled(value, count)
            error = 1 / (1 + np.exp(-logit - self.bias[1] + self.bias[0])) - y
            error *= np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
            # What each window's error is to each of its words, which lie in one or two windows.
            given = share * np.repeat(error, count) / bag
            steps_ = np.bincount(begin, given, len(rows) + 1) - np.bincount(end, given, len(rows) + 1)
            per_word = np.bincount(back, np.cumsum(steps_)[:-1], len(uniq))
            hit = np.bincount(flat, np.repeat(per_word, size), len(active))
            toward = hit @ vectors
            grads = [np.outer(hit, diff).astype(np.float32), np.stack([-toward, toward], 1), np.array([-error.sum(), error.sum()])]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + (decay * p if p is vectors else 0))
        self.vectors[:] = 0
        self.vectors[active] = vectors
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """The softmax's log odds as a number for each bucket and a bias."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores texts; keeps the sums of short words, up to a bound of about 25 MB."""

    def __init__(self, per_bucket: np.ndarray, bias: float, most_words: int = 100_000, longest: int = 40):
        self.per_bucket, self.bias, self.most, self.longest = per_bucket, bias, most_words, longest
        self.known: dict[str, tuple[float, float]] = {}

    def sums(self, new: list[str]) -> list[tuple[float, float]]:
        """Sum and weight of each word's subwords; worked out for some 300,000 characters at a time."""
        out: list[tuple[float, float]] = []
        part: list[str] = []
        size = 0
        for k, w in enumerate(new):
            part.append(w)
            size += len(w)
            if size > 300_000 or k + 1 == len(new):
                bucket, owner = bags(part)
                z = self.per_bucket[bucket]
                weight = weights(np.bincount(owner, z != 0, len(part)), np.bincount(owner, minlength=len(part)))
                out += zip(np.bincount(owner, z, len(part)).tolist(), weight.tolist())
                part, size = [], 0
        return out

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log odds of texts; without words those of no evidence."""
        cut = [words(t) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set().union(*cut))
        found = dict(zip(new, self.sums(new)))
        self.known.update((w, x) for w, x in found.items() if len(w) <= self.longest and len(self.known) < self.most)
        out = np.full(len(texts), self.bias)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        full = np.flatnonzero(lengths)
        if len(full):
            pairs = np.array([found[w] if w in found else self.known[w] for c in cut for w in c])
            begin, end, count = windows(lengths[full])
            out[full] += pooled(ranged(pairs[:, 0], begin, end) / ranged(pairs[:, 1], begin, end), count)[0]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(texts), -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: tuple[int, int], most_chars: int) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels for training: at most so many rows of label 0 and of label 1, never of the held-out fold.

    An id with several texts gives one of them, the one with the least hash. The texts are taken by a hash of the id, as
    long as they have most_chars characters in all; one that would go beyond is passed over, long or short. The driver
    gets no more than that.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of("doc_id") % folds != fold))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = F.broadcast(sampled(rows, ["doc_id"], "y", most))  # of a bounded number of rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(picked, "doc_id")
    found = written(found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    taken, left = [], most_chars
    for i, n in found.select("doc_id", F.length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if n <= left:
            taken.append(i)
            left -= n
    got = found.where(F.col("doc_id").isin(taken)).toArrow().sort_by("doc_id")
    spent(found)
    return got["text"].to_pylist(), np.array(got["y"].to_pylist(), np.int64)


def fitted(texts: list[str], y: np.ndarray, share: int = 6) -> tuple[np.ndarray, float]:
    """Fit on all but one in `share` rows; with the others shift the bias to where errors are fewest; a clean text called toxic counts twice."""
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 2 * share:
        return Model().fit(texts, y).folded()
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        kept[np.flatnonzero(y == c)[::share]] = True
    per_bucket, bias = Model().fit([t for t, k in zip(texts, kept) if not k], y[~kept]).folded()
    scorer, own = Scorer(per_bucket, bias), [t for t, k in zip(texts, kept) if k]
    odds = np.concatenate([scorer.odds(own[k : k + 100]) for k in range(0, len(own), 100)])
    order = np.argsort(odds)
    odds, toxic = odds[order], y[kept][order]
    cuts = np.concatenate([[odds[0] - 1], odds[:-1] + LOW * np.diff(odds), [odds[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - toxic)]) / (1 - toxic).sum()
    cost = missed + 2 * wrong
    return per_bucket, bias - float(cuts[np.flatnonzero(cost <= cost.min() + 1e-9)].mean())


def toxicity(docs: DataFrame, labels: DataFrame, most_clean: int = 4000, most_toxic: int = 2000, most_chars: int = 24_000_000, threshold: float = 0.5, training: DataFrame | None = None, keep_columns: bool = False) -> DataFrame:
    """Score every whole text of docs (doc_id, text); learn from labels (doc_id, toxic) and the texts in training (else docs).

    Labels whose crc32(doc_id) mod 5 is 0 are held out. The fit takes at most most_clean and most_toxic whole texts of
    most_chars characters in all; scoring has no bound: a very long text is read in windows to its end. Every row gives
    one row: a null or empty text gets the score of no evidence; a null id is scored, with held_out null; repeated rows
    stay and get equal scores; a score of exactly the threshold is toxic; an empty table gives no rows. Other columns
    aren't read; keep_columns: all columns of docs stay, with tox_score and tox_predicted as the last ones. With no
    labels, or of one class only, every text gets the smoothed share of toxic labels.
    """
    texts, y = training_rows(docs if training is None else training, labels, "toxic", 5, 0, (most_clean, most_toxic), most_chars)
    per_bucket, bias = fitted(texts, y)
    if keep_columns:
        p = free_prefix(docs.columns, "tox_")
        rows, text, first, last = docs, "text", [], (f"{p}score", f"{p}predicted")
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of("doc_id") % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
        text, first, last = "text", ["doc_id", "held_out"], ("score", "predicted")
    first = first or rows.columns
    schema = T.StructType([*(rows.schema[c] for c in first), T.StructField(last[0], T.DoubleType()), T.StructField(last[1], T.IntegerType())])

    @tidy("toxicity")
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(per_bucket, bias)
        for batch in sliced(batches, text, 1 << 20):
            found = texts_of(batch.column(text))
            score = scorer.scores(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*first, *last])

    return rows.mapInArrow(rate, schema)
