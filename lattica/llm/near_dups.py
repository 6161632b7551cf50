"""Operator 4: near-duplicate groups by SetSketch registers, banded, estimated by likelihood and verified.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the set, and a SetSketch: for each of m
   registers the least of exponentially distributed hashes over the set, as the number of its power of BASE, cut off
   at 0 and TOP. Registers of a union are the maxima, and two registers are equal with about the chance of the sets'
   Jaccard similarity.
2. Texts with equal sets form a class, which is a node from here on, with a number of its own.
3. Bands of registers are keys. Each member of a key's bucket is held against the bucket's least node: first by the
   likelihood of both register vectors, then, where the similarity could be high enough, by the full sets.
4. The links found give components, by large-star and small-star rounds over tables.
5. In buckets that still hold several components every pair across components is held against each other by registers,
   in blocks of a bounded size; a pair that shares several keys only under the first. Nodes that this leaves with a
   likely partner form small groups, bounded in bytes, which are verified by full sets. So no link between texts that
   share a key is lost, though the pairs of a bucket whose members hang together are never made, and full sets travel
   only where registers ask for them.

Nothing but counts, and keys with more rows than a partition's share, goes to the driver. Ids are broadcast only up to MOST_BROADCAST of them; more are joined by shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower, fewer_files, sliced, spent, spread_join, texts_of, tidy, written

REGISTERS, BASE, RATE, TOP = 192, 1.001, 20.0, 65534
#: The chance to lose a pair exactly at the threshold is at most this.
MOST_LOST = 1e-6
#: Pairs whose estimate is so many standard errors below the threshold aren't verified.
MARGIN = 5.5
#: Nodes of a block, bytes of full sets of a group to verify, and rows of a table that is broadcast, at most.
BLOCK, CHUNK, MOST_BROADCAST = 2048, 1 << 19, 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def rows_in_band(similarity: float) -> int:
    """The most rows a band can have without losing more pairs at the threshold than allowed."""
    return max(r for r in range(1, 33) if (1 - similarity**r) ** (REGISTERS // r) <= MOST_LOST or r == 1)


class Words(dict):
    """64-bit hashes of words; short ones are kept, up to a bound: about 30 MB."""

    most, longest = 200_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return (x ^ (x >> np.uint64(32))) * _C


def shingles(text: str, size: int, known: Words) -> np.ndarray:
    """Sorted hashes of the distinct `size`-word shingles; of fewer words, of all of them as one."""
    words = ascii_lower(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = _mixed(out * _A + h[k : k + n])
    return np.unique(out ^ (out >> np.uint64(31)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, of which none is empty."""
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
    change = rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    edge = np.cumsum(size) - size
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    for i in range(REGISTERS):
        h = (x ^ change[i]) * odd[i]
        h ^= h >> np.uint32(15)
        h *= odd[-1 - i]
        least[i] = np.minimum.reduceat(h, edge)
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _likelihood(j: np.ndarray | float, u: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Log-likelihood of a similarity: `more` registers of a are above, `less` below those of b; u: a's share of both sizes."""
    share = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = share(u - (1 - u) * j), share((1 - u) - u * j)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-12))


def estimates(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarities, by how many registers of a are above, and below, those of b, and both sets' sizes."""
    u = n_a / (n_a + n_b)
    low, high = np.zeros_like(u), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(24):  # the likelihood has one peak; to 1e-4
        third = (high - low) / 3
        left, right = low + third, high - third
        up = _likelihood(left, u, more, less) < _likelihood(right, u, more, less)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def shared_sizes(sets: list[np.ndarray], left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact sizes of the intersections of the sets at `left` with all of them: some of the places and their rows of sizes at a time.

    Shingles that only one set has can't count, so the others make a small 0-1 matrix whose product has all sizes; where
    it would be large, places of shingles are counted for one set after the other.
    """
    every = np.concatenate(sets)
    values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = count[inverse] > 1
    rank = np.cumsum(count > 1) - 1
    width = int(rank[-1]) + 1
    places, owner = rank[inverse[common]], owner[common]
    if width * len(sets) <= 1 << 22:
        held = np.zeros((len(sets), width), np.float32)
        held[owner, places] = 1
        for k in range(0, len(left), 256):
            yield left[k : k + 256], np.rint(held[left[k : k + 256]] @ held.T).astype(np.int64)
        return
    for x in left:
        mine = np.zeros(width, bool)
        mine[places[owner == x]] = True
        yield np.array([x]), np.bincount(owner[mine[places]], minlength=len(sets))[None]


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest, sketch of every row."""

    @tidy("near duplicates")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in sliced(batches, "text", 1 << 19):
            if len(known) >= Words.most:
                known.clear()
            sets = [shingles(t, size, known) for t in texts_of(batch.column("text"))]
            full = [k for k, s in enumerate(sets) if len(s)]
            sketch: list[bytes | None] = [None] * len(sets)
            if full:
                for k, r in zip(full, registers([sets[k] for k in full])):
                    sketch[k] = r.astype("<u2").tobytes()
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "digest", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """digest and full set of every row doc_id, text that has words."""

    @tidy("near duplicates")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in sliced(batches, "text", 1 << 20):
            sets = [w for w in (shingles(t, size, known).tobytes() for t in texts_of(batch.column("text"))) if w]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["digest", "words"])

    return docs.mapInArrow(run, "digest binary, words binary")


def _needed_sets(nodes: DataFrame, most: int, classes: DataFrame, docs: DataFrame, size: int, name: str) -> DataFrame:
    """The full sets of some nodes, of which there are at most `most`, as a table; only texts with the least ids of the nodes' classes are read into sets.

    An id may have several texts, so a set goes to its node by the digest.
    """
    ids = written(fewer_files(classes.select("node", "digest", "least").join(nodes.distinct(), "node", "left_semi"), most), f"{name}-ids")
    n = ids.count()
    near = F.broadcast if n <= MOST_BROADCAST else lambda x: x
    sets = _sets(docs.join(near(ids.select(F.col("least").alias("doc_id")).distinct()), "doc_id", "left_semi"), size)
    out = written(fewer_files(sets.join(near(ids.select("digest", "node")), "digest").select("node", "words").dropDuplicates(["node"]), n, 5_000), f"{name}-sets")
    spent(ids)
    return out


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose most likely similarity by sizes and registers, and MARGIN standard errors, reach the threshold."""

    @tidy("near duplicates")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
                n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                most_likely = estimates(np.count_nonzero(x > y, axis=1), np.count_nonzero(x < y, axis=1), n_a, n_b)
                good = most_likely >= similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / REGISTERS) - 1e-3
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    fit = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1
    return spread_join(pairs.join(side("a"), "a"), side("b"), "b", *_by_b(pairs)).where(fit).mapInArrow(run, "a long, b long")


def _by_b(pairs: DataFrame) -> tuple[DataFrame, int]:
    """How many pairs each node b has, and all have."""
    return pairs.groupBy("b").agg(F.count("a").alias("k")), pairs.count()


def could_be(x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the likelihood of rows of x and y has its peak no more than MARGIN standard errors below the threshold.

    It has one peak, so it is there or above where the likelihood still rises.
    """
    low = similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / REGISTERS)
    u = n_a / (n_a + n_b)
    more, less = np.count_nonzero(x > y, axis=1), np.count_nonzero(x < y, axis=1)
    return (np.minimum(u, 1 - u) / np.maximum(u, 1 - u) > low) & (_likelihood(low + 1e-4, u, more, less) >= _likelihood(low - 1e-4, u, more, less))


def _verified(pairs: DataFrame, most: int, classes: DataFrame, docs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Of at most `most` pairs those (a, b) whose full sets have 100 * intersection >= percent * union, as a table."""
    pairs = written(fewer_files(pairs, most), f"{name}-pairs")
    most = pairs.count()
    sets = _needed_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), 2 * most, classes, docs, size, name)

    @tidy("near duplicates")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("wa"), batch.column("wb")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("words").alias(f"w{c}"))
    links = written(fewer_files(spread_join(pairs.join(side("a"), "a"), side("b"), "b", *_by_b(pairs)).mapInArrow(run, "a long, b long"), most, 10_000), f"{name}-links")
    spent(pairs, sets)
    return links


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, which has none to a lesser one itself: then the lesser one is the component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).isEmpty()


def components(edges: DataFrame, most: int) -> DataFrame:
    """node, component (the least node) of every node that one of at most `most` edges (a, b) has; by large-star and small-star rounds. A table."""
    edges = written(fewer_files(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), most), "edges")
    while not _stars(edges):
        n = edges.count()
        both = edges.union(edges.select("b", "a"))
        least = written(fewer_files(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("b").alias("k")), 2 * n), "least")
        near = spread_join(both, least.drop("k"), "a", least, 2 * n)
        large = written(fewer_files(near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), n), "large")
        spent(least, edges)
        n = large.count()
        least = written(fewer_files(large.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("k")), n), "least")
        near = spread_join(large, least.drop("k"), "a", least, n)
        edges = written(fewer_files(near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct(), n), "edges")
        spent(least, large)
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = written(fewer_files(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own).distinct(), 2 * most), "components")
    spent(edges)
    return out


def screened(table: pa.Table, similarity: float, band_rows: int) -> pa.Table:
    """Of the nodes of two blocks of a bucket those with a likely partner in another component, in groups to verify.

    A pair counts where its registers leave its similarity open and no earlier band has its key too. Nodes that pairs
    connect are a group; one with more than CHUNK bytes of full sets is cut in parts, and each two parts are a group.
    """
    out: list[tuple[int, int, int, int]] = []
    node, component, block, n = (table[c].to_numpy() for c in ("node", "component", "block", "n"))
    if len(node) and (component != component[0]).any():
        key, band, low, high, inner = (table[c][0].as_py() for c in ("key", "band", "i", "j", "inner"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        least = REGISTERS * (similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / REGISTERS))
        label = np.arange(len(node))
        for k in np.flatnonzero(block == low):
            # Registers are equal with at least the chance of the similarity, so few equal ones rule a pair out.
            near = (component != component[k]) & (np.minimum(n, n[k]) >= similarity * np.maximum(n, n[k]) - 1)
            near[: k + 1] &= block[: k + 1] != low
            if not inner:
                near &= block != low
            at = np.flatnonzero(near)
            same = sketch[at] == sketch[k]
            good = same.sum(1) >= least
            at, same = at[good], same[good]
            if len(at):
                first = same[:, : REGISTERS // band_rows * band_rows].reshape(len(at), -1, band_rows).all(2).argmax(1) == band
                good = first & could_be(np.broadcast_to(sketch[k], (len(at), REGISTERS)), sketch[at], np.full(len(at), float(n[k])), n[at].astype(np.float64), similarity)
                at = at[good]
            if len(at):
                joined = np.append(label[at], label[k])
                label[np.isin(label, joined)] = joined.min()
        names, size = np.unique(label, return_counts=True)
        for name in names[size > 1]:
            members = np.flatnonzero(label == name)
            part = np.cumsum(n[members] * 8) // CHUNK
            _, part = np.unique(part, return_inverse=True)
            for u in range(int(part[-1]) + 1):
                for v in range(u, int(part[-1]) + 1):
                    sub = xxhash.xxh3_64_intdigest(struct.pack("<6q", key, low, high, name, u, v)) - (1 << 63)
                    for m, p in zip(members.tolist(), part.tolist()):
                        if p in (u, v):
                            out.append((sub, int(node[m]), int(component[m]), int(p != u)))
    return pa.table({c: pa.array(x, k) for (c, k), x in zip((("sub", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("part", pa.int32())), zip(*out) if out else [[]] * 4)})


def linked(table: pa.Table, percent: int) -> pa.Table:
    """Links across components of a group of nodes with full sets, of two parts from one to the other; only those that join further components."""
    found: list[tuple[int, int]] = []
    node, component, part = (table[c].to_numpy() for c in ("node", "component", "part"))
    if len(node) > 1:
        sets = [np.frombuffer(w.as_buffer(), np.uint64) for w in table["words"]]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        two = bool(part.any())
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        for left, common in shared_sizes(sets, np.flatnonzero(part == 0)):
            good = (100 * common >= percent * (n[left, None] + n - common)) & (component[left, None] != component)
            if two:
                good &= part == 1
            for x, y in zip(*(z.tolist() for z in np.nonzero(good))):
                p, q = root(int(component[left[x]])), root(int(component[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((int(node[left[x]]), int(node[y])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _across(shared: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between nodes that share a key but no component, without those with a bucket's least node, as a table; None: there are none.

    A bucket's largest component is dealt to blocks of its own, the rest to others; blocks of the rest meet all blocks,
    so a bucket of k nodes, r of them outside its largest component, gives about k * r / BLOCK rows.
    """
    similarity = percent / 100
    rows = shared.where("node <> pivot").join(members, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    n = shared.count()
    rows = written(fewer_files(rows, n), "residual")
    parts = rows.groupBy("key", "component").agg(F.count("node").alias("k"))
    many = parts.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.max("k").alias("n_major"), F.sum("k").alias("k"), F.count("k").alias("parts"))
    mixed = written(fewer_files(many.where("parts > 1").select("key", "major", "n_major", "k"), n // 2), "mixed")
    if mixed.isEmpty():
        spent(rows, mixed)
        return None
    held = rows.join(F.broadcast(mixed), "key") if mixed.count() <= MOST_BROADCAST else spread_join(rows, mixed, "key", mixed, n)
    rows_mixed = written(fewer_files(held.withColumn("own", F.xxhash64("node", "key")), n), "mixed-rows")
    n = rows_mixed.count()
    low, high = F.ceil((F.col("k") - F.col("n_major")) / BLOCK).cast("int"), F.ceil(F.col("n_major") / BLOCK).cast("int")
    in_major = F.col("component") == F.col("major")
    dealt = rows_mixed.join(classes.select("node", "n", "sketch"), "node").withColumns({"low": low, "high": high})
    dealt = dealt.withColumn("block", F.when(in_major, F.col("low") + F.pmod("own", "high")).otherwise(F.pmod("own", "low")).cast("int"))
    others = F.when(in_major, F.sequence(F.lit(0), F.col("low") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("low") + F.col("high") - 1), F.col("block")))
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.select("key", "band", "node", "component", "n", "sketch", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.greatest("block", "other") == F.col("low")).alias("inner"))
    band_rows = rows_in_band(similarity)
    likely = dealt.groupBy("key", "i", "j").applyInArrow(lambda t: screened(t, similarity, band_rows), "sub long, node long, component long, part int")
    groups = written(fewer_files(likely, n, 10_000), "likely")
    spent(rows, mixed, rows_mixed)
    if groups.isEmpty():
        spent(groups)
        return None
    n = groups.count()
    sets = _needed_sets(groups.select("node"), n, classes, docs, size, "rest")
    links = written(fewer_files(groups.join(sets, "node").groupBy("sub").applyInArrow(lambda t: linked(t, percent), "a long, b long"), n, 5_000), "rest-links")
    spent(groups, sets)
    return links


def near_dups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: see the module. Links need 100 * intersection >= percent * union.

    A null or text without words has an empty set and is linked with nothing. Rows that share a doc_id and have words
    are linked, whatever their texts; each of the texts has its own links to others.
    A null doc_id is linked with nothing; its component_id is null and it isn't kept. Repeated rows each give a row.
    An empty table gives no rows. Ties: of several least nodes or components the smallest number wins, which only decides
    what is compared first. A very long text is one set like others; a task holds about 512 KB of text, or one text, at a
    time. Words and shingles are told apart by 64-bit hashes, sets by 128-bit ones, so "full sets" are sets of hashes.
    Extra columns are not read.
    """
    similarity = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = written(_sketched(docs, size), "sketches")
    full = all_rows.where("doc_id IS NOT NULL AND n > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("n").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    n_rows = all_rows.count()
    classes = written(fewer_files(classes, n_rows).withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = rows_in_band(similarity)
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sketch", 1 + 2 * rows * k, 2 * rows)) for k in range(REGISTERS // rows)))
    banded = classes.select("node", F.posexplode(keys).alias("band", "key"))
    n = classes.count() * (REGISTERS // rows)
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("node").alias("k")).where("pivot < last").select("key", "pivot", "k")
    pivots = written(fewer_files(pivots, n // 2), "pivots")
    least = pivots.drop("k")
    shared = banded.join(F.broadcast(least), "key") if pivots.count() <= MOST_BROADCAST else spread_join(banded, least, "key", pivots, n)
    shared = written(fewer_files(shared, n), "shared")
    stars = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = written(fewer_files(stars, shared.count()), "stars")
    links = _verified(_likely(stars, classes, similarity), stars.count(), classes, docs, size, percent, "star")
    n = links.count()
    members = components(links, n)
    more = _across(shared, members, classes, docs, size, percent)
    spent(pivots, shared, stars, links)
    # Classes that have an id in common hang together by it.
    several = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    several = written(fewer_files(several, n_rows // 2), "several")
    final, tables = members, [several, members]
    if more is not None or not several.isEmpty():
        texts = full.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
        texts = written(fewer_files(texts, n_rows), "texts")
        own = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
        edges = members.select(F.col("node").alias("a"), F.col("component").alias("b")).union(own)
        final = components(edges if more is None else edges.union(more), members.count() + texts.count() + (0 if more is None else more.count()))
        tables += [texts, final] + ([] if more is None else [more])
    named = final.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("id"), F.count("least").alias("k"))
    n = final.count()
    named = written(fewer_files(named, n), "named")
    ids = spread_join(final, named.drop("k"), "component", named, n).select("node", "id")
    changed = classes.select("node", "digest", "copies", "least").join(ids, "node", "left").where("copies > 1 OR id IS NOT NULL")
    changed = written(fewer_files(changed.select("digest", F.coalesce("id", "least").alias("component"), F.col("copies").alias("k")), n_rows), "changed")
    spent(classes, named, *tables)
    # Rows without words have no class; their digest is one of their own, lest they all go to one task.
    out = all_rows.select("doc_id", "n", F.coalesce("digest", F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("digest"))
    out = spread_join(out, changed.drop("k"), "digest", changed, n_rows, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
