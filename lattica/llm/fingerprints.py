"""Operator 8: homomorphic multiset hashes of texts, with DataFrame functions alone.

A paragraph (a line) hashes to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo powers of two. So the order of paragraphs doesn't matter, equality of fingerprints is equality of the
multisets of paragraphs, and inserting or deleting a paragraph adds or subtracts its vector (see combined()).

The vector has two parts, both in the string:
* EXACT lanes modulo 2^32, from the paragraph's SHA-512: they tell multisets apart.
* LIKE lanes modulo 2^16: how many of the paragraph's pairs of neighbouring words hash to each lane. The inner product
  of two texts' lanes, less what chance gives, estimates that of their multisets of pairs; a likeness follows from the
  strings alone (see likeness()), with a standard error of about 1 / sqrt(LIKE) at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import WORD_GAP, let, null_as, spent
from lattica.tables import positions

EXACT, LIKE = 16, 512
#: Ranges of ids: at most FINE to the third power; each bound is found by three looks at FINE bounds.
FINE = 64


def _pairs(line: Column) -> Column:
    """Lanes of a line's pairs of neighbouring words; a lone word is hashed alone."""
    last = lambda ws: F.when(F.size(ws) == 1, 1).otherwise(F.greatest(F.size(ws) - 1, F.lit(0)))
    lane = lambda h: F.shiftrightunsigned(h, 32).bitwiseAND(LIKE - 1).cast("int")
    return let(F.array_remove(F.split(line, WORD_GAP), ""), lambda ws: F.transform(F.slice(ws, F.lit(1), last(ws)), lambda w, i: lane(F.xxhash64(w, F.get(ws, i + 1)))))


def _counted(lanes: Column) -> Column:
    """How often each lane occurs, modulo 2^16: sorted with each lane once more, equal ones follow each other."""

    def runs(sorted_: Column) -> Column:
        ends = F.array_compact(F.transform(sorted_, lambda x, i: F.when(F.get(sorted_, i + 1).eqNullSafe(x), F.lit(None)).otherwise(i)))
        return let(ends, lambda e: F.transform(e, lambda at, k: (at - F.coalesce(F.get(e, k - 1), F.lit(-1)) - 1).bitwiseAND(0xFFFF)))

    return let(F.sort_array(F.concat(lanes, F.sequence(F.lit(0), F.lit(LIKE - 1)))), runs)


def vector(text: Column) -> Column:
    """exact (EXACT longs) and like (LIKE ints) of a text."""
    lines = lambda t: F.split(null_as(t), "\n", -1)
    word = lambda sha, k: F.conv(F.substring(sha, 1 + 8 * k, 8), 16, 10).cast("long")
    hashed = lambda line: let(F.sha2(line.cast("binary"), 512), lambda sha: F.array(*(word(sha, k) for k in range(EXACT))))
    exact = F.aggregate(F.transform(lines(text), hashed), F.array(*[F.lit(0).cast("long")] * EXACT), lambda a, b: combined(a, b))
    return F.struct(exact.alias("exact"), _counted(F.flatten(F.transform(lines(text), _pairs))).alias("like"))


def combined(left: Column, right: Column, sign: int = 1, bits: int = 32) -> Column:
    """Lanes after inserting (sign 1) or deleting (sign -1) what `right` stands for; bits 32 for exact, 16 for like."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + sign * b, F.lit(1 << bits)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the inner product over the sum of squared lengths, both estimated from the like lanes, from 0 to 1.

    Lanes that n and m pairs fall into by chance have an inner product of n * m / LIKE, which is taken off.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = lambda x: total(F.transform(x, lambda v: v.cast("double")))
    dot = lambda x, y: total(F.zip_with(x, y, lambda v, w: v.cast("double") * w))

    def ratio(n_a: Column, n_b: Column) -> Column:
        inner = dot(a, b) - n_a * n_b / LIKE
        length = dot(a, a) + dot(b, b) - (n_a * n_a + n_b * n_b) / LIKE
        # Lanes that are all alike have no length left: then only equal ones are alike.
        found = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * inner, length))), F.lit(0.0))
        return F.when(a == b, 1.0).when((n_a == 0) | (n_b == 0), 0.0).otherwise(found)

    return let(F.struct(n(a).alias("a"), n(b).alias("b")), lambda s: ratio(s["a"], s["b"]))


def hexed(v: Column) -> Column:
    """A fingerprint as a string: the exact lanes by 8 hexadecimal digits, then the like lanes by 4."""
    digits = lambda x, n: F.lower(F.array_join(F.transform(x, lambda y: F.lpad(F.hex(y), n, "0")), ""))
    four = lambda x, k: reduce(Column.bitwiseOR, (F.shiftleft(F.get(x, k * 4 + j).cast("long"), 48 - 16 * j) for j in range(4)))
    return F.concat(digits(v["exact"], 8), digits(F.transform(F.sequence(F.lit(0), F.lit(LIKE // 4 - 1)), lambda k: four(v["like"], k)), 16))


def _bounds(keys: DataFrame, rows_each: int) -> list[tuple[int, int]]:
    """The doc_id and text hash of every so many rows in order; at least the first. keys: doc_id, h."""
    n = keys.count()
    each = max(rows_each, -(-n // (FINE**3 - 1)))
    placed = positions(keys, ["doc_id", "h"])
    found = sorted({(r.doc_id, r.h) for r in placed.where(F.col("__pos") % each == 0).collect()})
    spent(placed)
    return found


def with_next(docs: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """bucket, extra, doc_id, h, text, next_text: each row with the text of the next one by doc_id and text hash.

    Rows go to the ranges between bounds. A range's first row also goes to the range before, as an extra last row, so
    that no range needs another.
    """
    n = len(bounds)
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    ids, hashes = longs([b[0] for b in bounds]), longs([b[1] for b in bounds])
    width = FINE
    reached = lambda k: (F.get(ids, k) < F.col("doc_id")) | ((F.get(ids, k) == F.col("doc_id")) & (F.get(hashes, k) <= F.col("h")))

    def look(start: Column, step: int) -> Column:
        """The last place among start, start + step … that a row has reached; the first one counts as reached."""
        more = F.filter(F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda k: start + k * step), lambda k: (k < n) & reached(k))
        return start + F.size(more) * step

    own = F.lit(0)
    if n > width * width:
        own = look(own, width * width)
    if n > width:
        own = let(own, lambda k: look(k, width))
    own = let(own, lambda k: look(k, 1)) if n > 1 else own
    place = lambda k, extra: F.struct(k.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    starts = lambda k: (F.get(ids, k) == F.col("doc_id")) & (F.get(hashes, k) == F.col("h"))
    places = let(own, lambda k: F.when(starts(k), F.array(place(k, False), place(F.pmod(k - 1, F.lit(n)), True))).otherwise(F.array(place(k, False))))
    rows = docs.select("doc_id", "h", "text", F.explode(places).alias("to")).select("to.*", "doc_id", "h", "text")
    order = W.partitionBy("bucket").orderBy("extra", "doc_id", "h")
    return rows.select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, rows_each: int = 4000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and likenesses. See the module.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document, by
    ascending doc_id (rows with equal ids: by a hash of the text); the last one's next is the first. Null texts are
    empty. A row with a null doc_id has no place in that order: it is no other's next, and its own next; so is a lone
    document. Repeated rows each give a row. Likeness of two texts without words is 1, of one without words and one
    with words 0. Very long texts are read whole; a lane counts up to 65,535 pairs before it starts anew, which equality
    never minds and likeness only there. An empty table gives no rows. Extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_as(F.col("text").cast("string")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    # Rows that are the same more often than a range has rows: each but the last is followed by itself.
    often = known.groupBy("doc_id", "h").agg(F.count("h").alias("copies")).where(F.col("copies") > rows_each).collect()
    alone = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    if often:  # at most one for each rows_each rows
        hot = docs.sparkSession.createDataFrame(often, "doc_id long, h long, copies long")
        one = known.join(F.broadcast(hot), ["doc_id", "h"]).groupBy("doc_id", "h", "copies").agg(F.first("text").alias("text"))
        alone = alone.union(one.select("doc_id", "text", F.col("copies") - 1))
        known = known.join(F.broadcast(hot.drop("copies")), ["doc_id", "h"], "left_anti").unionByName(one.drop("copies"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    measured = lambda rows, *keep: rows.select(*keep, "doc_id", n.cast("long").alias("n_chars"), vector(F.col("text")).alias("v"), edited.alias("edited"))
    alone = measured(alone.withColumn("next_text", F.col("text")), "copies").withColumn("next_v", F.col("v"))
    alone = alone.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    bounds = _bounds(known.select("doc_id", "h"), rows_each) or [(0, 0)]
    rows = measured(with_next(known, bounds), "bucket", "extra", "h")
    order = W.partitionBy("bucket").orderBy("extra", "doc_id", "h")
    rows = rows.withColumn("next_v", F.lead("v").over(order)).where(~F.col("extra"))
    parts = ["doc_id", "n_chars", "v", "edited", "next_v"]
    both = rows.select(*parts).union(alone.select(*parts))
    both = both.select("doc_id", "n_chars", "v", "next_v", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_v"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("v")).alias("fingerprint"), hexed(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v.like"), F.col("edited_v.like")).alias("near_edited"), likeness(F.col("v.like"), F.col("next_v.like")).alias("near_next"),
    )
