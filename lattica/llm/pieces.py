"""Operator 1: SentencePiece encoding and decoding under the unigram model.

Encoding is a Viterbi search for the segmentation into pieces with the highest sum of log scores. Pieces lie in a
double-array trie over their UTF-8 bytes. A character that no piece of one character covers costs the lowest score
less a penalty and becomes byte pieces. Spaces become whitespace markers, one more in front of a text, as the model file's
normalizer says.

A unigram model's scores are log probabilities. A merge model's are minus the ranks of its pieces; frequencies fall with
the rank about as Zipf's law says, so there a piece of rank r (from 0 on) gets the log probability of 1 / (r + 1), scaled to
a sum of 1. That is a rule over the file; nothing is trained.

No piece of the usual models holds a marker after another character. Then a text falls into independent stretches,
markers and what follows them; only stretches that a process hasn't seen yet are searched, all of them in lockstep over
numpy arrays. With other models a whole text is one stretch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import sliced, texts_of, tidy

MARK = "▁"
#: What an unknown character costs beyond the lowest score.
PENALTY = 10.0


class DoubleArray:
    """A trie: the child of node s by byte c is base[s] + c + 1 if check there is s; value is the entry's number or -1."""

    def __init__(self, entries: dict[bytes, int]):
        children: dict[bytes, list[int]] = {}
        for word in entries:
            for k in range(len(word)):
                kids = children.setdefault(word[:k], [])
                if word[k] not in kids:
                    kids.append(word[k])
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        todo, first = [(b"", 0)], 1
        while todo:
            word, node = todo.pop()
            kids = sorted(children.get(word, ()))
            if not kids:
                continue
            codes = np.array(kids) + 1
            at, look = -1, first
            while at < 0:  # the first base whose places for all children are free
                if look + 1024 >= len(self.check):
                    self._grow()
                free = look + np.flatnonzero(self.check[look : look + 512] < 0) - codes[0]
                free = free[free > 0]
                for c in codes[1:]:
                    free = free[self.check[free + c] < 0]
                    if not len(free):
                        break
                at, look = (int(free[0]), look) if len(free) else (-1, look + 512)
            if len(kids) == 1:  # what lies before is nearly full
                first = at + int(codes[0])
            self.base[node] = at
            for c in kids:
                self.check[at + c + 1] = node
                longer = word + bytes([c])
                self.value[at + c + 1] = entries.get(longer, -1)
                todo.append((longer, at + c + 1))
        while len(self.check) < int(self.base.max()) + 258:
            self._grow()

    def _grow(self) -> None:
        for name, fill in (("base", 0), ("check", -1), ("value", -1)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(len(old), fill, np.int32)]))


class Pieces:
    """The pieces of a model file, for both directions."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or not rule.escape_whitespaces:
            raise ValueError("a model that maps characters, or keeps spaces as they are, isn't supported")
        self.prefix, self.squeeze = rule.add_dummy_prefix, rule.remove_extra_whitespaces
        kind = proto.ModelProto.SentencePiece
        names, types = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        n = len(names)
        own = [t in (kind.NORMAL, kind.USER_DEFINED) for t in types]
        self.score = np.array([p.score for p in model.pieces], np.float64)
        if model.trainer_spec.model_type == proto.TrainerSpec.BPE:
            self.score = zipf(self.score, np.array(own))
        special = [t in (kind.BYTE, kind.CONTROL, kind.UNKNOWN) for t in types]
        normal = {names[i].encode(): i for i in range(n) if own[i]}
        self.names, self.shown = {k.decode(): i for k, i in normal.items()}, names
        self.trie = DoubleArray(normal)
        self.longest = max(map(len, normal))
        self.unknown_score = min(self.score[i] for i in normal.values()) - PENALTY
        by_name = {x: i for i, x in enumerate(names)}
        self.byte_id = np.array([by_name[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        self.is_byte = np.array([t == kind.BYTE for t in types])
        shown = [bytes([int(names[i][3:5], 16)]) if self.is_byte[i] else b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.size = np.array([len(x) for x in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        apart = not any(MARK in p.lstrip(MARK) for p in map(bytes.decode, normal))
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s).+").findall

    def normal(self, text: str) -> str:
        """The text as it is searched: spaces as markers, one in front."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return (MARK * self.prefix + text.replace(" ", MARK)) if text else ""


def zipf(score: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law for the pieces `own`, whose scores fall with their ranks; equal scores have one rank."""
    _, rank = np.unique(-score[own], return_inverse=True)
    out = np.zeros(len(score))
    out[own] = -np.log(rank + 1.0) - np.log((1 / (rank + 1.0)).sum())
    return out


class Encoder:
    """Encodes texts; keeps the ids of short stretches, up to a bound of about 60 MB."""

    def __init__(self, pieces: Pieces, most: int = 200_000, longest: int = 48):
        self.pieces, self.most, self.longest = pieces, most, longest
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        cut = [self.pieces.stretches(self.pieces.normal(t)) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set().union(*cut))
        found: dict[str, bytes] = {}
        part, size = [], 0
        for k, s in enumerate(new):
            part.append(s)
            size += len(s)
            if size >= 300_000 or k + 1 == len(new):
                found.update(zip(part, self._search([s.encode("utf-8", "replace") for s in part])))
                part, size = [], 0
        self.known.update((s, x) for s, x in found.items() if len(s) <= self.longest and len(self.known) < self.most)
        get = lambda s: found[s] if s in found else self.known[s]
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def _edges(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """From, to, id (-1: unknown character) of every piece found in the stretches; end: each byte's stretch's end."""
        trie = self.pieces.trie
        begins = (data & 0xC0) != 0x80
        first = np.flatnonzero(begins)
        width = np.diff(first, append=len(data))
        at, node, number = first, np.zeros(len(first), np.int64), np.arange(len(first))
        found, alone = [], np.zeros(len(first), bool)
        for d in range(self.pieces.longest):
            inside = at + d < end[at]
            at, node, number = at[inside], node[inside], number[inside]
            if not len(at):
                break
            to = trie.base[node] + data[at + d].astype(np.int64) + 1
            good = trie.check[to] == node
            at, node, number = at[good], to[good], number[good]
            entry = trie.value[node]
            hit = entry >= 0
            found.append((at[hit], at[hit] + d + 1, entry[hit]))
            alone[number[hit & (width[number] == d + 1)]] = True
        rest = ~alone
        found.append((first[rest], (first + width)[rest], np.full(int(rest.sum()), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _search(self, stretches: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        data = np.frombuffer(b"".join(stretches), np.uint8)
        stop = np.cumsum(size)
        begin = stop - size
        start_of, end_of = np.repeat(begin, size), np.repeat(stop, size)
        source, target, entry = self._edges(data, end_of)
        score = np.where(entry >= 0, self.pieces.score[entry], self.pieces.unknown_score)
        offset = target - start_of[source]
        order = np.lexsort((source, target, offset))
        source, target, entry, score, offset = source[order], target[order], entry[order], score[order], offset[order]
        # Places are bytes' ends; a stretch's begin has the same place as the end before it, so keep them apart.
        best = np.full(len(data) + 1, -np.inf)
        came, by = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int32)
        edge = np.flatnonzero(np.diff(offset, prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(offset)]):
            s, t = source[a:b], target[a:b]
            total = np.where(s == start_of[s], 0.0, best[s]) + score[a:b]
            group = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(total, group)
            high = np.flatnonzero(total == np.repeat(top, np.diff(group, append=b - a)))
            one = high[np.flatnonzero(np.diff(t[high], prepend=-1))]  # of equals the one that starts first
            best[t[one]], came[t[one]], by[t[one]] = total[one], s[one], entry[a:b][one]
        ids, used = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        place, first = stop.copy(), begin.copy()
        while len(place):
            entry, back = by[place], came[place]
            plain = entry >= 0
            ids[place[plain] - 1], used[place[plain] - 1] = entry[plain], True
            a, n = back[~plain], (place - back)[~plain]
            spots = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            ids[spots], used[spots] = self.pieces.byte_id[data[spots]], True
            more = back > first
            place, first = back[more], first[more]
        flat = ids[used].astype(np.int32).tobytes()
        count = np.concatenate([[0], np.cumsum(used)])
        ends = (count[stop] * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _utf8(data: bytes) -> str:
    """UTF-8 as text; each byte that isn't part of a character becomes U+FFFD."""
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: markers become spaces, the first one goes, byte pieces join to characters."""
    if not len(ids):
        return ""
    size = pieces.size[ids]
    at = np.repeat(pieces.start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    data = pieces.flat[at].tobytes()
    if pieces.prefix and data[:1] == b" " and not pieces.is_byte[ids[0]]:
        data = data[1:]
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _utf8(data)


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian signed 32-bit ids), round_trip of every text; with_ids: ids too.

    round_trip: decoding gives the text again (a text that holds the whitespace marker itself doesn't). A null or
    empty text has no pieces; a null id stays null; repeated rows stay; an empty table gives no rows; other columns are
    not read. Of segmentations with equal sums the one whose last piece starts first is taken, and so on backwards. Scores
    are summed in double precision within a stretch, so very long texts lose no precision.
    """
    pieces = Pieces(model)
    columns = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    @tidy("pieces")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in sliced(batches, "text", 1 << 20):
            texts = texts_of(batch.column("text"))
            ids = encoder.encode(texts)
            out = [
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(pieces.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), pa.array([decode(pieces, x) == t for x, t in zip(ids, texts)]),
            ]
            if with_ids:
                out.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in columns.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, columns)


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with the text of their ids in column text (null ids: null)."""
    pieces = Pieces(model)
    kept = [c for c in rows.columns if c != "text"]

    @tidy("pieces")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else decode(pieces, np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(text, pa.string())], [*kept, "text"])

    from pyspark.sql import types as T

    return rows.select(*kept).mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType())]))
