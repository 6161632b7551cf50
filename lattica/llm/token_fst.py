"""Token counts and ids from finite-state transducers.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* The *splitter* reads code-point classes and marks where pre-tokens start. It has 13 states, so a chunk of text
  is a map from states to states. The maps of all chunks are worked out in lockstep, composed by a parallel prefix
  scan, and a second lockstep pass from the then known states emits the marks.
* The *merger* reads the bytes of a pre-token. Its state is what decides how the merges of any longer text go on:
  for each suffix that some token could still extend, the last token before it and the number of tokens before it,
  relative to now. A transition carries the change in the number of tokens; their sum over a pre-token is its token
  count. That BPE allows this rests on one fact: a prefix's encoding ends with the one token that, next to the
  last token of the encoding before it, merges to just these two. States come up as texts need them and are kept,
  up to a bound, beyond which the table starts anew.

All pre-tokens of a batch run in lockstep over numpy arrays. One starts from the known first state, so a short one is a
chunk by itself; a long one is cut in chunks, whose maps from the states that can precede them to end states and counts
are composed by a prefix scan as well.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

from lattica.llm.common import kept_for

# Splitter: classes of code points.
SP, WS, LET, NUM, OTH, APO, C1, CR, CV, CE, CL, END = range(12)
# Splitter: states.
S0, SL, SN, SO, W1S, W1O, WMS, WMO, A0, AR, AV, AL, AX = range(13)
N_STATES, N_CLASSES = 13, 12
#: Outputs of a transition: a pre-token starts at this symbol; one started at the symbol before.
HERE, BEFORE = 1, 2
#: Spreads keys over a table.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a chunk; longer pre-tokens are cut.
LONG = 256


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by class and state."""
    nxt = np.zeros((N_CLASSES, N_STATES), np.uint8)
    out = np.zeros((N_CLASSES, N_STATES), np.uint8)
    letters = (LET, C1, CR, CV, CE, CL)
    into = {SP: W1S, WS: W1O, NUM: SN, OTH: SO, APO: A0, END: S0} | dict.fromkeys(letters, SL)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            to, mark = into[c], HERE  # as if a pre-token ended before
            spaced = s in (W1S, W1O, WMS, WMO)
            if c == END:
                mark |= BEFORE * (s in (AR, AV, AL))
            elif spaced and c in (SP, WS):
                to, mark = (WMS if c == SP else WMO), 0
            elif spaced:
                # The last space of a run goes to what follows it; any other last gap stands alone.
                mark = HERE * (s in (W1O, WMO)) | BEFORE * (s in (WMS, WMO))
                if s in (W1S, WMS) and c == APO:
                    to = SO
            elif s == SL and c in letters or s == SN and c == NUM:
                mark = 0
            elif s in (SO, A0) and c in (OTH, APO):
                to, mark = SO, 0
            elif s == A0 and c in (C1, CR, CV, CL):
                to, mark = {C1: AX, CR: AR, CV: AV, CL: AL}[c], 0
            elif s in (AR, AV, AL):
                if c == (CL if s == AL else CE):
                    to, mark = AX, 0
                else:
                    mark = BEFORE | HERE * (c not in letters)
            nxt[c, s], out[c, s] = to, mark
    return nxt, out


NEXT, OUT = _splitter()


def code_point_classes() -> np.ndarray:
    """The splitter's class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    cls = np.full(0x110000, OTH, np.uint8)
    for pattern, c in ((r"\p{L}+", LET), (r"\p{N}+", NUM), (r"[\t-\r\x85  \p{Z}]+", WS)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                cls[a : b + 1] = c
            else:  # around the surrogates
                cls[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = c
    for chars, c in ((" ", SP), ("'", APO), ("stmd", C1), ("r", CR), ("v", CV), ("e", CE), ("l", CL)):
        cls[[ord(x) for x in chars]] = c
    return cls


def split_marks(classes: np.ndarray, width: int = 96) -> np.ndarray:
    """Where pre-tokens start, for a stream of classes that ends with END. Chunk maps, prefix scan, then marks."""
    n = len(classes)
    rows = -(-n // width)
    stream = np.full(rows * width, END, np.uint8)
    stream[:n] = classes
    columns = np.ascontiguousarray(stream.reshape(rows, width).T)
    flat_next, flat_out = NEXT.ravel(), OUT.ravel()
    base = columns.astype(np.uint16) * N_STATES
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for k in range(width):
        maps = flat_next[base[k][:, None] + maps]
    step = 1  # inclusive scan: each map becomes that of all chunks up to its own
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = S0, maps[:-1, S0]
    marks = np.empty((width, rows), np.uint8)
    for k in range(width):
        at = base[k] + state
        marks[k] = flat_out[at]
        state = flat_next[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


class Merger:
    """The merge transducer of a byte-level BPE vocabulary, made state by state as needed."""

    def __init__(self, path: str, most_states: int = 250_000):
        model = json.load(open(path, encoding="utf-8"))
        to_byte = _byte_alphabet()
        vocab = model["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.rank = {}
        for r, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.length = np.zeros(max([*self.bytes, *self.specials.values()]) + 1, np.int32)
        for i, b in self.bytes.items():
            self.length[i] = len(b)
        # A trie of the tokens: child by node and byte, the token that ends at a node (or -1), whether any goes on there.
        self.child: dict[int, int] = {}
        self.token_at, self.inner = array("i", [-1]), bytearray(1)
        for b, i in self.ids.items():
            node = 0
            for c in b:
                self.inner[node] = 1
                at = self.child.get(node << 8 | c)
                if at is None:
                    at = self.child[node << 8 | c] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                node = at
            self.token_at[node] = i
        self.fits: dict[int, bool] = {}
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        # A state's key is a list of (trie node of a suffix, token before it or -1, count before it, relative to now),
        # the longest suffix first and the empty one last, as 32-bit numbers.
        self.keys: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.last = np.full(1024, -1, np.int32)
        self.size = 0
        self._table(16)
        self._state([0, -1, 0])

    def _table(self, bits: int) -> None:
        """An empty open-addressing table of transitions, by state and byte."""
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.delta = np.zeros(1 << bits, np.int8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        slot = ((keys.view(np.uint64) * MIX) >> self.shift).view(np.int64)
        found = self.key[slot]
        wrong = np.flatnonzero((found != keys) & (found >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.key) - 1)
            found = self.key[slot[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found >= 0)]
        return slot

    def _put(self, keys: np.ndarray, to: np.ndarray, delta: np.ndarray) -> None:
        """Add transitions whose keys are new."""
        if (self.size + len(keys)) * 2 > len(self.key):
            used = self.key >= 0
            keys, to, delta = (np.concatenate(x) for x in ((self.key[used], keys), (self.next[used], to), (self.delta[used], delta)))
            self.size = 0
            self._table((4 * len(keys)).bit_length())
        self.size += len(keys)
        while len(keys):  # of keys with the same free slot one gets in at a time
            slot, one = np.unique(self._slots(keys), return_index=True)
            self.key[slot], self.next[slot], self.delta[slot] = keys[one], to[one], delta[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, to, delta = keys[rest], to[rest], delta[rest]

    def _learn(self, keys: np.ndarray) -> None:
        """Make these transitions."""
        made = [self._step(x >> 8, x & 255) for x in keys.tolist()]
        self._put(keys, np.array([x[0] for x in made], np.int32), np.array([x[1] for x in made], np.int8))

    def _state(self, numbers: list[int]) -> int:
        key = array("i", numbers).tobytes()
        s = self.keys.get(key)
        if s is None:
            s = self.keys[key] = len(self.states)
            self.states.append(key)
            if s == len(self.last):
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
            self.last[s] = numbers[-2]
        return s

    def merged(self, text: bytes) -> list[int]:
        """Ids of a short text by its merges, for one pair after another."""
        ids = [self.ids[bytes([b])] for b in text]
        while len(ids) > 1:
            r, k = min((self.rank.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _fit(self, left: int, right: int) -> bool:
        if left < 0:
            return self.merged(self.bytes[right]) == [right]
        return self.merged(self.bytes[left] + self.bytes[right]) == [left, right]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The state that a byte leads to, and the change in the number of tokens."""
        held = array("i", self.states[state])
        grown: list[tuple[int, int, int]] = []
        found = None
        for k in range(0, len(held), 3):
            node = self.child.get(held[k] << 8 | byte)
            if node is None:
                continue
            before, count, token = held[k + 1], held[k + 2], self.token_at[node]
            if token >= 0 and found is None:
                pair = before << 32 | token
                fit = self.fits.get(pair)
                if fit is None:
                    if len(self.fits) > 100_000:
                        self.fits.clear()
                    fit = self.fits[pair] = self._fit(before, token)
                if fit:
                    found = token, count + 1
            if self.inner[node]:
                grown.append((node, before, count))
        token, count = found
        key = [x for n, t, c in grown for x in (n, t, c - count)] + [0, token, 0]
        return self._state(key), count

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, lasts: np.ndarray | None = None) -> np.ndarray:
        """Token counts of the pre-tokens at start with these lengths in data; lasts gets the last token at each byte.

        A pre-token of more than LONG bytes is cut in chunks, whose state maps are composed (see _scanned).
        """
        if len(self.states) > self.most_states:
            self._reset()
        count = np.empty(len(start), np.int64)
        long = length > LONG
        short = np.flatnonzero(~long)
        count[short] = self._lockstep(data, start[short], length[short], np.zeros(len(short), np.int32), lasts)[1]
        if long.any():
            count[long] = self._scanned(data, start[long], length[long], lasts)
        return count

    def _lockstep(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, lasts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of stretches of bytes from these states, all a byte on at a time."""
        order = np.argsort(-length, kind="stable")
        at, todo, state = start[order], length[order], state[order].astype(np.int32)
        count = np.zeros(len(at), np.int64)
        most = int(todo[0]) if len(todo) else 0
        alive = np.searchsorted(-todo, -np.arange(most), side="left")
        for k in range(most):
            n = alive[k]
            byte = data[at[:n] + k]
            here = (state[:n].astype(np.int64) << 8) | byte
            slot = self._slots(here)
            missing = self.key[slot] < 0
            if missing.any():
                self._learn(np.unique(here[missing]))
                slot = self._slots(here)
            count[:n] += self.delta[slot]
            state[:n] = to = self.next[slot]
            if lasts is not None:
                lasts[at[:n] + k] = self.last[to]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _scanned(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, lasts: np.ndarray | None) -> np.ndarray:
        """Token counts of long pre-tokens by composing maps of chunks in a parallel prefix scan.

        A chunk's map goes from the few states that can precede it to its end state and token count. The first such
        state is guessed from the bytes before. A state that the scan then finds to come in and that a map lacks is added,
        and those it leads to.
        """
        chunks = -(-length // LONG)
        text = np.repeat(np.arange(len(start)), chunks)
        first = np.cumsum(chunks) - chunks
        number = np.arange(len(text)) - first[text]
        at = start[text] + number * LONG
        size = np.minimum(LONG, start[text] + length[text] - at)
        before = np.minimum(number * LONG, LONG)
        guess = self._lockstep(data, at - before, before, np.zeros(len(at), np.int32))[0]
        guess[number == 0] = 0
        into = guess[:, None]  # by chunk, the states that its map starts from
        out, count = (x[:, None] for x in self._lockstep(data, at, size, guess))
        while True:
            # Each map as places in the next chunk's list of states; -1: not in the list.
            width = into.shape[1]
            following = np.concatenate([into[1:], into[:1]])
            found = out[:, :, None] == following[:, None, :]
            step_to = np.where(found.any(2), found.argmax(2), -1)
            to, total = step_to.copy(), count.copy()
            head = number == 0
            step = 1
            begun = head.copy()  # maps that already go back to their text's first chunk
            while not begun.all():
                open_ = np.flatnonzero(~begun)
                left = open_ - step
                mid = to[left]  # where the chunks up to the left one lead, as a place in the first chunk of this map
                good = mid >= 0
                place = np.where(good, mid, 0)
                new_to = np.where(good, np.take_along_axis(to[open_], place, 1), -1)
                new_total = total[left] + np.where(good, np.take_along_axis(total[open_], place, 1), 0)
                done = begun[left]
                to[open_], total[open_], begun[open_] = new_to, new_total, done
                step *= 2
            # The place in each chunk's list at which its text comes in, 0 for a first chunk.
            came = np.where(head, 0, np.roll(to[:, 0], 1))
            lost = (came < 0) & ~head & (np.where(number == 1, 0, np.roll(np.roll(to[:, 0], 1), 1)) >= 0)
            if not (came < 0).any():
                break
            now = np.flatnonzero(lost)
            state = out[now - 1, came[now - 1]]
            into, out, count = (np.concatenate([x, np.full((len(text), 1), fill, x.dtype)], 1) for x, fill in ((into, -1), (out, -2), (count, 0)))
            while len(now):  # on to where a map knows the state that comes in
                into[now, width] = state
                out[now, width], count[now, width] = self._lockstep(data, at[now], size[now], state)
                onward = np.append(number, 0)[now + 1] > 0
                now, state = now[onward] + 1, out[now[onward], width]
                fresh = (into[now, width] < 0) & ~(into[now] == state[:, None]).any(1)
                now, state = now[fresh], state[fresh]
        if lasts is not None:
            self._lockstep(data, at, size, into[np.arange(len(text)), came], lasts)
        return total[first + chunks - 1, 0]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """A byte-level BPE tokenizer file as the two transducers."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.classes = code_point_classes()
        self.special = next(iter(self.merger.specials), None)

    def _streams(self, texts: list[str]):
        """Segments between special tokens, each ended by a newline that stands for END: bytes, pre-tokens, owners."""
        owner, parts, specials = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = text.split(self.special) if self.special and self.special in text else (text,)
            specials[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        classes = self.classes[points]
        classes[ends] = END
        starts = np.flatnonzero(split_marks(classes))
        if len(data) == len(points):
            at, ends_at = starts, ends
        else:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            place = np.cumsum(width) - width
            at, ends_at = place[starts], place[ends]
        length = np.diff(at, append=len(data))
        kept = classes[starts] != END
        at, length = at[kept], length[kept]
        return data, at, length, ends_at, np.asarray(owner), specials

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        data, at, length, ends, owner, specials = self._streams(texts)
        n = np.concatenate([[0], np.cumsum(self.merger.run(data, at, length), dtype=np.int64)])
        edge = np.searchsorted(at, ends)
        per_part = n[edge] - np.concatenate([[0], n[edge[:-1]]])
        return specials + np.bincount(owner, per_part, len(texts)).astype(np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: the last tokens at byte positions, followed backwards from the end of each pre-token."""
        if not texts:
            return []
        data, at, length, ends, owner, specials = self._streams(texts)
        lasts = np.zeros(len(data), np.int32)
        self.merger.run(data, at, length, lasts)
        is_end = np.zeros(len(data), bool)
        place, first = at + length - 1, at
        while len(place):
            is_end[place] = True
            place = place - self.merger.length[lasts[place]]
            more = place >= first
            place, first = place[more], first[more]
        where = np.flatnonzero(is_end)
        flat = lasts[where].astype(np.uint32)
        edge = np.searchsorted(where, ends)
        parts = np.split(flat, edge[:-1])
        if not specials.any():
            return parts
        out: list[list[np.ndarray]] = [[] for _ in texts]
        special = np.array([self.merger.specials.get(self.special, 0)], np.uint32)
        for i, part in zip(owner, parts):
            out[i] += [special, part] if out[i] else [part]
        return [np.concatenate(x) for x in out]


def transducer(path: str) -> Transducer:
    """The transducer of a file, one for each process that works on tokens."""
    loaded = kept_for("tokens")
    if path not in loaded:
        loaded[path] = Transducer(path)
    return loaded[path]
