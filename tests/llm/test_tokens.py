"""Operators 1, 3 and 6 against the libraries and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from lattica.llm.packing import Packer, packed
from lattica.llm.pieces import Encoder, Pieces, decode, decoded, encoded
from lattica.llm.token_counts import token_counts
from lattica.llm.token_fst import Transducer
from tests.llm.conftest import frame

BPE = P.path("byte_bpe_50k.json")


def some_texts(n=1500, seed=3):
    rng = random.Random(seed)
    alphabet = " \t\n\r  '''srtmdlev  abcthe中123٣!?#<|>\x1c\x85​☃🙂éİ　"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)] + ["a" * 3000, " " * 2000, "th" * 2000, "x<|endoftext|> y<|endoftext|>", "<|endoftext|>", "'re", "'r", "  'll"]


def test_counts_and_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), Transducer(BPE)
    texts = some_texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.counts(texts).tolist() == [len(w) for w in want]
    assert [i.tolist() for i in own.ids(texts)] == want


@pytest.mark.parametrize("long", [16, 256])
def test_chunk_maps_of_long_pre_tokens(monkeypatch, long):
    from tokenizers import Tokenizer

    from lattica.llm import token_fst

    monkeypatch.setattr(token_fst, "LONG", long)
    library, own, rng = Tokenizer.from_file(BPE), Transducer(BPE), random.Random(1)
    texts = ["a" * n for n in (255, 256, 257, 511, 512, 513, 4097)] + ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefgh", "中文") for n in (300, 3000)] + ["-=" * 900 + " x", " " * 3000, "th" * 2000, "one " * 50 + "z" * 700]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.counts(texts).tolist() == [len(w) for w in want]
    assert [i.tolist() for i in own.ids(texts)] == want


def test_a_full_table_starts_anew():
    own = Transducer(BPE)
    texts = some_texts(300)
    want = own.counts(texts).tolist()
    own.merger.most_states = 10
    assert [own.counts([t]).tolist()[0] for t in texts] == want


def test_token_counts_of_odd_rows(spark, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = sorted(map(tuple, token_counts(frame(spark, odd_rows), BPE).collect()), key=repr)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in odd_rows), key=repr)
    assert token_counts(frame(spark, []), BPE).collect() == []


MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """For the library the registered model as a unigram one with the scores that the operator gives its pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for p, score in zip(model.pieces, Pieces(MODEL).score):
        p.score = score
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def best_sum(pieces, text):
    """The highest sum of log scores over all segmentations of a text, by trying every piece at every place."""
    table = {name: pieces.score[i] for name, i in pieces.names.items()}
    s = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-1e300] * len(s)
    for end in range(1, len(s) + 1):
        for begin in range(max(0, end - 20), end):
            if s[begin:end] in table:
                best[end] = max(best[end], best[begin] + table[s[begin:end]])
        if s[end - 1] not in table:
            best[end] = max(best[end], best[end - 1] + pieces.unknown_score)
    return best[-1]


def sum_of(pieces, ids, text):
    """The sum for ids: a run of byte pieces counts once for each character."""
    total, run = 0.0, []
    for i in [*ids, -1]:
        if i >= 0 and pieces.is_byte[i]:
            run.append(i)
            continue
        total += pieces.unknown_score * len(bytes(int(pieces.shown[k][3:5], 16) for k in run).decode()) if run else 0
        run = []
        total += pieces.score[i] if i >= 0 else 0
    return total


def test_scores_are_log_probabilities():
    pieces = Pieces(MODEL)
    own = np.array(list(pieces.names.values()))
    assert abs(np.exp(pieces.score[own]).sum() - 1) < 1e-9 and (pieces.score[own] < 0).all()


def test_the_registered_model_by_brute_force():
    pieces = Pieces(MODEL)
    texts = [t for t in some_texts(1200, 11) if len(t) < 100] + ["", "hello  world", "internationalization of the 中文 🙂 text", "aaaa bbbb\n\tcccc"]
    for t, ids in zip(texts, Encoder(pieces).encode(texts)):
        if t:
            assert abs(sum_of(pieces, ids.tolist(), t) - best_sum(pieces, t)) < 1e-6
        assert decode(pieces, ids) == t.replace("▁", " ")


def test_pieces_equal_the_library(unigram):
    import sentencepiece

    library, pieces = sentencepiece.SentencePieceProcessor(model_file=unigram), Pieces(unigram)
    texts = [t for t in some_texts(2000) if len(t) < 100] + ["", "▁", "<s> a <0x41>", "hello  world"]
    other = 0
    for t, ids in zip(texts, Encoder(pieces).encode(texts)):
        theirs = library.encode(t)
        if ids.tolist() != theirs:  # only sums that single precision can't tell apart
            other += 1
            assert abs(sum_of(pieces, ids.tolist(), t) - sum_of(pieces, theirs, t)) < 1e-3
        assert decode(pieces, ids) == library.decode(theirs)
    assert other < len(texts) / 20
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.choice([*pieces.byte_id[100:255].tolist(), 300, 500]) for _ in range(8)]
        assert decode(pieces, np.array(ids)) == library.decode(ids)


def test_encoded_odd_rows(spark, odd_rows):
    rows = encoded(frame(spark, odd_rows), MODEL, with_ids=True)
    got = rows.collect()
    assert len(got) == len(odd_rows) and all(r.round_trip for r in got)
    assert sorted((r.doc_id, r.n_pieces) for r in got if r.doc_id in (1, 2)) == [(1, 0), (2, 0)]
    back = {(r.doc_id, r.text) for r in decoded(rows, MODEL).collect()}
    assert back == {(i, t or "") for i, t in odd_rows}
    assert encoded(frame(spark, []), MODEL).collect() == []


def check_packing(rows, docs):
    """rows: doc, start, length, crc, tokens, sequence, offset; docs: ids by document. Every id once, no padding, no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert set(by_doc) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r[1]):
            assert (r[1], r[3], r[4]) == (at, zlib.crc32(ids[at : at + r[2]].astype("<u4").tobytes()), len(ids))
            at += r[2]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("pool", [500, 50_000, 10_000_000])
def test_packer(pool):
    rng = np.random.default_rng(0)
    docs = {k: rng.integers(0, 50_000, max(1, int(rng.lognormal(6, 1.4)))).astype("<u4") for k in range(800)}
    packer = Packer(3, pool_tokens=pool)
    rows = [r for k, ids in docs.items() for r in packer.add(k, ids)] + list(packer.close())
    check_packing(rows, docs)
    assert {r[7] for r in rows} >= {2048, 1024, 512, 256}


def test_step_groups_hold_equal_tokens():
    rng = np.random.default_rng(1)
    packer = Packer(3, step_tokens=8192)
    rows = [r for k in range(400) for r in packer.add(k, rng.integers(0, 50_000, max(1, int(rng.lognormal(5, 1.4)))).astype("<u4"))] + list(packer.close())
    tokens, of = defaultdict(int), {}
    for r in rows:
        tokens[r[8]] += r[2]
        assert of.setdefault(r[5], r[8]) == r[8]
    partial = [n for n in tokens.values() if n != 8192]
    assert len(tokens) > 5 and len(partial) <= 1 and all(n < 8192 for n in partial)


def test_packed_odd_rows(spark, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    one_each = [(k, t) for k, (_, t) in enumerate(odd_rows)]
    rows = [tuple(r) for r in packed(frame(spark, one_each), BPE).collect()]
    check_packing(rows, {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in one_each})
    again = packed(frame(spark, odd_rows), BPE).collect()
    assert sum(r.length for r in again) == sum(r[2] for r in rows) and any(r.doc_id is None for r in again)
    assert packed(frame(spark, []), BPE).collect() == []
