"""Operators 5, 8, 9 and 10: against brute force, odd rows, plans without Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from lattica.llm import fingerprints as prints
from lattica.llm.licenses import TEMPLATES, Tier, banded, licenses
from lattica.llm.preferences import preferences
from lattica.llm.quality_rules import quality_rules
from tests.llm.conftest import frame, words


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    return df.collect()


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(k, words(rng, rng.randrange(1, 120), rng.choice([3, 8, 300])).replace("w1 ", "w1\n")) for k in range(20, 80)]
    rows += [(100, "the cat sat on a mat and the dog ran to it " * 1 + " ".join(f"the v{k}" for k in range(40))), (101, "a | b | " * 40), (102, "THE!! " + " ".join(f"V{k}!!" for k in range(60)))]
    got = native(quality_rules(frame(spark, rows)))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((i, *counts(t)) for i, t in rows), key=repr)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[100] and not kept[101] and not kept[102] and not any(r.kept and r.base_failed for r in got)
    assert quality_rules(frame(spark, [])).collect() == []
    stay = quality_rules(frame(spark, rows), keep_columns=True)
    assert stay.columns[-1] == "rule_kept" and stay.columns[:-1] == frame(spark, []).columns
    assert quality_rules(stay, keep_columns=True).where("rule_kept <> rule__kept").count() == 0


def plain_print(t):
    """Lanes of a text by the definition: SHA-512 words of lines, and pairs of words by Spark's xxhash64, summed."""
    exact, like = [0] * prints.EXACT, [0] * prints.LIKE
    for line in t.split("\n"):
        sha = hashlib.sha512(line.encode()).hexdigest()
        exact = [(x + int(sha[8 * k : 8 * k + 8], 16)) % (1 << 32) for k, x in enumerate(exact)]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
        for pair in zip(w, w[1:]) if len(w) > 1 else [w] * len(w):
            h = 42
            for x in pair:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            like[(h >> 32) % prints.LIKE] += 1
    return exact, [x % (1 << 16) for x in like]


def lanes(print_):
    """The like lanes of a fingerprint string."""
    text = print_[8 * prints.EXACT :]
    return [int(text[k : k + 4], 16) for k in range(0, len(text), 4)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    n, m, size = sum(a), sum(b), len(a)
    if not n or not m:
        return 0.0
    inner = sum(x * y for x, y in zip(a, b)) - n * m / size
    length = sum(x * x for x in a + b) - (n * n + m * m) / size
    return min(1.0, max(0.0, 2 * inner / length)) if length else 0.0


@pytest.mark.parametrize("each,fine", [(1, 2), (3, 64), (1000, 64)])
def test_fingerprints(spark, odd_rows, each, fine, monkeypatch):
    monkeypatch.setattr(prints, "FINE", fine)
    rng = random.Random(5)
    rows = odd_rows + [(k, words(rng, rng.randrange(1, 30))) for k in (20, 21, 21, 23)] + [(None, "another one")]
    got = native(prints.fingerprints(frame(spark, rows), each))
    assert len(got) == len(rows)
    h = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], h(r[1])))
    pairs = [(i, t, known[(k + 1) % len(known)][1]) for k, (i, t) in enumerate(known)] + [(None, t, t) for i, t in rows if i is None]
    want = Counter()
    for i, t, other in pairs:
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        prints_ = [plain_print(x) for x in (t, edited, other)]
        own, changed = ("".join(f"{x:08x}" for x in e) + "".join(f"{x:04x}" for x in v) for e, v in prints_[:2])
        near = [round(plain_likeness(prints_[0][1], x[1]), 6) for x in prints_[1:]]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 6), round(r.near_next, 6)) for r in got) == want
    assert all(abs(plain_likeness(lanes(r.fingerprint), lanes(r.edited_fingerprint)) - r.near_edited) < 1e-9 for r in got)
    assert prints.fingerprints(frame(spark, [])).collect() == []
    alone = prints.fingerprints(frame(spark, [(5, "b\na")])).collect()[0]
    assert alone.near_next == 1


def test_one_row_repeated_often(spark):
    rows = [(1, "a b c")] + [(2, "d e\nf g")] * 50 + [(3, "h i j k")]
    got = prints.fingerprints(frame(spark, rows), 10).collect()
    edited = lambda t, o: hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == Counter({(1, edited("a b c", "d e\nf g")): 1, (2, edited("d e\nf g", "d e\nf g")): 49, (2, edited("d e\nf g", "h i j k")): 1, (3, edited("h i j k", "a b c")): 1})


def test_fingerprints_are_multisets(spark):
    from pyspark.sql import functions as F

    texts = {0: "x y z\nb\nb", 1: "b\nx y z\nb", 2: "b\nb", 3: "x y z", 4: "b\nx y z"}
    rows = spark.createDataFrame(list(texts.items()), "k long, text string").select("k", prints.vector(F.col("text")).alias("v")).select("k", "v.*")
    got = {r.k: r for r in rows.collect()}
    assert got[0][1:] == got[1][1:] and got[0].exact != got[4].exact
    for part, bits in (("exact", 32), ("like", 16)):
        df = spark.createDataFrame([(got[2][part], got[3][part], got[0][part])], "a array<long>, b array<long>, c array<long>")
        both, back = df.select(prints.combined(F.col("a"), F.col("b"), 1, bits), prints.combined(F.col("c"), F.col("b"), -1, bits)).first()
        assert both == got[0][part] and back == got[2][part]


def test_likeness_is_near_that_of_the_multisets(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(words(rng, 12, 5000) for _ in range(rng.randrange(1, 80)))) for k in range(60)]
    pairs = lambda t: Counter(p for line in t.split("\n") for w in [line.split()] for p in zip(w, w[1:]))
    errors = []
    for r in prints.fingerprints(frame(spark, rows)).collect():
        t, other = rows[r.doc_id][1], rows[(r.doc_id + 1) % 60][1]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        for found, x in ((r.near_edited, edited), (r.near_next, other)):
            a, b = pairs(t), pairs(x)
            errors.append(abs(found - 2 * sum(n * b[p] for p, n in a.items()) / sum(n * n for c in (a, b) for n in c.values())))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "go"), (0, 3, "assistant", "one"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "go"), (1, 3, "assistant", "two"),
        (2, 0, "user", None), (3, 0, None, "x"), (4, 0, "user", "alone"), (None, 0, "user", "lost"), (6, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, pair_id long, prompt string")
    got = {r.pair_id: r for r in native(preferences(df))}
    assert set(got) == {0, 1, 3}
    r = got[0]
    assert r.n_prompt_turns == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\ngo<|end|>\n"
    assert r.chosen == "<|assistant|>\none<|end|>\n" and r.rejected == "<|assistant|>\ntwo<|end|>\n"
    a, b = map(int, r.chosen_spans.split(":"))
    assert r.chosen[a:b] == "one<|end|>"
    assert got[1].n_prompt_turns == 0 and got[1].chosen == "<|user|>\n<|end|>\n" and got[1].chosen_spans == ""
    assert got[3].n_prompt_turns == 1 and got[3].chosen == ""
    pairs = spark.createDataFrame([(9, 1, 0)], "pair_id long, chosen_id long, rejected_id long")
    assert preferences(df, pairs).first().chosen == r.rejected
    assert preferences(df.limit(0)).collect() == []


def license_brute(rows, contained=0.8):
    def shingles(t):
        w = re.sub(r"[.,;:!?\"'()\[\]{}<>|*#$%&_/\\\-–—]", "", (t or "").lower())
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        return [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []

    out = []
    for i, t in rows:
        s = shingles(t)
        for name, template in TEMPLATES.items():
            own = set(shingles(template))
            most = 1 if len(own) == 1 else max(4, 1 << (len(own) - 1).bit_length())
            width, stride = (1, 1) if most == 1 else (2 * most, most)
            best = max(((len(own & set(s[a : a + width])) / len(own), -a) for a in range(0, len(s), stride)), default=(0, 0))
            if best[0] >= contained - 1e-9:
                out.append((i, name, round(best[0], 6), -best[1]))
    return sorted(out, key=repr)


def test_licenses(spark, odd_rows):
    rng = random.Random(7)
    rows = [*odd_rows, (98, " ".join(TEMPLATES["MIT text"].split() * 30)), (99, " ".join(TEMPLATES.values()))]
    for k in range(3 * len(TEMPLATES)):
        name, t = list(TEMPLATES.items())[k % len(TEMPLATES)]
        w = t.split()
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, words(rng, rng.randrange(0, 60)) + "\n" + " ".join(w).upper() + "\n" + words(rng, rng.randrange(0, 60))))
    got = sorted(((r.doc_id, r.license, round(r.containment, 6), r.place) for r in native(licenses(frame(spark, rows)))), key=repr)
    assert got == license_brute(rows) and len(got) > 20 and {x[1] for x in got} > {"MIT text", "BSD-2-Clause text", "GPL-3.0-or-later header"}
    assert licenses(frame(spark, [])).collect() == [] and licenses(frame(spark, rows), {}).collect() == []


def test_the_plan_is_the_same_for_any_number_of_templates(spark):
    docs = frame(spark, [(1, "a b c")])
    size = lambda n: licenses(docs, dict(list(TEMPLATES.items())[:n]))._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert size(4) == size(len(TEMPLATES))


def test_license_bands_hash_anew(spark):
    some = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(h,) for h in some], "h long")
    for band in (0, 1, 29):
        assert [r[0] for r in df.selectExpr(f"xxhash64({band}L, h)").collect()] == [banded(h, band) for h in some]
    bands = Tier(4, {"x": [1, 2, 3]}, 0.8).bands
    rng, missed = random.Random(5), 0
    for _ in range(20_000):
        window = [rng.getrandbits(64) - 2**63 for _ in range(8)]
        notice = window[:3]
        missed += not any(min(window, key=lambda h: banded(h, b)) in notice for b in bands)
    assert missed == 0
