"""Operator 4 against all pairs, and its parts."""

import random
import re

import numpy as np
import pytest

from lattica.llm import near_dups as M
from tests.llm.conftest import frame, words


def brute(rows, size, percent):
    """Components over all pairs of sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            n = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] and sets[a] and sets[b] or n and 100 * n >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least[root(k)] if i is not None else None, i is not None and least[root(k)] == i) for k, (i, _) in enumerate(rows)), key=repr)


def families(seed=4):
    """Chains of edits: neighbours are similar, ends aren't; and a large group around one text."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(6):
        w = words(rng, 90).split()
        for _ in range(12):
            rows.append((i, " ".join(w)))
            i += 1
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    base = words(rng, 120).split()
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
        i += 1
    rows += [(i + k, words(rng, rng.randrange(1, 60))) for k in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_dups(spark, size, percent, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "CHUNK", 4000)
    rows = families()
    got = sorted(map(tuple, M.near_dups(frame(spark, rows), size, percent).collect()), key=repr)
    assert got == brute(rows, size, percent)


def test_odd_rows(spark, odd_rows):
    got = sorted(map(tuple, M.near_dups(frame(spark, odd_rows), 3, 85).collect()), key=repr)
    assert got == brute(odd_rows, 3, 85)
    assert M.near_dups(frame(spark, []), 3, 85).collect() == []
    twice = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d")]
    assert {r.component_id for r in M.near_dups(frame(spark, twice), 3, 85).collect()} == {1}


def test_ids_with_two_texts(spark):
    rng = random.Random(8)
    rows, near = [], lambda t: " ".join(["changed", *t.split()[1:]])
    for k in range(40):
        one, two = words(rng, 80, 5000), words(rng, 80, 5000)
        rows += [(10 * k, one), (10 * k, two), (10 * k + 1, near(one)), (10 * k + 2, near(two))]
    rows += [(500, rows[5][1]), (405, rows[3][1]), (405, words(rng, 80, 5000))]
    want = brute(rows, 3, 85)
    for order in (rows, rows[::-1]):
        assert sorted(map(tuple, M.near_dups(frame(spark, order), 3, 85).collect()), key=repr) == want


def test_registers_merge_and_estimates():
    rng = np.random.default_rng(2)
    a, b, shared = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 500, 4000))
    x, y = np.unique(np.concatenate([a, shared])), np.unique(np.concatenate([b, shared]))
    rx, ry, both = M.registers([x, y, np.union1d(x, y)])
    assert (np.maximum(rx, ry) == both).all()
    truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    est = M.estimates(np.array([(rx > ry).sum()]), np.array([(rx < ry).sum()]), np.array([float(len(x))]), np.array([float(len(y))]))
    assert abs(est[0] - truth) < 0.1


def test_the_slope_says_what_the_estimate_says():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (500, M.REGISTERS)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < rng.random((500, 1)), x, rng.integers(0, 3, x.shape)).astype(np.uint16)
    n_a, n_b = rng.integers(50, 60, 500).astype(float), rng.integers(50, 60, 500).astype(float)
    est = M.estimates((x > y).sum(1), (x < y).sum(1), n_a, n_b)
    low = 0.85 - M.MARGIN * np.sqrt(0.85 * 0.15 / M.REGISTERS)
    sure = abs(est - low) > 2e-3
    assert sure.sum() > 450 and (M.could_be(x, y, n_a, n_b, 0.85) == (est > low))[sure].all()


def test_bands():
    for j in (0.8, 0.85):
        r = M.rows_in_band(j)
        assert (1 - j**r) ** (M.REGISTERS // r) <= M.MOST_LOST < (1 - j ** (r + 1)) ** (M.REGISTERS // (r + 1))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in M.components(edges, 70).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and got[101] == got[100] == 100
