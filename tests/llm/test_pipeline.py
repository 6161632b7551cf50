"""The pipeline's stages, each on what the one before kept, against brute force; and that the rest does without."""

import os
import random
import shutil
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from lattica.llm import toxicity as tox
from tests.llm.conftest import frame
from tests.llm.test_dups import brute
from tests.llm.test_native import counts
from tests.llm.test_tokens import check_packing


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """Documents with toxic ones, junk and copies; some labels."""
    full = tox.Model.fit
    monkeypatch.setattr(tox.Model, "fit", lambda self, texts, labels: full(self, texts, labels, steps=100))
    rng = random.Random(12)
    rows = []
    for k in range(240):
        w = [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(rng.randrange(70, 120))]
        if k % 4 == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scum"])
        if k % 10 == 2:
            w = [x + "###" for x in w]
        if k % 10 == 3 and rows:
            w = rows[-3][1].split()
            w[0] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "short"), (None, rows[0][1])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 10 != 2), int(k % 4 == 1)) for k in range(240) if k % 10 != 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    clean = pipeline.without_toxic(spark, docs, path)
    assert clean.columns == columns
    kept = {r.doc_id for r in clean.collect()}
    assert not kept & {k for k in range(240) if k % 4 == 1 and k % 10 != 3} and len(kept) > 150
    good = pipeline.without_bad(spark, docs, path)
    assert good.columns == columns
    texts = dict(rows)
    for r in good.collect():
        assert not counts(r.text)[-1] and "###" not in r.text
    apart = pipeline.without_copies(spark, docs, path)
    assert apart.columns == columns
    assert sorted((r.doc_id for r in apart.collect()), key=repr) == stays(rows)[0]
    assert texts


def stays(rows):
    """Brute force over rows: one of each group of similar texts, the least id, one without an id only where none has one."""
    numbered = brute([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    groups = {}
    for k, n, group, _ in numbered:
        groups.setdefault(group if n else ("blank", k), []).append(rows[k])
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()), key=repr), len(groups)


def test_one_row_of_each_group_stays(spark, odd_rows):
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(4)]
    near = "changed " + texts[0].split(" ", 1)[1]
    rows = [(9, texts[0]), (5, near), (5, near), (5, texts[1]), (7, texts[1]), (7, texts[1]), (None, texts[0]), (None, near), (None, texts[2]), (None, texts[2]), (3, ""), (3, ""), (4, ""), (6, texts[3])]
    for some in (rows, rows[::-1], [(1, texts[0]), (1, texts[0]), (2, texts[0]), (None, texts[0]), (None, texts[0])], odd_rows, odd_rows + rows):
        got = [(r.doc_id, r.text) for r in pipeline.without_copies(spark, frame(spark, some), "").collect()]
        ids, n = stays(some)
        assert sorted((i for i, _ in got), key=repr) == ids and len(got) == n
    assert {t for i, t in got if i is None} >= {texts[2]}


def test_stages_of_odd_and_empty_tables(spark, folder, odd_rows):
    path, _ = folder
    for name, stage in pipeline.STAGES:
        none = stage(spark, frame(spark, []), path)
        assert none.collect() == []
        got = stage(spark, frame(spark, odd_rows), path)
        if name != "packing":
            assert got.columns == none.columns == frame(spark, []).columns
            assert {(r.doc_id, r.text) for r in got.collect()} <= set(odd_rows)
    clean = pipeline.without_toxic(spark, frame(spark, odd_rows + odd_rows), path)
    assert clean.count() == 2 * pipeline.without_toxic(spark, frame(spark, odd_rows), path).count()
    assert {r.doc_id for r in pipeline.without_bad(spark, frame(spark, odd_rows), path).collect()} <= {6}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    out = [tuple(r) for r in pipeline.run(spark, path).collect()]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    left = {r[0] for r in out}
    check_packing(out, {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in rows if i in left})
    assert 1001 not in left and len(left) > 80


def test_the_rest_does_without(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(top, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_single' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
