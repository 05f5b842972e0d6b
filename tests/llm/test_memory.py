"""What one worker holds while it works on a batch of many texts, and after it."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import arrays as A
from turnloom.llm import jaccard as J
from turnloom.llm import language as L
from turnloom.llm import packing as P


class Rows:
    """Keeps the function that an operator gives to mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    filter = toDF = select
    columns, schema = ["text"], SimpleNamespace(fields=[])


def batch():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(2_500)]
    assert sum(map(len, texts)) > 4 << 20
    return pa.RecordBatch.from_pydict({"text": pa.array(texts)})


def peak_of(run, rows):
    run(iter([rows.slice(0, 10)]))  # tables that are made once
    tracemalloc.start()
    out = sum(b.num_rows for b in run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / (1 << 20)


def test_tokens_of_a_large_batch_in_little_memory(spark):
    rows = Rows()
    J._tokens(rows, 5, 80)
    out, peak = peak_of(rows.run, batch())
    assert out > 200_000
    assert peak < 60, peak


def test_language_of_a_large_batch_in_little_memory(spark):
    rows = Rows()
    L.identify(rows, ["a", "b"], np.random.default_rng(5).standard_normal((2, L.DIM)), [])
    out, peak = peak_of(rows.run, batch())
    assert out == 2_500
    assert peak < 20, peak


def test_pieces_of_a_large_batch_in_little_memory(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows, texts = Rows(), batch()
    P.pieces_of(rows, path, 1024)
    out, peak = peak_of(rows.run, texts.append_column("doc_id", pa.array(range(texts.num_rows))))
    assert out >= 2_500
    assert peak < 28, peak


def test_blocks_hand_back_what_is_free(monkeypatch):
    called = []
    monkeypatch.setattr(A, "_TRIM", called.append)
    sizes = [int(b.offs[-1]) for b in A.blocks([batch()], limit=1 << 19)]
    assert called == [0] and max(sizes) <= 1 << 19
    assert list(A.blocks([])) == [] and called == [0, 0]


def test_language_vectors_do_not_depend_on_blocks():
    rows = batch().slice(0, 400)
    whole = np.concatenate([L.bundles(b, 64, 3)[0] for b in A.blocks([rows])])
    parts = np.concatenate([L.bundles(b, 64, 3)[0] for b in A.blocks([rows], limit=1 << 16)])
    assert np.array_equal(whole, parts)
