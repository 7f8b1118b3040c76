"""The suffix array against sorting, and the operator against all windows."""

import glob
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from siltmark.llm import _shared as S, suffix
from siltmark.llm.queries import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(t):
    got = suffix.suffix_array(np.array(t, np.int64))
    assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_repeats():
    rng = np.random.default_rng(2)
    for t in ([1] * 500, [1, 2] * 300, np.tile(rng.integers(1, 200, 97), 9).tolist(), rng.integers(1, 1 << 30, 400).tolist()):
        assert suffix.suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(texts, length):
    count = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        count.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_op4(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:5] for r in QUERIES["op4_suffix_array_dedup"](spark, sf).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, brute([d["text"] for d in docs], 200))}


@pytest.mark.parametrize("batch", [900, 1 << 20])
def test_overlaps_and_edges(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage, long_ = word(60), word(150)
    texts = [None, "", "x", "a" * 300, "ab" * 100, "é" * 80, long_, long_, word(20) + long_ + word(20), long_[:50], passage * 3]
    texts += [word(r.randrange(0, 50)) + passage[r.randrange(0, 15) :] + word(r.randrange(0, 60)) for _ in range(60)]
    texts += [word(30) + long_[40:120] + passage + long_[:70] for _ in range(20)]
    schema = "doc_id long, text string, batch long, data int, n_bytes string"
    rows = [(k if k % 9 else None, t, 1, 2, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = sorted(tuple(x)[1:5] for x in suffix.remove_repeats(df, length=40).collect())
    assert got == sorted(brute(texts, 40))
    kept = suffix.remove_repeats(df, length=40, keep=["batch", "n_bytes"])
    assert kept.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "batch", "n_bytes_in"]
    assert suffix.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_memory_is_bounded(spark, monkeypatch, tmp_path):
    """A row group holds a few batches, batches do not grow with the input, and a part is sorted in arrays by slots of anchors."""
    r = random.Random(7)
    rows = [(k, r.randbytes(500_000).hex()) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    S.stage(docs, f"file://{tmp_path}/staged", 900_000)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/staged/*.parquet")]
    assert max(m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)) < 40 << 20
    monkeypatch.setattr(S, "batch_bytes", lambda *_: 1 / 0)  # by the plan's size
    taken, plain = [], suffix.equal_prefixes
    monkeypatch.setattr(suffix, "equal_prefixes", lambda text, *a: taken.append(len(text)) or plain(text, *a))
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 1)
    texts = [b"a%d" % (k % 50) * 40 for k in range(100)]
    known = [k % 7 == 0 for k in range(100)]
    head = np.array([100, *((len(x) * suffix.SLOTS + k % 50) << 1 | m for k, (x, m) in enumerate(zip(texts, known)))], np.int64)
    (said,) = suffix._sorter(60)(0, [head.tobytes() + b"".join(texts)])
    assert len(taken) == 50 and max(taken) <= 240 and S.unbits(said, sum(len(x) - 59 for x in texts)).all()
    repeated = [(k, str(k % 20) + "xy" * 90 + "z" * (k % 3)) for k in range(60)]
    got = sorted(tuple(x)[1:5] for x in suffix.remove_repeats(spark.createDataFrame(repeated, "doc_id long, text string"), length=40).collect())
    assert got == sorted(brute([t for _, t in repeated], 40))
