"""Substring deduplication against a plain loop."""

import hashlib
import random

import pytest

from siltmark.llm import substring

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for ch in text or "":
        if ch in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += ch
    return out + [word] * bool(word)


def brute(rows, window):
    """rows (key, text); a window goes where a smaller key has the same words in order; a null key has no part in it."""
    least = {}
    for key, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1 if key is not None else 0):
            at = tuple(w[k : k + window])
            least[at] = min(least.get(at, key), key)
    out = []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if key is not None else 0):
            if least[tuple(w[k : k + window])] < key:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("batch", [400, 4 << 20])
def test_edges(spark, monkeypatch, batch):
    """Nulls, empty and very long texts, ties, repeated rows, overlaps, windows at either end, columns with clashing names."""
    monkeypatch.setattr(substring.S, "batch_bytes", lambda df, least=0: batch)
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("abcde") + str(r.randrange(40)) for _ in range(n))
    passage, other = say(30), say(13)
    texts = [None, "", " \t\n", "one", passage, passage, other, say(12), say(5) + "\t" + passage + "\n" + say(5), passage + " " + passage, "x " * 100, "x " * 12, " ".join(words(passage)[5:25]), say(20_000) + " " + other, "é " * 30, "é " * 14]
    texts += [say(r.randrange(0, 20)) + " " + " ".join(words(passage)[r.randrange(0, 10) : r.randrange(15, 30)]) + " " + say(r.randrange(0, 20)) for _ in range(60)]
    rows = [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(4, passage), (4, passage), (2, other)]
    df = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], "doc_id long, text string, batch int, data int, n_words string").repartition(5)
    got = substring.remove_repeats(df, keep_text=True).collect()
    assert order([tuple(x)[:4] for x in got]) == order(brute(rows, 13))
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in got)


@pytest.mark.parametrize("window", [2, 5, 13, 14])
def test_other_windows(spark, window):
    r = random.Random(window)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randrange(0, 30)))) for k in range(40)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    assert order(map(tuple, got)) == order(brute(rows, window))


def test_no_documents(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
