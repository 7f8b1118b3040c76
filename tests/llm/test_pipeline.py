"""The pipeline's stages, each against a plain version on its own input."""

import pyarrow.parquet as pq
import pytest
from test_jaccard import brute as components
from test_suffix import brute as suffix_rows

import corpus_pipeline as cp
from siltmark.llm import _shared as S

COLUMNS = list(cp.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    root = S.shared_root(spark)
    for k, (name, f) in enumerate(cp.STAGES):
        docs = S.materialised(f(spark, docs, sf), f"{root}/{k}")
        out.append((name, docs, docs.collect()))
    return sf, out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages[1]] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mix", "best_fit_packing"]
    for _, df, _ in stages[1][:-1]:
        assert sorted(df.columns) == sorted(COLUMNS)


def test_clean_documents_stay_and_toxic_go(stages):
    sf, out = stages
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    kept = {r.doc_id for r in out[0][2]}
    docs = [r["doc_id"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    clean = [d for d in docs if labels.get(d) == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_one_of_each_component(stages):
    before, after = stages[1][0][2], stages[1][1][2]
    want = {key for key, _, c in components([(r.doc_id, r.text) for r in before]) if key == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_repeats_are_cut(stages):
    before, after = stages[1][1][2], {r.doc_id: r for r in stages[1][2][2]}
    for r, (n, lost, _, _) in zip(before, suffix_rows([r.text for r in before], 200)):
        if not lost:
            assert after[r.doc_id].text == r.text
        elif r.doc_id in after:
            assert abs(len(after[r.doc_id].text.encode()) - (n - lost)) <= 8 and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert n - lost < 40


def test_mix_repeats_whole_documents(stages):
    before, after = {r.doc_id: r for r in stages[1][2][2]}, stages[1][3][2]
    count = {}
    for r in after:
        assert r.text == before[r.doc_id].text
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 3
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - words(before.values())) <= 0.15 * words(before.values())


def test_packing_holds_every_copy(stages):
    rows = stages[1][4][2]
    assert sum(r.piece == 0 for r in rows) == len(stages[1][3][2])
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_empty_and_null_documents_pass(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame([(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "x y z", "en", None, 5), (3, "x y z", "en", None, 5), (None, "q", "en", "a", None)], schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).count() >= 1
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert cp.run(spark, sf).count() == 0


def test_repeated_ids_with_other_texts_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (3, a), (4, ""), (4, ""), (5, None), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.one_of_each_group(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, c), (4, ""), (5, None), (None, a)], key=str)
