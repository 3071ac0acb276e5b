"""The pipeline's stages against brute-force versions on a small folder of tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_base, brute_components, tiktoken_encoding, unpack, vocabulary  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, words = random.Random(21), vocabulary(2500, 21)
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    item = text(40)
    rows = [(i, " ".join(text(150))) for i in [*range(60), *range(1000, 1300)]]
    rows += [(100, rows[3][1]), (101, " ".join([*rows[3][1].split()[:-1], "other"])), (102, rows[3][1] + " card 4041894974608795"), (-5, rows[9][1])]
    rows += [(200, " ".join(text(60) + item + text(60))), (201, " ".join(text(30))), (202, "same words again " * 80), (203, None), (204, ""), (205, " ".join(text(100)) + " mail ab.cd@mail.example.com")]
    docs = [(i, t, "xx", "s", None if t is None else len(t), "clash") for i, t in rows]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_does_its_work(spark, folder, tmp_path, tiktoken_encoding):  # noqa: F811
    steps = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, before, folder).write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        steps[name] = before
        if name != "byte_bpe":
            assert sorted(before.columns) == sorted(docs.columns)
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in steps.items()}
    start = {r.doc_id: r.text for r in docs.collect()}

    assert texts["quality_rules"] == {i: t for i, t in start.items() if not brute_base(t)[-1]}

    groups = brute_components(list(texts["quality_rules"].items()), 5, 80)
    assert set(texts["near_duplicates"]) == {i for i, _, c in groups if i == c}
    assert 3 in texts["near_duplicates"] and -5 in texts["near_duplicates"] and not {9, 100, 101, 102} & set(texts["near_duplicates"])

    assert set(texts["decontamination"]) == set(texts["near_duplicates"]) - {200}

    changed = {i for i, t in texts["pseudonyms"].items() if t != start[i]}
    assert changed == {205} and "ab.cd@" not in texts["pseudonyms"][205] and texts["pseudonyms"][205].endswith("@mail.example.com")

    assert texts["byte_bpe"] == texts["pseudonyms"]
    for r in steps["byte_bpe"].collect():
        assert unpack(bytes(r.ids)) == tiktoken_encoding.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4


def test_run_applies_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 300


def test_no_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
