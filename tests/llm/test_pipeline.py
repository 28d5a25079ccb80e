"""The pipeline, stage by stage, on a small table with planted cases."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from gridwright.llm import queries


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    item, passage = prose(25, "item"), prose(60, "passage")
    rows = {i: prose(120 + i, i) for i in range(30)}
    near = rows[3].split()
    near[50] = "changed"
    rows |= {40: rows[1], 41: " ".join(near), 42: prose(80, 42) + " " + item + " " + prose(80, 43), 43: " ".join(w + "###" for w in prose(60, 44).split()), 44: "too short"}
    for i in (5, 6, 7):
        rows[i] = rows[i] + "\n" + passage + "\n" + prose(50, 100 + i)
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item, passage


def test_stages(spark, folder):
    path, rows, item, passage = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert set(columns) <= set(docs.columns) and (name == "mixing" or docs.columns == columns)
    assert set(rows) - set(seen["quality_rules"]) == {43, 44}
    assert set(seen["quality_rules"]) - set(seen["simhash_near_dedup"]) == {40, 41}
    cut = seen["suffix_dedup"]
    assert all(passage[10:-10] not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in (5, 6, 7))
    assert all(cut[i].text == rows[i] for i in cut if i not in (5, 6, 7))
    assert set(cut) - set(seen["decontamination"]) == {42}
    size = {i: len(r.text.split()) for i, r in seen["decontamination"].items()}
    taken = Counter(r.doc_id for r in docs.collect())
    assert max(taken.values()) <= 2 and abs(sum(size[i] * n for i, n in taken.items()) - 1.5 * sum(size.values())) < 400


def test_run_is_the_stages(spark, folder):
    path, *_ = folder
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) for _ in range(2))
    assert first == again and first


def test_stages_on_awkward_rows(spark, folder, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, columns named like the operators' own, and no rows."""
    path, *_ = folder
    long = prose(20_000, "long")
    rows = [(1, None, "en", "a"), (None, prose(40, 1), None, None), (2, "", "en", "b"), (3, long, "en", "a"), (4, prose(30, 4), "de", "b"), (4, prose(30, 4), "de", "b"), (5, prose(30, 4), None, "a"), (6, prose(30, 6), "en", None), (6, prose(30, 7), "en", "b")]
    docs = spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 7, "x") for i, t, l, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, copy bigint, tid string")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, before, path)
        assert docs.columns[: len(before.columns)] == before.columns
        if name == "simhash_near_dedup":
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(None, rows[1][1]), (3, long), (4, rows[4][1]), (6, rows[7][1]), (6, rows[8][1])], key=str)
        assert stage(spark, before.limit(0), path).count() == 0
    assert {r.doc_id for r in docs.collect()} <= {None, 3, 4, 6} and "copy_" in docs.columns


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
