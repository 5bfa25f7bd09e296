"""The stages one by one, against brute force, and the whole chain."""

import re

import corpus_pipeline as cp
import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("".join(rng.choice(list("abdegilnorstu"), rng.integers(2, 9))) for _ in range(n))
    item = text(40)
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, text(80), "en", "a", 1) for i in range(10, 30)]
    rows += [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), None, None, None), (4, f"{text(30)} {item} {text(30)}", "en", "b", 1)]
    rows += [(5, f"write to me.33@mail.org {text(20)}", "en", "b", 1), (6, None, "en", "b", 0), (7, "12 34 !!", "en", "b", 0), (8, "", None, "b", 0)]
    rows += [(9, text(50), "en", "c", 1)] * 2
    return rows, item


def test_stages(spark, made, tmp_path):
    rows, item = made
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kept", "'x' AS lang_pred")
    ids = lambda d: sorted(r.doc_id for r in d.collect())

    one = cp.identify_language(spark, df, str(tmp_path))
    assert one.columns == cp.COLUMNS and ids(one) == sorted(r[0] for r in rows if r[1] and re.search("[a-z]", r[1]))
    two = cp.drop_near_duplicates(spark, one, str(tmp_path))
    assert two.columns == cp.COLUMNS and ids(two) == sorted({r.doc_id for r in one.collect()} - {2, 3})
    three = cp.drop_contaminated(spark, two, str(tmp_path))
    assert three.columns == cp.COLUMNS and ids(three) == [i for i in ids(two) if i != 4]
    four = cp.replace_personal_data(spark, three, str(tmp_path))
    text = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == cp.COLUMNS and "me.33@mail.org" not in text[5] and all(text[r.doc_id] == r.text for r in three.collect() if r.doc_id != 5)
    assert four.filter("n_chars <> length(text)").count() == 0
    five = cp.pack_sequences(spark, four, str(tmp_path)).collect()
    assert {r.doc_id for r in five} == set(text)
    assert all(sum(p.length for p in five if p.doc_id == r.doc_id) == r.doc_tokens for r in five)

    df.select(*cp.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, five))


def test_contamination_is_a_matter_of_text(spark, tmp_path):
    """Rows without an id go if contaminated; a clean row that shares an id with a contaminated one stays."""
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {item} it is"), (1, f"and {item}"), (1, "a clean text of that id"), (None, "a clean text"), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(i), str(t)) for i, t in rows[2:])


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_declared_stages():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"] and cp.ORACLE_SQL is None
