"""Each stage of the pipeline alone, on tables that a corpus should not have but may."""

import corpus_pipeline
import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, spans string, tokens string"
LONG = "the plain words of a text that is long and has the common words of its language in it " * 700


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def run(spark, tmp_path, name, rows):
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, "what is the answer to the question that nobody asks")], "item_id long, text string").write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), True, "r", "s", "t") for i, t in rows], CLASH)
    return stage(name)(spark, docs, sf_dir)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, tmp_path, name):
    got = run(spark, tmp_path, name, [])
    assert got.count() == 0
    assert name == corpus_pipeline.STAGES[-1][0] or got.columns == list(corpus_pipeline.COLUMNS)


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


ODD = [(1, None), (2, ""), (None, "a short one"), (None, None), (3, LONG), (4, "another text"), (4, "another text")]


def test_odd_rows_in_decontamination(spark, tmp_path):
    planted = (5, "before it: what is the answer to the question that nobody asks, and after it")
    assert rows_of(run(spark, tmp_path, "benchmark decontamination", [*ODD, planted])) == sorted(ODD, key=str)


def test_odd_rows_in_quality(spark, tmp_path):
    # too few words or, in the long one, too many repeated ones
    assert rows_of(run(spark, tmp_path, "quality rules", ODD)) == []


def test_odd_rows_in_near_duplicates(spark, tmp_path):
    got = rows_of(run(spark, tmp_path, "n-gram Jaccard join", [*ODD, (6, LONG + "and more")]))
    assert got == sorted(ODD[:-1], key=str)


def test_odd_rows_in_suffix_dedup(spark, tmp_path):
    text = "".join(chr(97 + (k * k + k // 7) % 23) for k in range(260))
    got = rows_of(run(spark, tmp_path, "suffix-array dedup", [*ODD[:3], *ODD[5:], (7, "x" + text), (None, text + " y"), (8, text), (8, text)]))
    assert got == sorted([(1, ""), (2, ""), (None, "a short one"), (4, "another text"), (4, "another text"), (7, "x"), (None, " y")], key=str)


def test_odd_rows_in_encoding(spark, tmp_path):
    got = run(spark, tmp_path, "BPE encoding and decoding", ODD).collect()
    assert sorted((str(r.doc_id), r.n_tokens == 0) for r in got) == sorted((str(i), not t) for i, t in ODD)
