import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def table(spark, tmp_path, rows, schema=SCHEMA):
    """A table that is read, with a column that no operator knows."""
    path = str(tmp_path / f"t{abs(hash(str(rows)))}")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def docs(spark, tmp_path, texts):
    """texts: (doc_id, text) pairs."""
    return table(spark, tmp_path, [(i, t, "en", None, len(t or ""), "x") for i, t in texts])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
