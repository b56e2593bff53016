"""The text tree is written whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from repolens.sources import sinks as K

SCHEMA = "path string, new_text string"


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read()
            for d, _, files in os.walk(folder) for f in files}


def test_all_files_or_none(spark, tmp_path):
    rows = [(f".github/workflows/w{i}.yml", f"text é {i}") for i in range(40)]
    texts = spark.createDataFrame(rows, SCHEMA).repartition(4)
    target = str(tmp_path / "out")
    K.write_rewrites(texts, texts, target)
    assert tree(target) == dict(rows)
    K.write_rewrites(texts.withColumn("new_text", F.upper("new_text")), texts, target)
    assert tree(target) == {p: t.upper() for p, t in rows}
    before = tree(target)
    for bad in ("../outside.yml", "a/../../b", "", None, "_staging-x/y"):
        broken = texts.withColumn("new_text", F.lit("changed")).unionByName(spark.createDataFrame([(bad, "x")], SCHEMA))
        with pytest.raises(Exception, match="not a path inside"):
            K.write_rewrites(broken, texts, target)
        assert tree(target) == before
    failing = texts.withColumn("new_text", F.when(F.col("path").endswith("w7.yml"), F.raise_error(F.lit("lost")).cast("string")).otherwise("changed"))
    with pytest.raises(Exception, match="lost"):
        K.write_rewrites(failing, texts, target)
    assert tree(target) == before and os.listdir(target) == [".github"]


def test_two_texts_with_one_path(spark, tmp_path):
    texts = spark.createDataFrame([("a.yml", "1"), ("/a.yml", "2"), ("b.yml", "3")], SCHEMA).repartition(3)
    with pytest.raises(Exception, match="same path"):
        K.write_rewrites(texts, texts, str(tmp_path / "out"))
    assert tree(str(tmp_path / "out")) == {}


def test_keys_are_folders_and_empty_tables_write_nothing(spark, tmp_path):
    texts = spark.createDataFrame([("c1", "a.yml", "1"), ("c2", "a.yml", None)], "checkout string, " + SCHEMA)
    K.write_rewrites(texts, texts, str(tmp_path / "out"), keys=("checkout",))
    assert tree(str(tmp_path / "out")) == {"c1/a.yml": "1", "c2/a.yml": ""}
    K.write_rewrites(texts.filter("false"), texts, str(tmp_path / "none"), keys=("checkout",))
    assert tree(str(tmp_path / "none")) == {}


def test_two_writers_store_each_document_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    schema = "repo string, filename string, url string, notebook string, script string, blocks bigint"
    sets = [spark.createDataFrame([("r", f"{i}_t", "u", f"n{w}", f"s{w}", 1) for i in range(w, 30 + w)], schema).repartition(3) for w in (0, 5)]
    folder = str(tmp_path / "docs")
    with ThreadPoolExecutor(2) as pool:
        new = [f.result().collect() for f in [pool.submit(K.write_document_files, d, folder) for d in sets]]
    stored = tree(folder)
    assert set(stored) == {f"r/{i}_t.{k}" for i in range(35) for k in ("ipynb", "py")}
    for name, text in stored.items():  # whole texts of one of the writers that found it absent
        assert text in {r.content for rows in new for r in rows if r.name == name}
    assert [K.write_document_files(d, folder).count() for d in sets] == [0, 0] and tree(folder) == stored
    twice = sets[0].unionAll(sets[0].withColumn("script", F.lit("a")))
    assert K.write_document_files(twice, str(tmp_path / "twice")).count() == 60


def test_names_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    texts = spark.range(500).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), "id", F.lit(".md")).alias("path"),
                                    F.col("id").cast("string").alias("new_text")).repartition(3)
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr("repolens.sources.sinks.write_texts", K.write_texts)  # a function of Spark jobs: no commit message lists the names
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    K.write_rewrites(texts, texts, str(tmp_path / "out"))
    monkeypatch.undo()
    assert sum(map(len, seen)) == 0
    assert tree(str(tmp_path / "out")) == {f"d{i % 7}/{i}.md": str(i) for i in range(500)}
