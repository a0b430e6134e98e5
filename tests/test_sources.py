import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import records


def test_lines_are_taken_or_rejected(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('# comment\n\n{"id": "1", "question": "q", "gold_sql": "SELECT 1", "tags": ["a"]}\n{"question": "r", "sql": "SELECT 2", "expect": "blocked"}\n{"question": " "}\nnot json\n{"question": "cut\n')
    got = records.read_benchmark(spark, str(p))
    assert sorted((r.question, r.gold_sql, r.expect) for r in got.rows.collect()) == [("q", "SELECT 1", "ok"), ("r", "SELECT 2", "blocked")]
    assert got.rejected.count() == 3
    assert records.read_split(spark, str(p)).rows.count() == 1 and records.read_pool(spark, str(p)).rejected.count() == 4
    p.write_text('{"id": "1", "features": {"a": 1.5}, "label": 1}\n{"id": "2", "features": {"a": 1}, "label": 3}\n[1]\n')
    got = records.read_routing(spark, str(p))
    assert [r.features for r in got.rows.collect()] == [{"a": 1.5}] and got.rejected.count() == 2


def test_external_rows_are_whole(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿db_id,question_ko,query\nx,몇 건,SELECT 1\ny,\"두\n줄\",\"SELECT \"\"a\"\"\"\n".encode())
    assert sorted(map(tuple, records.read_external(spark, str(p)).collect())) == [("x", "몇 건", "SELECT 1"), ("y", "두\n줄", 'SELECT "a"')]
    (tmp_path / "a.json").write_text(json.dumps([{"db_id": "x", "question": "q", "query": "SELECT 1"}]))
    assert records.read_external(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.jsonl").write_text('{"db_id": "x", "question": "q", "query": ""}\n')
    with pytest.raises(ValueError):
        records.read_external(spark, str(tmp_path / "b.jsonl"))


def test_dictionaries(spark):
    ddl = "CREATE TABLE TB_A ( -- 고객\n  ID TEXT PRIMARY KEY, -- 번호\n  NM TEXT, -- 이름\n  PRIMARY KEY (ID) -- none\n);\nCREATE TABLE B (\n X INTEGER\n);\n"
    assert records.ddl_comments(ddl) == [("TB_A", "", "고객"), ("TB_A", "ID", "번호"), ("TB_A", "NM", "이름")]
    catalog = spark.createDataFrame([("TB_A", "ID", "번호"), ("TB_A", "NM", None)], "table_name string, column_name string, comment string")
    extra = spark.createDataFrame([("tb_a", "nm", "성명")], catalog.schema)
    assert sorted(map(tuple, records.overlaid(catalog, extra).collect())) == [("TB_A", "ID", "번호"), ("TB_A", "NM", "성명")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "s1", "train"), ("q2", "s2", "train"), ("q3", "s3", "test")], "question string, sql string, split string")
    manifest = records.write_splits(rows, str(tmp_path / "split"))
    assert {r.split: r.n for r in manifest.collect()} == {"train": 2, "test": 1}
    assert records.read_split(spark, str(tmp_path / "split/rows/split=train")).rows.count() == 2
    made = []
    for _ in range(2):
        got = records.cached_profile(spark, str(tmp_path), records.fingerprint({"t": [("a", "int")]}, {"t": 3}), lambda: made.append(1) or rows)
        assert got.count() == 3
    assert made == [1] and records.fingerprint({"t": [("a", "int")]}, {"t": 4}) != records.fingerprint({"t": [("a", "int")]}, {"t": 3})
    vectors = spark.createDataFrame([("a", "x", [1.0, 2.0], {"k": "v"})], "id string, text string, vector array<double>, meta map<string,string>")
    records.write_vectors(vectors, str(tmp_path / "v"))
    assert records.read_vectors(spark, str(tmp_path / "v"), 2).first().vector == [1.0, 2.0]
    with pytest.raises(ValueError):
        records.read_vectors(spark, str(tmp_path / "v"), 3)
    path = str(tmp_path / "feedback")
    assert records.append_feedback(spark, path, [("q", 1, "")]) and not records.append_feedback(spark, path, [("q", 1, "")], off=True)
    assert not records.append_feedback(spark, path, [("q", 1, "")], most=1) and spark.read.json(path).count() == 1
    md, js = records.report("run", {"rate": 0.5}, rows.groupBy("split").agg(F.count("*").alias("n")))
    assert "| test | 1 |" in md and json.loads(js)["groups"][0] == {"split": "test", "n": 1}
