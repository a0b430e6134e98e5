"""Readers and writers of records: JSON lines, CSV, dictionaries, splits with a manifest, profiles, vectors, feedback, reports.

Readers keep what is well formed and count or refuse the rest; nothing is dropped without a number.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

SPLIT = "question string, sql string, difficulty string, template_id string, source string, schema string, tables array<string>"
BENCHMARK = "id string, question string, difficulty string, expect string, gold_sql string, sql string, tables array<string>, tags array<string>"
POOL = "question string, sql string, difficulty string, schema_name string, masked_question string, sql_skeleton string, source string"
ROUTING = "id string, tier string, difficulty string, variant string, features map<string,double>, label int"
#: Bytes of feedback from which no more is taken.
FEEDBACK_BYTES = 5 << 20


@dataclass
class Read:
    """Rows, and those lines that weren't taken."""

    rows: DataFrame
    rejected: DataFrame


def _lines(spark: SparkSession, path: str, schema: str, good: Column | None = None) -> Read:
    """JSON lines of a schema; blank lines and lines that begin with # are passed over, malformed ones are rejected."""
    kind: StructType = _parse_datatype_string(schema)
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parsed = text.withColumn("r", F.from_json(F.col("value"), StructType([*kind.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fine = F.col("r._bad").isNull() & F.col("value").rlike(r"^\s*\{")
    if good is not None:
        fine = fine & F.coalesce(good, F.lit(False))
    return Read(parsed.where(fine).select(*[f"r.{f.name}" for f in kind.fields]), parsed.where(~fine).select(F.col("value").alias("line")))


def _filled(name: str) -> Column:
    return F.length(F.trim(F.col(f"r.{name}"))) > 0


def read_benchmark(spark: SparkSession, path: str) -> Read:
    """Benchmark items; rows of a corpus split are taken too, their sql as gold_sql, and items without `expect` expect an answer."""
    got = _lines(spark, path, BENCHMARK, _filled("question"))
    return Read(got.rows.withColumn("gold_sql", F.coalesce("gold_sql", "sql")).withColumn("expect", F.coalesce("expect", F.lit("ok"))).drop("sql"), got.rejected)


def read_split(spark: SparkSession, path: str) -> Read:
    return _lines(spark, path, SPLIT, _filled("question") & _filled("sql"))


def read_pool(spark: SparkSession, path: str) -> Read:
    return _lines(spark, path, POOL, _filled("question") & _filled("sql"))


def read_routing(spark: SparkSession, path: str) -> Read:
    return _lines(spark, path, ROUTING, F.col("r.features").isNotNull() & F.col("r.label").isin(0, 1))


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Rows of another benchmark, from CSV (with or without a byte order mark), JSON lines or one JSON array: db_id, question, query.

    A row without any of the three is an error, not a row less.
    """
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    else:
        raw = spark.read.option("multiLine", path.endswith(".json")).json(path)
    names = {c.lower(): c for c in raw.columns}
    if missing := [c for c in ("db_id", "query") if c not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    said = [F.col(names[c]) for c in ("question_ko", "question") if c in names]
    rows = raw.select(F.col(names["db_id"]).alias("db_id"), F.coalesce(*said, F.lit(None).cast("string")).alias("question"), F.col(names["query"]).alias("query"))
    empty = F.lit(False)
    for c in rows.columns:
        empty = empty | F.coalesce(F.trim(c) == "", F.lit(True))
    if n := rows.where(empty).count():
        raise ValueError(f"{n} rows of {path} lack a database, a question or a query")
    return rows


# --- dictionaries


def ddl_comments(ddl: str) -> list[tuple[str, str, str]]:
    """(table, column or '', comment) of the comments that end the lines of CREATE TABLE statements."""
    out, table = [], ""
    for line in ddl.split("\n"):
        body, _, said = line.partition("--")
        if m := re.match(r"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?(\w+)", body, re.I):
            table, name = m[1], ""
        elif re.match(r"\s*\)", body):
            table = ""
            continue
        else:
            name = m[1] if (m := re.match(r"\s*[\"`]?(\w+)[\"`]?\s+\w", body)) else ""
            if not name or name.upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"):
                continue
        if table and said.strip():
            out.append((table, name, said.strip()))
    return out


def overlaid(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """catalog (table_name, column_name, comment) with the dictionary's comments in place of its own, in any case of names."""
    low = lambda c: F.lower(F.col(c))
    d = dictionary.select(low("table_name").alias("t"), low("column_name").alias("c"), F.col("comment").alias("said")).dropDuplicates(["t", "c"])
    met = catalog.join(d, (low("table_name") == F.col("t")) & (low("column_name") == F.col("c")), "left")
    return met.withColumn("comment", F.coalesce("said", "comment")).drop("t", "c", "said")


# --- sinks


def write_splits(rows: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Write JSON lines, a folder for each split, and a manifest of their rows beside them; returns the manifest."""
    rows.write.partitionBy(split).json(f"{path}/rows")
    back = rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows")
    manifest = back.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(c for c in rows.columns if c != split)).cast("decimal(38,0)")).cast("string").alias("digest"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def fingerprint(schema: dict[str, list[tuple[str, str]]], counts: dict[str, int]) -> str:
    """16 digits that change with tables, columns, types and numbers of rows."""
    said = json.dumps([[t, sorted(map(list, c)), counts.get(t)] for t, c in sorted(schema.items())])
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def cached_profile(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """A profile that is made once for a fingerprint and read afterwards."""
    path = f"{folder}/profile-{key}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(hadoop).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """id, text, vector and meta (a map) of a store."""
    vectors.select("id", "text", F.col("vector").cast("array<float>"), "meta").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if width and rows.where(F.size("vector") != width).limit(1).count():
        raise ValueError(f"not all vectors of {path} have {width} numbers")
    return rows


def append_feedback(spark: SparkSession, path: str, rows: list[tuple[str, int, str]], off: bool = False, most: int = FEEDBACK_BYTES) -> bool:
    """Append (question, rating, note); False, and nothing is written, where it is off or the folder holds `most` bytes."""
    if off:
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getContentSummary(at).getLength() >= most:
        return False
    spark.createDataFrame(rows, "question string, rating int, note string").coalesce(1).write.mode("append").json(path)
    return True


def report(title: str, totals: dict[str, float], groups: DataFrame) -> tuple[str, str]:
    """An evaluation as Markdown and as JSON; groups has a row for each line of its table."""
    rows = [r.asDict() for r in groups.orderBy(groups.columns[0]).collect()]  # as many as groups
    shown = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", *(f"- {k}: {shown(v)}" for k, v in totals.items()), "", "| " + " | ".join(groups.columns) + " |", "|" + "---|" * len(groups.columns), *("| " + " | ".join(shown(r[c]) for c in groups.columns) + " |" for r in rows)]
    return "\n".join(lines) + "\n", json.dumps({"title": title, "totals": totals, "groups": rows}, ensure_ascii=False, default=str)
