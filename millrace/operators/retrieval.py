"""Text and vector retrieval: BM25, hashing vectors, cosine search, fusion of signals, diverse selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import cosine, embed, features, fnv1a, terms, terms_sql
from ..plans.runtime import ship_package
from ..registry import Tables, query

QUESTION = ["the", "and", "license"]
K1, B = 1.2, 0.75


def _same(words: str, q: str):
    return F.filter(words, lambda w: w == q)


def bm25(docs: DataFrame, question: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of the documents with a term of the question. Only the question's terms leave the scan."""
    words = docs.select(key, terms(F.col(text)).alias("ws")).withColumn("len", F.size("ws"))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    tf = words.select(key, "len", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.size(_same("ws", q)).alias("tf")) for q in question])).alias("x")).select(key, "len", "x.q", "x.tf").where("tf > 0")
    df = tf.groupBy("q").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the question
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(df), "q").join(F.broadcast(size)).groupBy(key).agg(F.sum(part).alias("score"))


_BM25 = f"""WITH w AS (SELECT doc_id, {terms_sql('text')} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT doc_id, len(ws) AS dl, q, len(list_filter(ws, lambda x: x = q)) AS tf FROM w, (VALUES {', '.join(f"('{q}')" for q in QUESTION)}) AS v(q)),
df AS (SELECT q, count(*) AS df FROM tf WHERE tf > 0 GROUP BY q)
SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / mean))) AS score FROM tf JOIN df USING (q), s WHERE tf > 0 GROUP BY doc_id"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_BM25}) ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_topk(t):
    return bm25(t.documents, QUESTION).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 100")
def term_frequencies(t):
    # Counts inside a document first, so a common word is one row a document.
    w = t.documents.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")).where("df >= 100")


@query()
def hashing_embed(t, dim: int = 64):
    ship_package(t.spark)

    @F.pandas_udf("array<double>")
    def vector(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embed(x or "", dim).tolist())

    return t.conversations.select("conv_id", "turn", vector("text").alias("vector"))


@query()
def bucket_idf(t, dim: int = 64):
    """ln((N + 1) / (df + 1)) + 1 of each feature bucket."""
    ship_package(t.spark)

    @F.pandas_udf("array<int>")
    def buckets(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted({fnv1a(f.encode()) % dim for f in features(x or "")}))

    n = t.conversations.count()
    df = t.conversations.select(F.explode(buckets("text")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return df.select("bucket", "df", F.round(F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1, 6).alias("idf"))


_COS = "(SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0))"


def nearest_vectors(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))  # the one question vector
    return t.embeddings.join(F.broadcast(q)).select("vec_id", "label", cosine(F.col("embedding"), F.col("q")).alias("score"))


@query(f"SELECT vec_id, round(score, 5) AS score FROM {_COS} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(t):
    return nearest_vectors(t).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round(score, 5) AS score FROM {_COS} WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(t):
    return nearest_vectors(t).where(F.col("label").isin(1, 2)).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 5).alias("score"))


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS INT) AS label FROM embeddings")
def vector_upsert(t):
    """The last write of each id wins."""
    old = t.embeddings.select("vec_id", "label", F.lit(0).alias("version"))
    new = t.embeddings.where("vec_id % 10 = 0").select("vec_id", F.lit(-1).alias("label"), F.lit(1).alias("version"))
    return old.unionAll(new).groupBy("vec_id").agg(F.max_by("label", "version").alias("label"))


def standardise(df: DataFrame, col: str, out: str) -> DataFrame:
    """The positive part of the z-score, over its greatest."""
    s = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"), F.max(col).alias("_x"))  # one row
    z = F.greatest((F.col(col) - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0))
    top = F.nullif(F.greatest((F.col("_x") - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return df.join(F.broadcast(s)).withColumn(out, F.coalesce(z / top, F.lit(0.0))).drop("_m", "_s", "_x")


_NORM = "coalesce(greatest((x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0), 0) / nullif(greatest((max(x) OVER () - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0), 0), 0), 0)"


@query(f"SELECT doc_id, round({_NORM}, 6) AS score FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x FROM documents)")
def signal_normalise(t):
    return standardise(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("x")), "x", "s").select("doc_id", F.round("s", 6).alias("score"))


@query(f"WITH b AS (SELECT doc_id, {_NORM.replace('(x', '(score')} AS lexical FROM ({_BM25})), a AS (SELECT doc_id, {_NORM} AS dense FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x FROM documents)) SELECT doc_id, round(0.5 * dense + 0.5 * coalesce(lexical, 0), 6) AS score FROM a LEFT JOIN b USING (doc_id)")
def hybrid_fusion(t):
    lexical = standardise(bm25(t.documents, QUESTION), "score", "lexical").select("doc_id", "lexical")
    dense = standardise(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("x")), "x", "dense").select("doc_id", "dense")
    return dense.join(lexical, "doc_id", "left").select("doc_id", F.round(0.5 * F.col("dense") + 0.5 * F.coalesce("lexical", F.lit(0.0)), 6).alias("score"))


_VALS = ["small ring", "red", "widget", "zzz"]


@query(f"SELECT q, max(CASE WHEN p_name = q THEN 1.0 WHEN list_contains(string_split(p_name, ' '), q) THEN 0.9 WHEN contains(p_name, q) THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM (SELECT DISTINCT p_name FROM part), (VALUES {', '.join(f'({v!r})' for v in _VALS)}) AS v(q) GROUP BY q")
def value_linking(t):
    q = F.explode(F.array(*[F.lit(v) for v in _VALS])).alias("q")  # the question's few candidates
    x = t.part.select("p_name").distinct().select("p_name", q)
    score = F.when(F.col("p_name") == F.col("q"), 1.0).when(F.array_contains(F.split("p_name", " "), F.col("q")), 0.9).when(F.contains("p_name", "q"), 0.5).otherwise(0.0)
    return x.groupBy("q").agg(F.max(score).alias("score"))


#: Terms and their other spellings.
GLOSSARY = {"licence": ["license", "licensed"], "version": ["version"], "public": ["public license", "public"]}


@query("SELECT doc_id, term FROM documents, (VALUES ('licence', 'license'), ('licence', 'licensed'), ('version', 'version'), ('public', 'public license'), ('public', 'public')) AS v(term, s) WHERE contains(lower(text), s) GROUP BY 1, 2")
def glossary_match(t):
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(s)) for s in ss], F.lit(False)), F.lit(term)) for term, ss in GLOSSARY.items()]), lambda x: x.isNotNull())
    return t.documents.select("doc_id", F.explode(hits).alias("term"))


def mmr(relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float = 0.4) -> list[int]:
    """k places by relevance less likeness to what was chosen; first ones win ties."""
    chosen: list[int] = []
    like = vectors @ vectors.T
    while len(chosen) < min(k, len(relevance)):
        worth = (1 - balance) * relevance - (balance * like[:, chosen].max(axis=1) if chosen else 0)
        worth[chosen] = -np.inf
        chosen.append(int(np.argmax(worth)))
    return chosen


@query()
def mmr_select(t, k: int = 5, pool: int = 50):
    """A top-k report: candidates are ranked in Spark, the few chosen ones picked from them."""
    top = nearest_vectors(t).orderBy(F.desc("score"), "vec_id").limit(pool).join(t.embeddings.select("vec_id", "embedding"), "vec_id").toPandas().sort_values(["score", "vec_id"], ascending=[False, True])
    v = np.array(top["embedding"].tolist(), dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    picked = mmr(top["score"].to_numpy(), v, k)
    return t.values("pos int, vec_id bigint", [(i, int(top["vec_id"].iloc[p])) for i, p in enumerate(picked)])
