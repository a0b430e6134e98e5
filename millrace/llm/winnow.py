"""Benchmark decontamination by winnowing.

Training and test texts are both reduced to winnowed fingerprints: of the six 5-gram hashes in each window of 10 words
the least is kept, so that any shared run of k + w - 1 = 10 words shares a fingerprint. Fingerprints of documents are
joined with those of the benchmark; each hit is extended to the 10-word windows that have it, and these are joined with
the benchmark's windows word for word. No task holds the benchmark: its fingerprints go to the tasks as one sorted array
while they take PRINT_BYTES at most, and are joined by shuffling beyond that; its windows are always a joined table.

Nulls and texts without words hold nothing and are held by nothing. Items of 1 to 9 words can't carry such a
fingerprint; they form one window each, which is looked up by the hash of as many words. Equal texts are marked alike,
repeated rows each. Items of one id count once. An empty benchmark marks nothing, an empty table gives no rows. Columns
of documents pass through, whatever their names, but for one of the result's own name. A text takes some eighty times its bytes while its words are hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, PIECE, Scratch, buffer_of, fresh, gram_hashes, map_arrow, pieces, table, texts, word_hashes, word_spans

WINDOW, GRAM = 10, 5
#: Bytes of the benchmark's fingerprints up to which they are broadcast.
PRINT_BYTES = 16 << 20
#: A word, as the regular expressions of Java have it, upper case included.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


class Windows:
    """The windows of n words of some texts, for some n, and their fingerprints."""

    def __init__(self, arr: pa.LargeStringArray):
        data, self.offsets = buffer_of(arr)
        self.data = LOWER[data]
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets, ALNUM)
        self.hashes, self.n_words = word_hashes(self.data, self.starts, self.ends), np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def prints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of n words and their fingerprints; windows lie within a text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n == WINDOW:
            grams = gram_hashes(self.hashes, GRAM)
            h = grams[:m].copy()
            for j in range(1, WINDOW - GRAM + 1):
                np.minimum(h, grams[j : j + m], out=h)
        else:
            h = gram_hashes(self.hashes, n)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, h[at].view(np.int64)

    def words(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.starts[w] : self.ends[w]].tobytes() for w in range(at, at + n)).decode()


def test_windows(bench: DataFrame, item: str, text: str) -> DataFrame:
    """n, print, words and item of every window of the benchmark; short items are one window."""

    def run(batches):
        for batch in pieces(batches, "t", PIECE):
            names, w, rows = batch.column(0).to_pylist(), Windows(texts(batch, "t")), []
            for n in set(np.minimum(w.n_words, WINDOW).tolist()) - {0}:
                at, h = w.prints(n)
                here = np.minimum(w.n_words[w.doc[at]], WINDOW) == n
                rows += [(n, int(p), w.words(int(i), n), names[w.doc[i]]) for i, p in zip(at[here], h[here], strict=True)]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 20_000], strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["n", "print", "words", "item"])

    some = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return map_arrow(some, run, "n int, print bigint, words string, item string").distinct()


CANDIDATE = "d binary, n int, at bigint, start_byte bigint, end_byte bigint, words string"


def _candidates(rows: list, w: Windows, digests: list, n: int, at: np.ndarray) -> None:
    for i in at.tolist():
        k = int(w.doc[i])
        rows.append((digests[k], n, i - int(w.first[k]), int(w.starts[i] - w.offsets[k]), int(w.ends[i + n - 1] - w.offsets[k]), w.words(i, n)))


def _emit(rows: list):
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    for a in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 5000], strict=True), kinds, strict=True)], names=names)


def _met_in_tasks(docs: DataFrame, prints: np.ndarray, sizes: list[int]) -> DataFrame:
    """Windows (CANDIDATE) of documents (d, t) that have a fingerprint of the benchmark, which every task holds."""
    box = docs.sparkSession.sparkContext.broadcast(prints)  # PRINT_BYTES at most

    def run(batches):
        known = box.value
        for batch in pieces(batches, "t", PIECE):
            w, digests, rows = Windows(texts(batch, "t")), None, []
            for n in sizes:
                at, h = w.prints(n)
                hit = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                if len(hit):
                    digests = digests or batch.column(batch.schema.get_field_index("d")).to_pylist()
                    _candidates(rows, w, digests, n, hit)
            yield from _emit(rows)

    return map_arrow(docs, run, CANDIDATE)


def _met_by_join(docs: DataFrame, prints: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by a join of all documents' different fingerprints."""

    def sign(batches):
        for batch in pieces(batches, "t", PIECE):
            w, digests = Windows(texts(batch, "t")), batch.column(batch.schema.get_field_index("d"))
            for n in sizes:
                at, h = w.prints(n)
                order = np.lexsort((h, w.doc[at]))
                doc, h = w.doc[at][order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else order
                for a in range(0, len(new), 50_000):
                    k = new[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([digests.take(pa.array(doc[k])), pa.array(np.full(len(k), n), pa.int32()), pa.array(h[k])], names=["d", "n", "print"])

    def extend(batches):
        for batch in pieces(batches, "t", PIECE):
            w, rows, digests = Windows(texts(batch, "t")), [], batch.column(batch.schema.get_field_index("d")).to_pylist()
            known = [set(zip(x["n"], x["print"], strict=True)) for x in ({"n": [y["n"] for y in got], "print": [y["print"] for y in got]} for got in batch.column(batch.schema.get_field_index("hits")).to_pylist())]
            for n in sizes:
                at, h = w.prints(n)
                _candidates(rows, w, digests, n, at[[(n, p) in known[k] for p, k in zip(h.tolist(), w.doc[at].tolist(), strict=True)]] if len(at) else at)
            yield from _emit(rows)

    signed = map_arrow(docs, sign, "d binary, n int, print bigint").distinct()
    hits = signed.join(prints, ["n", "print"], "left_semi").groupBy("d").agg(F.collect_set(F.struct("n", "print")).alias("hits"))  # of one text
    return map_arrow(docs.join(hits, "d").dropDuplicates(["d"]), extend, CANDIDATE)


def _spans(hits: DataFrame) -> DataFrame:
    """d, spans (words that occur in test windows, merged) and items of each text with hits (d, n, at, start_byte, end_byte, item)."""
    one = F.struct(F.col("at").alias("start_word"), (F.col("at") + F.col("n")).alias("end_word"), "start_byte", "end_byte")
    got = hits.groupBy("d").agg(F.sort_array(F.collect_set(one)).alias("all"), F.sort_array(F.collect_set("item")).alias("items"))  # within one text
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start_word"] <= F.coalesce(F.get(acc, F.size(acc) - 1)["end_word"], F.lit(-1))),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(last(acc)["start_word"].alias("start_word"), F.greatest(last(acc)["end_word"], s["end_word"]).alias("end_word"), last(acc)["start_byte"].alias("start_byte"), F.greatest(last(acc)["end_byte"], s["end_byte"]).alias("end_byte"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return got.select("d", joined.alias("spans"), "items")


def mark_leaks(docs: DataFrame, bench: DataFrame, into: str = "leak", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a struct `into`: n_words, the spans of words that occur in test windows (in words and UTF-8 bytes), their items."""
    scratch = Scratch(docs.sparkSession, "leaks")
    windows = scratch.keep(test_windows(bench, item, item_text))
    prints = windows.select("n", "print").distinct()
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # 1 to WINDOW
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    some = docs.select(digest.alias("d"), F.col(text).alias("t"))
    if prints.limit(PRINT_BYTES // 8 + 1).count() <= PRINT_BYTES // 8:
        known = np.sort(np.array([r.print for r in prints.select("print").distinct().collect()], np.int64))
        met = _met_in_tasks(some, known, sizes) if sizes else None
    else:
        met = _met_by_join(some, prints, sizes)
    d, found, struct, size = fresh(docs.withColumn(into, F.lit(0)), "_d", "_found", "_struct", "_size")
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    none = F.from_json(F.lit("[]"), "array<struct<start_word:bigint,end_word:bigint,start_byte:bigint,end_byte:bigint>>")
    out = docs.drop(into) if into in docs.columns else docs
    if met is None:
        return out.withColumn(into, F.struct(n_words.alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items")))
    met = scratch.keep(met.distinct())
    spans = scratch.keep(_spans(met.join(windows, ["n", "words"]).select("d", "n", "at", "start_byte", "end_byte", "item")))
    # Words are counted before the join, so that the text is not shuffled for a result that has no text.
    marked = docs.withColumn(d, digest).withColumn(size, n_words).select(*[f"`{c}`" for c in out.columns], d, size).join(spans.select(F.col("d").alias(found), F.struct("spans", "items").alias(struct)), F.col(d) == F.col(found), "left")
    scratch.free(windows, met)
    return marked.withColumn(into, F.struct(F.col(size).alias("n_words"), F.coalesce(F.col(f"{struct}.spans"), none).alias("spans"), F.coalesce(F.col(f"{struct}.items"), F.array().cast("array<string>")).alias("items"))).drop(d, found, struct, size)


def remove_leaked(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Only the documents in which no test window occurs."""
    (name,) = fresh(docs, "_leak")
    return mark_leaks(docs, bench, name).where(F.size(f"{name}.spans") == 0).drop(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end_word"] - s["start_word"])
    return marked.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
