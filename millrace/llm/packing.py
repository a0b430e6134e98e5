"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous steps.

Pieces and gaps are kept sorted by size. A superstep takes all pieces of the largest size left, sweeps the gaps
upwards from the successor of that size, gives gaps to pieces in order of rank where several want one, updates the
gaps, and goes on to the next size; sequences are opened where no gap is large enough. That is best-fit decreasing.

Sizes are token counts of at most the capacity, so the sorted pieces and gaps are runs of equal sizes: the sweep sees
a histogram of at most `capacity` rows and runs of sequences, however many documents there are. Ranks within a size
and the placing of every piece are distributed; a size that a third of all documents have is ranked in buckets.

Null and empty texts are one piece with the end id alone. Repeated rows are packed each. An empty table gives no
rows. Other columns don't pass through.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, pieces, table, texts
from .token_ids import encode

#: Rows of a plan that go to the tasks at once; a longer plan is applied in several passes.
PLAN_ROWS = 1 << 20


def cut(docs: DataFrame, capacity: int, end_id: int, tokenizer: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document: key, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian)."""
    schema = f"{key} {dict(docs.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids

    def run(batches):
        for batch in pieces(batches, text, 2 << 20):
            got, first = encode(texts(batch, text), tokenizer)
            n = np.diff(first) + 1
            all_ids = np.insert(got, first[1:], end_id).astype("<u4")
            begin = np.cumsum(n) - n
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at = begin[row] + start
            raw = [all_ids[a : a + k].tobytes() for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(batch.schema.get_field_index(key)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * ids, names=[key, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return map_arrow(docs.select(key, text), run, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over size classes: rows (size, first rank, pieces, first sequence, pieces a sequence, offset), and the sequences used."""
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []  # sizes of gaps that there are, sorted
    rows, used = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                opened = -(-left // (capacity // size))
                put(capacity, used, opened)
                used += opened
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            each = min(gap // size, left)
            n_full = min(n, left // each)
            rows.append((size, rank, n_full * each, first, each, capacity - gap))
            put(gap, first + n_full, n - n_full)
            put(gap - each * size, first, n_full)
            rank += n_full * each
            left -= n_full * each
    return np.array(rows, np.int64).reshape(-1, 6), used


def rank_in_size(cuts: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """cuts with a gapless rank (from 0) among the pieces of the same length; no task needs all pieces of a length."""
    spread = cuts.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = spread.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sums.select("length", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order)) - 1
    return spread.withColumn("_in", inside).join(before, ["length", "_b"]).withColumn("_rank", F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def place(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """Look every piece's size and rank up in the plan: sequence_id and offset replace the rank."""
    out = ranked.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    sc = ranked.sparkSession.sparkContext
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    for i in range(0, len(plan), PLAN_ROWS):
        box = sc.broadcast(plan[i : i + PLAN_ROWS])

        def run(batches, box=box):
            size, begin, n, first, each, offset = box.value.T
            keys = size << 40 | begin
            for batch in batches:
                get = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                length, rank = get("length"), get("_rank")
                at = np.maximum(np.searchsorted(keys, length << 40 | rank, side="right") - 1, 0)
                k = rank - begin[at]
                ok = (size[at] == length) & (k >= 0) & (k < n[at])
                sequence, where = first[at] + k // each[at], offset[at] + k % each[at] * length
                names, columns = list(batch.schema.names), list(batch.columns)
                for c, v in (("sequence_id", sequence), ("offset", where)):
                    j = names.index(c)
                    columns[j] = pc.if_else(pa.array(ok), pa.array(v, pa.int64()), columns[j])
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = map_arrow(out, run, out.schema)
    return out.drop("_rank")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; with ids=True also the ids that fill the sequences."""
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = scratch.keep(cut(docs, capacity, end_id, tokenizer, text, key, ids))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_best_fit(counts, capacity)
    buckets = max(32, sum(counts.values()) // 100_000)
    return place(rank_in_size(cuts, [key, "piece", "ids_crc32"], buckets), plan)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
