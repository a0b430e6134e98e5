"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank of frequency over the whole corpus, so that the commonest 256 take one byte and the
others two (or, in vocabularies of over 65,536 ids, up to four). Lengths go to control bytes of their own: eight
1-bit codes each, or four 2-bit codes. A reader looks a control byte up in a table of 256 rows for the widths and
places of its values, for all control bytes of a block at once in numpy.

A file holds blocks; a block is one record, a magic number, its documents' ids and token counts, control bytes and
data bytes. Documents are in ascending order of doc_id (nulls first) over the files, which are written by Spark, so
they can lie in any store and a lost task is simply run again. The table from ranks to ids lies beside them.

Null and empty texts have the end id alone. Repeated rows are written each, in an order of their own text's hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, pieces, table, texts
from .token_ids import encode, tokenizer

MAGIC = 0x3156524D
#: Tokens from which a block is closed.
BLOCK_TOKENS = 1 << 18


def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: widths of its values in bytes, and where they begin after the first."""
    per = 8 // bits
    widths = (np.arange(256)[:, None] >> (bits * np.arange(per))[None, :] & ((1 << bits) - 1)) + 1
    return widths, np.cumsum(widths, axis=1) - widths


TABLES = {bits: _tables(bits) for bits in (1, 2)}


def put_values(values: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned numbers."""
    per = 8 // bits
    width = 1 + (values >= 1 << 8) + ((values >= 1 << 16).astype(np.int64) + (values >= 1 << 24) if bits == 2 else 0)
    codes = np.zeros(-(-len(values) // per) * per, np.uint8)
    codes[: len(values)] = width - 1
    control = np.bitwise_or.reduce(codes.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8))[None, :], axis=1, dtype=np.uint8) if len(codes) else codes
    at = np.cumsum(width) - width
    data = np.zeros(int(width.sum()), np.uint8)
    for k in range(1 << bits if bits == 2 else 2):
        there = width > k
        data[at[there] + k] = (values[there] >> np.uint32(8 * k)) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def get_values(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The numbers again, by table lookup of the control bytes."""
    widths, within = TABLES[bits]
    width = widths[control]
    total = width.sum(axis=1)
    at = ((np.cumsum(total) - total)[:, None] + within[control]).reshape(-1)[:n]
    width = width.reshape(-1)[:n]
    out = data[at].astype(np.uint32)
    for k in range(1, 1 << bits):
        there = np.flatnonzero(width > k)
        out[there] |= data[at[there] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list, counts: np.ndarray, ranks: np.ndarray, bits: int) -> bytes:
    control, data = put_values(ranks, bits)
    head = np.array([MAGIC, len(doc_ids), len(ranks), len(control)], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype("<i8").tobytes(), null, control, data])


def read_block(raw: bytes, bits: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Documents' ids, token counts and the ranks of all their tokens."""
    magic, docs, n, size = np.frombuffer(raw, "<i8", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    names, counts = np.frombuffer(raw, "<i8", docs, 32).tolist(), np.frombuffer(raw, "<i8", docs, 32 + 8 * docs)
    null = np.frombuffer(raw, np.uint8, docs, 32 + 16 * docs)
    at = 32 + 17 * docs
    return [None if x else d for d, x in zip(names, null, strict=True)], counts, get_values(np.frombuffer(raw, np.uint8, size, at), np.frombuffer(raw, np.uint8, offset=at + size), n, bits)


def _code_bits(tokens: str) -> int:
    return 1 if tokenizer(tokens).get_vocab_size() <= 1 << 16 else 2


def _raw_blocks(docs: DataFrame, end_id: int, tokens: str, key: str, text: str) -> DataFrame:
    """Sorted documents as blocks of plain ids: part (in the order of ids), block, documents, counts, ids."""
    dtype = "<u2" if _code_bits(tokens) == 1 else "<u4"

    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, text, 4 << 20):
            names = batch.column(batch.schema.get_field_index(key)).to_pylist()
            got, first = encode(texts(batch, text), tokens)
            n = np.diff(first) + 1
            ids = np.insert(got, first[1:], end_id)
            ends = np.cumsum(n)
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_TOKENS)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names[a:b]], pa.list_(pa.int64())), pa.array([n[a:b].tolist()], pa.list_(pa.int64())), pa.array([ids[ends[a] - n[a] : ends[b - 1]].astype(dtype).tobytes()], pa.binary())],
                    names=["part", "block", "docs", "counts", "ids"],
                )
                block += 1

    ordered = docs.select(F.col(key).cast("bigint").alias(key), text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    return map_arrow(ordered, run, "part int, block int, docs array<bigint>, counts array<bigint>, ids binary")


def write_ids(docs: DataFrame, path: str, end_id: int = 2, tokens: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> None:
    """Write files of all documents' ids to path/blocks, and path/ranks, which gives the id of each rank."""
    spark, bits = docs.sparkSession, _code_bits(tokens)
    scratch, dtype, size = Scratch(spark, "ids"), "<u2" if bits == 1 else "<u4", tokenizer(tokens).get_vocab_size()
    raw = scratch.keep(_raw_blocks(docs, end_id, tokens, key, text))

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), dtype), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["id", "n"])

    counts = map_arrow(raw.select("ids"), count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a vocabulary at most
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    rank = np.zeros(size, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    box = spark.sparkContext.broadcast(rank)

    def code(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = write_block(r["docs"], np.array(r["counts"]), box.value[np.frombuffer(r["ids"], dtype)], bits)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([block], pa.binary())], names=["part", "block", "bytes"])

    spark.createDataFrame([(i, d) for i, d in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    map_arrow(raw, code, "part int, block int, bytes binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.free(raw)


def read_ids(spark: SparkSession, path: str, tokens: str = "word_bpe_49k.json", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Documents of written files: key, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids (little-endian)."""
    bits = _code_bits(tokens)
    id_of = np.zeros(tokenizer(tokens).get_vocab_size(), "<u4")
    for r in spark.read.parquet(f"{path}/ranks").collect():  # a vocabulary at most
        id_of[r.rank] = r.id
    box = spark.sparkContext.broadcast(id_of)

    def decode(batches):
        for batch in batches:
            for part, block, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                names, counts, ranks = read_block(raw, bits)
                got, ends = box.value[ranks], np.cumsum(counts)
                each = [got[b - n : b].tobytes() for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([part] * len(names), pa.int32()), pa.array([block] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(each, pa.binary())] * ids, names=["part", "block", key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    def size(batches):
        for batch in batches:
            n = [int(np.frombuffer(x[16:24], "<i8")[0]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["part", "block", "n"])

    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = map_arrow(blocks.select("part", "block", F.substring("bytes", 1, 32).alias("bytes")), size, "part int, block int, n bigint")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each file goes to one task here; blocks are summed within their file.
    files = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("_file"))
    starts = sizes.withColumn("_block", before(Window.partitionBy("part").orderBy("block"))).join(files, "part").select("part", "block", (F.col("_file") + F.col("_block")).alias("_at"))
    docs = map_arrow(blocks, decode, f"part int, block int, {key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)
    return docs.join(starts, ["part", "block"]).withColumn("start", F.col("start") + F.col("_at")).drop("part", "block", "_at")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').root}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
