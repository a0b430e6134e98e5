"""Shared plumbing of the training-data operators: scratch tables and batch handling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.runtime import ship_package

#: Bytes of text that a task of the pipeline works on at once: its arrays are up to eighty times as large, and two tasks share an executor with the JVM.
PIECE = 1 << 20
#: Rows of an Arrow batch in the pipeline; the JVM holds a batch twice outside its heap, its buffers doubled as they grow, and Python once more.
ROWS = 512

_OWN: list[str] = []
_HELD: list[dict] = []


def held() -> dict:
    """A dictionary for what a worker process builds once a task, such as tables; emptied when the task ends."""
    _HELD.append({})
    return _HELD[-1]


def release() -> None:
    """Empty all held() and return free memory to the system, so that idle workers are small."""
    for x in _HELD:
        x.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it


def few_rows(spark: SparkSession) -> None:
    """From now on the session gives Python batches of ROWS rows at most; what is returned unwritten must run so too, so this stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:  # 0 or less is no limit
        spark.conf.set(name, str(ROWS))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow whose workers hold nothing between tasks."""
    ship_package(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, in any case, one for each stem."""
    used, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write df as Parquet and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._millrace_path = path  # type: ignore[attr-defined]
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._millrace_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """The column with '' for null."""
    got = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(got.cast(pa.large_string()), "")


def buffer_of(arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, each followed by a newline, and the offsets of the strings in them."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    joined = pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: ASCII lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after LOWER
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer_of() buffer, and the first word of each string (n + 1 numbers)."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = is_word[data]
    turn = np.flatnonzero(np.diff(flag))
    starts, ends = turn[::2], turn[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


_POW: dict[str, np.ndarray] = held()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n + 1:
        size = max(n + 1, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POW["up"], _POW["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    if len(up) > 1 << 23:
        _POW.clear()  # a very long text needed them
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, of whatever string; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out + np.uint64(k))


def tidy(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def annotate(df: DataFrame, make, fields: str, into: str, text: str = "text", most: int = 4 << 20, whole: bool = False) -> DataFrame:
    """df with a struct column `into`, replacing one of that name.

    make() runs once a task and returns a function from a large_string array (and, if `whole`, the batch) to the struct's columns, a dict.
    Every other column passes through as it is, whatever its name.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() != into.lower()])
    struct = _parse_datatype_string(fields)
    kind = to_arrow_type(struct)
    schema = StructType([*kept.schema.fields]).add(into, struct)

    def run(batches):
        fn = make()
        for batch in pieces(batches, text, most):
            got = fn(texts(batch, text), batch) if whole else fn(texts(batch, text))
            made = pa.StructArray.from_arrays([x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return map_arrow(kept, run, schema)
