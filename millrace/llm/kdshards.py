"""Shards by k-d tree partitioning.

Rows with equal texts form a group, and the tree is grown over groups, with their bytes summed first. The tree starts with
all groups and as many leaves as there are shards (or as the target bytes ask for). A node with n leaves is split into
n // 2 and the rest along its widest metadata dimension, at the weighted quantile of bytes that gives each side its
share; with two halves that is the weighted median. A numeric dimension is as wide as its share of the whole range,
another one as its share of all different values. Quantiles are found by distributed histograms: a node's range is cut
into equal buckets, bytes are summed by bucket, the bucket with the quantile is cut again, and so on to a single value
and, where that is shared, to a place in the order of the groups' hashes. So a value that a third of the rows have is cut
like any other. Each pass brings two numbers a node to the driver; no row and no value is collected.

Equal texts stay in one shard, but for groups of over 1 / PARTS of a shard where a cut falls inside them: such a group
is kept as up to 4096 parts that follow each other, so that sizes of shards stay near equal whatever the copies. A group
has the least metadata of its rows.

Null texts have the size of an empty one and are a group with these. Null metadata is one value of its own. Repeated rows
are placed each. An empty table has no rows in any shard. Columns whose names clash don't matter. Sizes of shards differ by the bytes of the groups (of no more
than 1 / PARTS of a shard) or single texts at a cut at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Buckets of a histogram, as a power of 2; bits of the coordinate of a text column, of a group's hash and of its part.
BUCKET_BITS, HASH_BITS, GROUP_BITS, PART_BITS = 15, 22, 18, 12
#: A group with more bytes than this part of a shard may be cut.
PARTS = 64
#: Rows that a task numbers at once when slots are given.
SLOT_ROWS = 50_000


@dataclass
class Node:
    leaves: int
    first: int = 0
    dim: int = 0
    value: int = 0  # rows with less go left, rows with more right
    tie: int = 0  # rows with this value go left if their tie is less
    left: "Node | None" = None
    right: "Node | None" = None


def is_number(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")


def coordinate(df: DataFrame, name: str) -> Column:
    """A dimension as a whole number from 0: numbers as they are, other values by a hash that keeps equal ones together."""
    if is_number(df, name):
        return F.coalesce(F.greatest(F.col(name).cast("bigint"), F.lit(0)) + 1, F.lit(0))
    return F.when(F.col(name).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << HASH_BITS)) + 1)


def _path(node: Node, of, inner: bool = False) -> Column:
    """of(leaf) for the leaf that a row belongs to, as a column."""
    if node.left is None:
        return of(node)
    d = F.col(f"_d{node.dim}")
    goes_left = (d < node.value) | ((d == node.value) & (F.col("_tie") < node.tie))
    return F.when(goes_left, _path(node.left, of)).otherwise(_path(node.right, of))


def _quantiles(rows: DataFrame, root: Node, todo: list[Node], want: dict[int, int], low: dict[int, int], high: dict[int, int], key) -> tuple[dict[int, int], dict[int, int]]:
    """For each node the least key whose rows, with all below, weigh more than wanted; and the bytes below it.

    low and high bound the keys (high is not included); key(node) gives a row's key there.
    """
    below = {n.first: 0 for n in todo}
    while any(high[i] - low[i] > 1 for i in low):
        shift = {i: max(0, (high[i] - low[i] - 1).bit_length() - BUCKET_BITS) for i in low}
        number = _path(root, lambda n: F.lit(n.first))
        picked = lambda of: F.element_at(F.create_map(*[F.lit(x) for n in todo for x in (n.first, of(n))]), F.col("_n"))  # noqa: B023, E731
        at = rows.select(number.alias("_n"), "_w", _path(root, lambda n: key(n) if n in todo else F.lit(-1).cast("bigint")).alias("_k"))
        inside = at.where(F.col("_n").isin([n.first for n in todo]) & (F.col("_k") >= picked(lambda n: low[n.first])) & (F.col("_k") < picked(lambda n: high[n.first])))
        bucket = inside.groupBy("_n", F.expr(f"shiftright(_k - element_at(map({', '.join(f'{i}, {low[i]}L' for i in low)}), _n), element_at(map({', '.join(f'{i}, {shift[i]}' for i in low)}), _n))").alias("_b")).agg(F.sum("_w").alias("_s"))
        w = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        summed = bucket.withColumn("_c", F.sum("_s").over(w))
        room = F.element_at(F.create_map(*[F.lit(x) for i in low for x in (i, want[i] - below[i])]), F.col("_n"))
        found = summed.groupBy("_n").agg(
            F.min(F.when(F.col("_c") > room, F.struct("_b", (F.col("_c") - F.col("_s")).alias("_before")))).alias("hit"), F.max(F.struct("_b", (F.col("_c") - F.col("_s")).alias("_before"))).alias("last")
        )
        got = {r._n: r.hit or r.last for r in found.collect()}  # one row a node
        for i in low:
            if i not in got:
                high[i] = low[i] + 1
                continue
            low[i] += got[i]._b << shift[i]
            high[i] = min(high[i], low[i] + (1 << shift[i]))
            below[i] += got[i]._before
    return low, below


def grow(units: DataFrame, numeric: list[bool], leaves: int) -> Node:
    """The tree over rows with columns _d0.. (whole numbers from 0), _tie and _w; numeric: which dimensions are measured by their range."""
    root, dims = Node(leaves), range(len(numeric))
    spans = [c for i in dims for c in (F.min(f"_d{i}").alias(f"a{i}"), F.max(f"_d{i}").alias(f"b{i}"), *([] if numeric[i] else [F.approx_count_distinct(f"_d{i}").alias(f"k{i}")]))]
    width = lambda s: [s[f"b{i}"] - s[f"a{i}"] if numeric[i] else s[f"k{i}"] - 1 for i in dims]
    whole, level = None, [root]
    while todo := [n for n in level if n.leaves > 1]:
        number = _path(root, lambda n: F.lit(n.first))
        stats = {r._n: r for r in units.groupBy(number.alias("_n")).agg(F.sum("_w").alias("w"), *spans).where(F.col("_n").isin([n.first for n in todo])).collect()}
        todo = [n for n in todo if n.first in stats]
        if not todo:
            break
        whole = whole or [max(1, x) for x in width(stats[0])]
        low, high, want = {}, {}, {}
        for n in todo:
            s = stats[n.first]
            n.dim = max(dims, key=lambda i: (width(s)[i] / whole[i], -i))
            low[n.first], high[n.first] = s[f"a{n.dim}"], s[f"b{n.dim}"] + 1
            want[n.first] = s.w * (n.leaves // 2) // n.leaves
        value, below = _quantiles(units, root, todo, dict(want), low, high, lambda n: F.col(f"_d{n.dim}"))
        for n in todo:
            n.value = value[n.first]
        same = lambda n: F.when(F.col(f"_d{n.dim}") == n.value, F.col("_tie")).otherwise(F.lit(-1).cast("bigint"))
        tie, _ = _quantiles(units, root, todo, {i: want[i] - below[i] for i in want}, {i: 0 for i in want}, {i: 1 << GROUP_BITS + PART_BITS for i in want}, same)
        for n in todo:
            n.tie = tie[n.first]
        for n in todo:
            n.left, n.right = Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)
        level = [x for n in todo for x in (n.left, n.right)]
    return root


def kd_shards(docs: DataFrame, dims: list[str], weight: Column, leaves: int | None = None, target_bytes: int | None = None, key: str = "doc_id", carry: tuple[Column, ...] = (), text: str = "text") -> DataFrame:
    """key, `size`, the carried columns, `shard` and `slot` (gapless from 0 in each shard) of every row."""
    scratch = Scratch(docs.sparkSession, "kd")
    group = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(key), *carry, weight.cast("bigint").alias("_w"), group.alias("_g"), *[coordinate(docs, d).cast("bigint").alias(f"_d{i}") for i, d in enumerate(dims)])
    rows = scratch.keep(slim.withColumn("_row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    total = rows.agg(F.sum("_w").alias("w"), F.count("*").alias("n")).first()
    leaves = leaves or max(1, -(-(total.w or 0) // target_bytes))
    most = max(1, (total.w or 0) // (leaves * PARTS))
    groups = rows.groupBy("_g").agg(F.sum("_w").alias("_w"), *[F.min(f"_d{i}").alias(f"_d{i}") for i in range(len(dims))])
    groups = scratch.keep(groups.withColumn("_parts", F.greatest(F.lit(1), F.least(F.ceil(F.col("_w") / most), F.lit(1 << PART_BITS))).cast("int")))
    large = F.broadcast(groups.where("_parts > 1").select("_g", "_parts"))  # leaves * PARTS rows at most, by their weight
    part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1)))
    parted = rows.select("_row", "_g", "_w").join(large, "_g", "left").groupBy("_g", part.alias("_p")).agg(F.sum("_w").alias("_w"))
    tie = F.shiftleft(F.pmod(F.xxhash64("_g"), F.lit(1 << GROUP_BITS)), PART_BITS) + F.col("_p")
    units = scratch.keep(parted.join(groups.drop("_w", "_parts"), "_g").withColumn("_tie", tie))
    root = grow(units, [is_number(docs, d) for d in dims], leaves)
    shard = units.select("_g", "_p", _path(root, lambda n: F.lit(n.first)).alias("shard"))
    names = [key, *[c for c in rows.columns if not c.startswith("_") and c != key]]
    placed = rows.select(*names, "_w", "_g", "_row").join(large, "_g", "left").withColumn("_p", part).drop("_parts").join(shard, ["_g", "_p"])
    buckets = max(16, total.n // (leaves * SLOT_ROWS))
    spread = scratch.keep(placed.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets))).drop("_g", "_p"))
    sums = spread.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = sums.select("shard", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_row")) - 1
    numbered = spread.withColumn("_in", inside).join(before, ["shard", "_b"])
    scratch.free(rows, groups, units)
    return numbered.select(key, F.col("_w").alias("size"), *names[1:], "shard", (F.col("_in") + F.col("_before")).alias("slot"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id", pieces: int = 8) -> None:
    """Write docs as one folder for each shard, in files of bounded size; keys are unique here."""
    joined = docs.join(shards.select(key, "shard", "slot"), key)
    joined.repartition("shard", F.pmod("slot", F.lit(pieces))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    got = kd_shards(docs, ["_bytes", "source", "lang"], F.col("_bytes") + 8, leaves=shards, carry=(crc,))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
