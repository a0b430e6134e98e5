"""Near-duplicate documents: an exact Jaccard join of word 5-gram sets, by signature trees.

In a fixed order of all shingles two sets of similarity 0.75 or more share one of the first n - ceil(0.75 n) + 1 of
either. The order puts shingles that many documents have last, so that passages in many documents make no large
buckets; it is found from counts in each task and only decides how much work there is, never what is found. Documents
that share such a shingle form a bucket, and buckets with the same least document are searched as one.

Equal sets are one class, and only its least document goes on. Each document is first compared with the least
document of the bucket in which it shares most with it, which joins most groups with a comparison or two each. Then every
bucket that still holds two components is searched, first for the likeliest partner of each document, then for all pairs
left, by signature trees: nodes hold the OR of their documents' token bitmaps, their range of sizes and the most tokens
that fell on taken bits, and a dual traversal from the root goes down only into pairs of nodes whose greatest possible
overlap is enough. Buckets of over BLOCK documents are cut into blocks by size and by least shingle; of these, only roots
meet at first, and only pairs of blocks that the roots can't rule out are brought together. Every pair left is compared
by its whole sets. Pairs within one component need no comparison: they are joined already.

Texts without words have an empty set and are linked with nothing; null texts likewise. Texts of fewer than five words
have one shingle, the whole sequence. Rows that repeat a doc_id are one document with all their texts' links. Rows with a
null doc_id come back with a null component. Ids are whole numbers (bigint). An empty table gives no rows; other columns
are not looked at, whatever their names. A text must fit a worker's memory some forty times over, while its words are hashed.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, PIECE, Scratch, buffer_of, fresh, gram_hashes, map_arrow, mix, pieces, table, texts, word_hashes, word_spans
from .components import components

K = 5
#: A similarity of NUM / DEN or more is a link.
NUM, DEN = 3, 4
#: Documents of a bucket in one tree; children of a node.
BLOCK, FAN = 1024, 8
#: 64-bit words of the bitmap of a block's root.
ROOT = 32
#: Shingles that a task counts at once, times one must have there, and how many are put in order by their counts.
COUNTED, OFTEN, ORDERED = 1 << 20, 4, 1 << 19
#: Bytes of a column of ids up to which it is broadcast; beyond it texts are shuffled.
BROADCAST_BYTES = 16 << 20


def sets(arr: pa.LargeStringArray) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    data, offsets = buffer_of(arr)
    starts, ends, first = word_spans(LOWER[data], offsets, NOT_SPACE)
    words = word_hashes(LOWER[data], starts, ends)
    grams = gram_hashes(words, K)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - K + 1]) if b - a >= K else gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(x) or not len(y) or DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return DEN * both >= NUM * (len(x) + len(y) - both)


def bits_of(n: int) -> int:
    """Bits of the bitmap of a set of n: four to eight times as many, a power of 2."""
    return 1 << max(6, (4 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(bits_of(len(s)), np.uint8)
    out[(s >> np.uint64(20)).astype(np.int64) & (len(out) - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of a smaller size, a power of 2."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _profile(docs: DataFrame) -> DataFrame:
    """A row (id, n, key) for each document, and rows (h, df) of shingles that several documents of a task have."""
    names = ["id", "n", "key", "h", "df"]

    def run(batches):
        held, count = [], 0

        def often():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = n >= OFTEN
            none = pa.nulls(int(at.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(none), pa.binary()), pa.array(h[at].view(np.int64)), pa.array(n[at], pa.int64())], names=names)

        for batch in pieces(batches, "text", PIECE):
            got = sets(texts(batch))
            keys = [np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)]).tobytes() for s in got]
            none = pa.nulls(len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array([len(s) for s in got], pa.int64()), pa.array(keys, pa.binary()), none, none], names=names)
            held += got
            count += sum(map(len, got))
            if count > COUNTED:
                yield often()
                held, count = [], 0
        if held:
            yield often()

    return map_arrow(docs, run, "id bigint, n bigint, key binary, h bigint, df bigint")


def _early(docs: DataFrame, often: np.ndarray, level: np.ndarray) -> DataFrame:
    """Rows (id, h) of the shingles of each document that come first in the order."""
    box = docs.sparkSession.sparkContext.broadcast((often, level))  # ORDERED shingles at most

    def run(batches):
        often, level = box.value
        for batch in pieces(batches, "text", PIECE):
            got, ids = [], batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            for s in sets(texts(batch)):
                early, n = s, len(s)
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, level[at], 0)
                    if rank.any():
                        early = s[np.argsort(rank, kind="stable")]
                got.append(early[: n - -(-NUM * n // DEN) + 1] if n else s)
            every = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            owner = np.repeat(ids, [len(x) for x in got])
            for a in range(0, len(every), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(owner[a : a + 50_000], pa.int64()), pa.array(every[a : a + 50_000])], names=["id", "h"])

    return map_arrow(docs.where("id IS NOT NULL"), run, "id bigint, h bigint")


def _signed(docs: DataFrame) -> DataFrame:
    """id, n, the least shingle and the bitmap of each document with a set."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            got = [(i, len(s), int(s[:1].view(np.int64)[0]), bitmap(s).tobytes()) for i, s in zip(batch.column(0).to_pylist(), sets(texts(batch)), strict=True) if len(s)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "n", "least", "bits"])

    return map_arrow(docs.select("id", "text"), run, "id bigint, n bigint, least bigint, bits binary")


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Rows that hold two texts go to Python in small batches; holds for what is written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _some(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of some different ids, a written column."""
    most = BROADCAST_BYTES // 8
    return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    ids = scratch.keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    some = _some(docs, ids)

    def run(batches):
        for batch in batches:
            x, y = sets(texts(batch, "x")), sets(texts(batch, "y"))
            ok = pa.array([linked(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    # Merge joins at every size: few pairs would otherwise be broadcast, and the plan of small inputs be another.
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    with _small_batches(docs.sparkSession, 128):
        out = scratch.keep(map_arrow(both, run, "a bigint, b bigint"))
    scratch.free(ids)
    return out


class Tree:
    """A signature tree over documents in order of size."""

    def __init__(self, n: np.ndarray, maps: np.ndarray):
        """n: sizes, ascending; maps: bitmaps of one width."""
        lost = n - ones(maps)  # tokens on bits that others had taken
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))

    @staticmethod
    def possible(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether nodes i of a level and j of another can hold a pair with enough overlap."""
        (a, a_low, a_high, a_lost), (b, b_low, b_high, b_lost) = x, y
        low, other = a_low[i], b_low[j]
        ok = (DEN * a_high[i] >= NUM * other) & (DEN * b_high[j] >= NUM * low)
        at = np.flatnonzero(ok)
        for s in range(0, len(at), 1 << 14):
            k = at[s : s + (1 << 14)]
            most = ones(a[i[k]] & b[j[k]]) + np.minimum(a_lost[i[k]], b_lost[j[k]])
            # |A and B| >= NUM / DEN * |A or B| means (NUM + DEN) * |A and B| >= NUM * (|A| + |B|).
            ok[k] = (NUM + DEN) * most >= NUM * (low[k] + other[k])
        return ok


def tree_pairs(left: Tree, right: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents that the dual traversal can't rule out; of one tree, pairs i < j."""
    depth = max(len(left.levels), len(right.levels)) - 1
    at = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        ok = Tree.possible(at(left, d), at(right, d), i, j)
        i, j = i[ok], j[ok]
        if not d or not len(i):
            break
        # Children of a pair of nodes are the pairs of their children; a tree that is lower already stays at its root.
        grow_i, grow_j = d < len(left.levels), d < len(right.levels)
        ci, cj = FAN if grow_i else 1, FAN if grow_j else 1
        i, j = np.repeat(i * ci, ci * cj) + np.tile(np.repeat(np.arange(ci), cj), len(i)), np.repeat(j * cj, ci * cj) + np.tile(np.tile(np.arange(cj), ci), len(j))
        good = (i < len(at(left, d - 1)[1])) & (j < len(at(right, d - 1)[1]))
        if same:
            good &= i <= j
        i, j = i[good], j[good]
    if same:
        good = i < j
        i, j = i[good], j[good]
    return i, j


def bucket_pairs(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket, of different components, that may be similar enough, and how much; with sides only pairs across."""
    width = np.array([len(x) // 8 for x in bits])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kinds = np.unique(width).tolist()
    for x in kinds:
        for y in kinds:
            # Sets of similar size have bitmaps of one width, or of two that differ by 2.
            if not x <= y <= 2 * x:
                continue
            trees = []
            for w, s in ((x, 0), (y, 1)):
                rows = np.flatnonzero(width == w if side is None else (width == w) & (side == s))
                rows = rows[np.argsort(n[rows], kind="stable")]
                maps = np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), w)
                trees.append((rows, fold(maps, x)))
            if side is not None and x != y:  # either side may have the wider ones
                found += [_across(trees[0], trees[1], n, comp, ids)]
                rows = [np.flatnonzero((width == w) & (side == s)) for w, s in ((y, 0), (x, 1))]
                rows = [r[np.argsort(n[r], kind="stable")] for r in rows]
                pair = [(r, fold(np.frombuffer(b"".join(bits[q] for q in r), np.uint64).reshape(len(r), w), x)) for r, w in zip(rows, (y, x), strict=True)]
                found += [_across(pair[0], pair[1], n, comp, ids)]
            else:
                found += [_across(trees[0], trees[1], n, comp, ids, same=side is None and x == y)]
    a, b, most = (np.concatenate(v) for v in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b), most


def _across(x, y, n, comp, ids, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (p, a), (q, b) = x, y
    if not len(p) or not len(q):
        return ids[:0], ids[:0], np.zeros(0)
    left = Tree(n[p], a)
    right = left if same else Tree(n[q], b)
    i, j = tree_pairs(left, right, same)
    good = (comp[p[i]] != comp[q[j]]) & (ids[p[i]] != ids[q[j]])
    i, j = i[good], j[good]
    most = np.zeros(len(i))
    for s in range(0, len(i), 1 << 14):
        k = slice(s, s + (1 << 14))
        most[k] = (ones(a[i[k]] & b[j[k]]) + np.minimum(left.levels[0][3][i[k]], right.levels[0][3][j[k]])) / (n[p[i[k]]] + n[q[j[k]]])
    return ids[p[i]], ids[q[j]], most


def nearest_only(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the likeliest of either document."""
    keep = np.zeros(len(x), bool)
    for one, other in ((x, y), (y, x)):
        order = np.lexsort((other, -most, one))
        keep[order[np.concatenate([[True], one[order][1:] != one[order][:-1]])]] = True
    return np.flatnonzero(keep)


def _search(rows: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs of the buckets: rows h, i, j, side, id, n, comp, bits, together and in order by (h, i, j)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192:
                whole = pa.Table.from_batches(held)
                done, keep = split(whole)
                yield from answer(done)
                held = keep.to_batches()
        if held:
            yield from answer(pa.Table.from_batches(held))

    def turns(t: pa.Table) -> np.ndarray:
        h, i, j = (t.column(c).to_numpy() for c in ("h", "i", "j"))
        return np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1

    def split(t: pa.Table):
        at = turns(t)
        cut = int(at[-1]) if len(at) else 0
        return t.slice(0, cut), t.slice(cut)

    def answer(t: pa.Table):
        if not t.num_rows:
            return
        ids, n, comp, side, i, j = (t.column(c).to_numpy() for c in ("id", "n", "comp", "side", "i", "j"))
        bits = t.column("bits").to_pylist()
        cuts = [0, *turns(t).tolist(), t.num_rows]
        seen = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                two = i[a] != j[a]
                seen.append(bucket_pairs(ids[a:b], n[a:b], comp[a:b], bits[a:b], side[a:b] if two else None))
        x, y, most = (np.concatenate(v) for v in zip(*seen, strict=True)) if seen else (ids[:0], ids[:0], ids[:0])
        if nearest and len(x):
            at = nearest_only(x, y, most)
            x, y = x[at], y[at]
        if len(x):
            pair = np.unique(np.stack([x, y]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["a", "b"])

    ordered = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return map_arrow(ordered, run, "a bigint, b bigint").distinct()


def _buckets(docs: DataFrame, often: np.ndarray, level: np.ndarray, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """g, id, votes: the least document of a bucket, another of it, and how many early shingles they share through it."""
    early = _early(docs, often, level)
    shared = early.groupBy("h").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "g")
    met = early.join(shared.hint("merge"), "h").groupBy("g", "id").agg(F.count(F.lit(1)).alias("votes"))
    own = reps.select("id", "rep")
    met = met.join(own, "id").select("g", F.col("rep").alias("id"), "votes").groupBy("g", "id").agg(F.max("votes").alias("votes"))
    met = met.join(own.select(F.col("id").alias("g"), F.col("rep").alias("r")), "g").select(F.col("r").alias("g"), "id", "votes")
    met = met.groupBy("g", "id").agg(F.max("votes").alias("votes"))
    return scratch.keep(met.unionByName(met.select("g", F.col("g").alias("id"), F.lit(0).cast("bigint").alias("votes")).distinct()).groupBy("g", "id").agg(F.max("votes").alias("votes")))


def _first_pairs(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """Each document with the bucket's least document that it shares the most early shingles with, if their sizes allow."""
    size = reps.select("id", "n")
    near = buckets.where("g <> id").join(size, "id").join(size.select(F.col("id").alias("g"), F.col("n").alias("gn")), "g").where(DEN * F.least("n", "gn") >= NUM * F.greatest("n", "gn"))
    best = near.groupBy("id").agg(F.max(F.struct("votes", (-F.col("g")).alias("w"))).alias("m")).select("id", (-F.col("m.w")).alias("with"))
    return best.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).distinct()


def _size_class(n):
    """Sets that may link are of one class or of two that follow each other."""
    return F.floor(F.log(n.cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (h, m, id, n, comp, least, bits) with their block: of one size class, of like least shingles, of about BLOCK at most."""
    rows = rows.withColumn("class", _size_class(F.col("n"))).withColumn("part", F.pmod(F.xxhash64("least"), F.ceil(F.col("m") / BLOCK)))
    size = rows.groupBy("h", "class", "part").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(size, ["h", "class", "part"]).withColumn("block", F.xxhash64("class", "part", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK))))
    return rows.select("h", "class", "block", "id", "n", "comp", "bits")


ROOTS = "h bigint, class int, block bigint, low bigint, high bigint, lost bigint, c0 bigint, c1 bigint, map binary"


def _roots(rows: DataFrame) -> DataFrame:
    """The root of each block: its range of sizes, the most tokens on taken bits, its range of components, the OR of its bitmaps."""

    def root(part: pa.Table) -> pa.Table:
        n, comp, maps, lost = part.column("n").to_numpy(), part.column("comp").to_numpy(), np.zeros(ROOT, np.uint64), 0
        for raw, size in zip(part.column("bits").to_pylist(), n.tolist(), strict=True):
            one = fold(np.frombuffer(raw, np.uint64)[None, :], ROOT)[0]
            lost = max(lost, size - int(ones(one)))
            maps |= np.tile(one, ROOT // len(one))  # a narrower bitmap stands for all places that it may come from
        h, kind, block = (part.column(c)[0].as_py() for c in ("h", "class", "block"))
        return pa.table([pa.array([h], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in (n.min(), n.max(), lost, comp.min(), comp.max())), pa.array([maps.tobytes()], pa.binary())], names=[x.split()[0] for x in ROOTS.split(", ")])

    return rows.groupBy("h", "class", "block").applyInArrow(root, ROOTS)


def _met(roots: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of every two blocks (or one with itself) that their roots can't rule out, as _search takes them."""
    left = roots.select(*[F.col(c).alias(f"x_{c}") for c in roots.columns])
    # Sets that may link are of one size class or of two in turn.
    right = roots.withColumn("at", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    pairs = left.join(right, (F.col("x_h") == F.col("h")) & (F.col("x_class") == F.col("at"))).where(
        ((F.col("x_class") < F.col("class")) | (F.col("x_block") <= F.col("block")))
        & (DEN * F.col("x_high") >= NUM * F.col("low")) & (DEN * F.col("high") >= NUM * F.col("x_low"))
        & ~((F.col("x_c0") == F.col("x_c1")) & (F.col("c0") == F.col("c1")) & (F.col("x_c0") == F.col("c0")))
    )

    def possible(batches):
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            x, y = (np.frombuffer(b"".join(get(c).to_pylist()), np.uint64).reshape(-1, ROOT) for c in ("x_map", "map"))
            num = lambda c: get(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            most = ones(x & y) + np.minimum(num("x_lost"), num("lost"))
            ok = pa.array((NUM + DEN) * most >= NUM * (num("x_low") + num("low")))
            yield pa.RecordBatch.from_arrays([get(c).filter(ok) for c in ("h", "x_block", "block")], names=["h", "p", "q"])

    kept = map_arrow(pairs, possible, "h bigint, p bigint, q bigint")
    ends = kept.select("h", "p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")), F.struct(F.col("q").alias("block"), F.lit(1).alias("side"))))).alias("e"))
    ends = ends.select("h", F.col("p").alias("i"), F.col("q").alias("j"), "e.block", "e.side")
    return rows.join(ends, ["h", "block"]).select("h", "i", "j", "side", "id", "n", "comp", "bits")


def _bucket_pairs(buckets: DataFrame, reps: DataFrame, comps: DataFrame, docs: DataFrame, scratch: Scratch, nearest: bool) -> DataFrame:
    """Candidate pairs of documents of one bucket and of different components; all, or the likeliest of each document."""
    known = buckets.select("g", "id").join(reps.select("id", _size_class(F.col("low")).alias("x"), _size_class(F.col("n")).alias("y")), "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # Only who has a document of like size and of another component beside it in the bucket goes on; others need no bitmap.
    around = known.select("g", F.explode(F.sequence(F.col("x") - 1, F.col("y") + 1)).alias("class"), "comp").groupBy("g", "class").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("g", "class")
    some = known.select("g", "id", "comp", F.explode(F.sequence("x", "y")).alias("class")).join(around, ["g", "class"], "left_semi").select("g", "id", "comp").distinct()
    some = scratch.keep(some)
    rows = scratch.keep(some.join(some.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g").select(F.col("g").alias("h"), "id", "comp", "m"))
    ids = scratch.keep(rows.select("id").distinct())
    signed = scratch.keep(_signed(_some(docs, ids)))
    rows = rows.join(signed.hint("merge"), "id")
    small = rows.where(F.col("m") <= BLOCK).select("h", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0).alias("side"), "id", "n", "comp", "bits")
    found = [_search(small, nearest)]
    if rows.where(F.col("m") > BLOCK).limit(1).count():
        dealt = scratch.keep(_blocks(rows.where(F.col("m") > BLOCK)))
        found.append(_search(_met(scratch.keep(_roots(dealt)), dealt), nearest))
    out = scratch.keep(found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct())
    scratch.free(signed, ids, some)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    scratch = Scratch(spark, "near")
    profile = scratch.keep(_profile(docs))
    often = profile.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "h").limit(ORDERED).toPandas().sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    level = np.log2(np.maximum(often["df"].to_numpy(float), 1)).astype(np.uint8)
    rows = profile.where(F.col("h").isNull()).select("id", "n", "key")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("key", "n").agg(F.min("id").alias("rep"))
    # A document is represented by the least one of its class; one whose rows differ is itself, and linked with the classes of all.
    reps = rows.where("n > 0 AND id IS NOT NULL").join(classes, ["key", "n"]).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.min("n").alias("low"), F.max("n").alias("n"))
    reps = scratch.keep(reps.select("id", "low", "n", "a", "z", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("id")).alias("rep")))
    several = rows.where("n > 0 AND id IS NOT NULL").join(classes, ["key", "n"]).join(reps.where("a <> z").select("id"), "id", "left_semi")
    same = several.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    buckets = _buckets(docs, often["h"].to_numpy(np.int64).view(np.uint64), level, reps, scratch)
    heads = reps.where("id = rep")

    links = _verified(scratch.keep(_first_pairs(buckets, heads)), docs, scratch).unionByName(same)
    comps = components(links, scratch)
    for nearest in (True, False):
        more = _verified(_bucket_pairs(buckets, heads, comps, docs, scratch, nearest), docs, scratch)
        if more.limit(1).count():
            links = links.unionByName(more)
            comps = components(links, scratch)
    of_rep = reps.select("id", "rep").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("component_id"))
    scratch.free(buckets)
    return rows.join(of_rep, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id; rows without a doc_id stay."""
    (name,) = fresh(docs, "_keep")
    found = near_duplicates(docs, key).where(F.col("component_id") == F.col(key)).select(F.col(key).alias(name)).distinct()
    known = docs.where(F.col(key).isNotNull()).join(found, F.col(key).cast("bigint") == F.col(name), "left_semi")
    return known.unionByName(docs.where(F.col(key).isNull()))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
