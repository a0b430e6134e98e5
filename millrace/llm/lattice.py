"""Language-model scores by subword lattices.

Each word spans a lattice of all its segmentations into the pieces of an existing vocabulary; a forward recursion in
log space sums over all of them. The installed vocabulary is one of BPE, whose scores are ranks: 1 / rank gives the first
probabilities, and expectation-maximisation over all words of the training documents, each weighted by its count, refits
them. A document's probability is the product over its words and its end; a word's is that of its lattice and nothing
else, whether training has it or not.

Words are counted and scored once each, not once an occurrence: tasks send the different words of a block of documents,
Spark counts them over all documents and joins the scores back to the blocks. What is gathered grows with the
corpus, and no vocabulary of the corpus is ever held in one place.

Null and empty texts are their end alone. Repeated rows count each time. Where there are no training documents the first
probabilities stay, ends have probability 1 / 2 and base scores are those of zero counts. Words of over LONG bytes are
worked on one at a time, in time and memory in proportion to their length (about 10 s and 200 MB a million bytes). Ids are whole numbers
(bigint), null or not. An empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, held, map_arrow, pieces, table, texts
from .transducer import split_words, vocabulary

ROUNDS = 3
#: Text bytes of a block, and cells of a lattice table that is worked on at once.
BLOCK, CELLS = 12 << 20, 1 << 20
#: Bytes from which a word is worked on alone.
LONG = 256
START = b"\xff"  # stands for the mark of a word's beginning; no UTF-8 text has it


class Lattice:
    """Pieces of a sentencepiece model, by length, with their log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        rank = np.full(self.size, np.inf)
        by_length: dict[int, list[tuple[int, int]]] = {}
        self.byte = np.full(256, -1)
        for i in range(self.size):
            if m.is_byte(i):
                self.byte[int(m.id_to_piece(i)[3:5], 16)] = i
                rank[i] = self.size
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                word = m.id_to_piece(i).encode().replace("▁".encode(), START)
                by_length.setdefault(len(word), []).append((hash_bytes(word), i))
                rank[i] = 1 - m.get_score(i)
        self.tables = {}
        for n, got in sorted(by_length.items()):
            got.sort()
            self.tables[n] = np.array([h for h, _ in got], np.uint64), np.array([i for _, i in got])
        weight = 1 / (rank + 1)
        # Whatever byte has no piece of its own takes one beyond the vocabulary.
        self.byte[self.byte < 0] = self.size
        with np.errstate(divide="ignore"):
            self.start = np.log(np.append(weight, 1 / (self.size + 1)) / (weight.sum() + 1 / (self.size + 1)))

    def arcs(self, cells: np.ndarray):
        """Yields (begin, end, rows, pieces) of the arcs over words, the rows of a matrix of bytes; bytes' own pieces at last."""
        n, width = cells.shape
        up = np.cumprod(np.full(width + 1, _BASE, np.uint64)) if width else np.zeros(1, np.uint64)
        up = np.concatenate([[np.uint64(1)], up[:-1]])
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum((cells.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=prefix[:, 1:])
        for end in range(1, width + 1):
            for size, (known, ids) in self.tables.items():
                if size > end:
                    break
                # Hashes are compared at the power of the begin, which an odd factor undoes.
                h = (prefix[:, end] - prefix[:, end - size]) * _inverse(end - size)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rows = np.flatnonzero(known[at] == h)
                if len(rows):
                    yield end - size, end, rows, ids[at[rows]]
            yield end - 1, end, slice(None), self.byte[cells[:, end - 1]]

    def forward(self, words: list[bytes], logs: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word over all segmentations, and, given weights of words, the expected uses of each piece."""
        out, uses = np.zeros(len(words)), np.zeros(len(logs))
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        order, i = np.argsort(size, kind="stable"), 0
        for k in order[size[order] > LONG].tolist():
            out[k], got = self.forward_long(words[k], logs, weights is not None)
            if weights is not None:
                uses += weights[k] * got
        order = order[size[order] <= LONG]
        while i < len(order):
            # As many words of about one length as the cells allow.
            most = int(size[order[i]]) + 4
            j = min(int(np.searchsorted(size[order], most, side="right")), i + max(1, CELLS // most))
            rows = order[i:j]
            width = int(size[rows].max())
            raw = b"".join((START + words[k]).ljust(width, b"\0") for k in rows)
            cells = np.frombuffer(raw, np.uint8).reshape(len(rows), width)
            arcs = list(self.arcs(cells)) if weights is not None else None
            alpha = np.full((width + 1, len(rows)), -np.inf)
            alpha[0] = 0
            for a, b, r, piece in arcs if arcs is not None else self.arcs(cells):
                alpha[b, r] = np.logaddexp(alpha[b, r], alpha[a, r] + logs[piece])
            at = np.arange(len(rows))
            out[rows] = alpha[size[rows], at]
            if arcs is not None:
                beta = np.full((width + 1, len(rows)), -np.inf)
                beta[size[rows], at] = 0
                z, w = out[rows], weights[rows]
                for a, b, r, piece in reversed(arcs):
                    through = logs[piece] + beta[b, r]
                    uses += np.bincount(piece, np.exp(np.minimum(alpha[a, r] + through - z[r], 0)) * w[r], minlength=len(logs))
                    beta[a, r] = np.logaddexp(beta[a, r], through)
            i = j
        return out, uses

    def forward_long(self, word: bytes, logs: np.ndarray, expect: bool) -> tuple[float, np.ndarray]:
        """The same for one long word: arcs are found for all places at once, and taken in order of their ends."""
        cells = np.frombuffer(START + word, np.uint8)
        n = len(cells)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _inverse(1), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((cells.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        ends, sizes, ids = [np.arange(1, n + 1)], [np.ones(n, np.int64)], [self.byte[cells]]
        for size, (known, names) in self.tables.items():
            if size <= n:
                h = (prefix[size:] - prefix[:-size]) * down[: n - size + 1]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                ends.append(hit + size)
                sizes.append(np.full(len(hit), size))
                ids.append(names[at[hit]])
        end, size, piece = (np.concatenate(x) for x in (ends, sizes, ids))
        order = np.argsort(end, kind="stable")
        begin, end, piece = (end - size)[order], end[order], piece[order]
        arcs = list(zip(begin.tolist(), end.tolist(), logs[piece].tolist(), strict=True))
        alpha = _chain(arcs, n)
        uses = np.zeros(len(logs))
        if expect:
            beta = _chain([(n - b, n - a, p) for a, b, p in reversed(arcs)], n)[::-1]
            alpha_, beta_ = np.array(alpha), np.array(beta)
            uses += np.bincount(piece, np.exp(np.minimum(alpha_[begin] + logs[piece] + beta_[end] - alpha[n], 0)), minlength=len(logs))
        return alpha[n], uses


def _chain(arcs: list[tuple[int, int, float]], n: int) -> list[float]:
    """Log sums over all ways from place 0 to each place, of arcs that come in an order in which their begins are done."""
    out = [0.0] + [-math.inf] * n
    for a, b, p in arcs:
        x, y = out[a] + p, out[b]
        if x > y:
            x, y = y, x
        out[b] = y + math.log1p(math.exp(x - y)) if x > -math.inf else y
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSES: list[np.uint64] = [np.uint64(1)]


def _inverse(n: int) -> np.uint64:
    """The inverse of the n-th power of the base, modulo 2 ** 64."""
    one = pow(int(_BASE), -1, 1 << 64)
    while len(_INVERSES) <= n:
        _INVERSES.append(np.uint64(int(_INVERSES[-1]) * one % (1 << 64)))
    return _INVERSES[n]


def hash_bytes(word: bytes) -> int:
    out, power = 0, 1
    for b in word:
        out, power = (out + (b + 1) * power) % (1 << 64), power * int(_BASE) % (1 << 64)
    return out


_MADE: dict[str, Lattice] = held()


def lattice(name: str) -> Lattice:
    if name not in _MADE:
        _MADE[name] = Lattice(vocabulary(name))
    return _MADE[name]


WORDS = "block bigint, word binary, at int, n_train bigint, docs binary, postings binary"


def _blocks(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """The different words of each block of documents (at: their place) with their uses in training, and a row of the block's
    documents: ids, whether null, numbers of words; and postings: document, word's place and count."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in WORDS.split(", ")]
        for batch in pieces(batches, text, BLOCK):
            ids = batch.column(batch.schema.get_field_index(key))
            learn = batch.column(batch.schema.get_field_index("_train")).to_numpy(zero_copy_only=False).astype(bool)
            arr = texts(batch, text)
            offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
            low = LOWER[np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
            arr = pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(low.tobytes()))
            codes, words, first = split_words(arr)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            pair, count = np.unique(codes.astype(np.int64) * len(n) + doc, return_counts=True)
            which, where = pair // len(n), pair % len(n)
            used = np.bincount(which, count * learn[where], minlength=len(words)).astype(np.int64)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            about = b"".join([np.array([len(n)], "<i8").tobytes(), np.array([x or 0 for x in ids.to_pylist()], "<i8").tobytes(), null.astype(np.uint8).tobytes(), learn.astype(np.uint8).tobytes(), n.astype("<i8").tobytes()])
            kind = "<u2" if len(n) < 1 << 16 else "<u4"
            post = b"".join([kind.encode(), np.array([len(pair)], "<i8").tobytes(), where.astype(kind).tobytes(), which.astype("<u4").tobytes(), count.astype("<u4").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([block], pa.int64()), ([None], pa.binary()), ([-1], pa.int32()), ([int(learn.sum())], pa.int64()), ([about], pa.binary()), ([post], pa.binary()))], names=names)
            for a in range(0, len(words), 50_000):
                some = words.slice(a, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), some.cast(pa.large_binary()).cast(pa.binary()), pa.array(np.arange(a, a + len(some)), pa.int32()), pa.array(used[a : a + len(some)]), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())], names=names)
            block += 1

    return map_arrow(docs.select(key, text, train.alias("_train")), run, WORDS)


def _expect(words: DataFrame, logs: np.ndarray, name: str) -> np.ndarray:
    box = words.sparkSession.sparkContext.broadcast(logs)  # as long as the vocabulary

    def run(batches):
        total = np.zeros(len(box.value))
        for batch in batches:
            total += lattice(name).forward(batch.column(0).to_pylist(), box.value, batch.column(1).to_numpy(zero_copy_only=False).astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "n"])

    out = np.zeros(len(logs))
    for r in map_arrow(words.select("word", "c"), run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", pieces_of: str = "piece_bpe_32k.model") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every document; models learn from rows where train is true."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    blocks = scratch.keep(_blocks(docs, key, text, F.coalesce(train, F.lit(False))))
    words = scratch.keep(blocks.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n_train").alias("c")))
    seen = words.where("c > 0")
    t = seen.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = blocks.where(F.col("word").isNull()).agg(F.sum("n_train")).first()[0] or 0
    total, kinds = (t.n or 0) + ends, t.v + (ends > 0)
    stop = (ends + 1) / (total + 2)  # the share of ends among tokens

    m = lattice(pieces_of)
    logs = m.start
    for _ in range(ROUNDS if t.v else 0):
        uses = _expect(seen, logs, pieces_of) + 1e-3 + np.exp(m.start)  # every piece stays possible
        logs = np.log(uses / uses.sum())
    box = spark.sparkContext.broadcast(logs)

    def rate(batches):
        for batch in batches:
            got, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            full = lattice(pieces_of).forward(got, box.value)[0] + np.log1p(-stop)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c > 0), pa.array(np.log10((c + 1) / (total + kinds + 1))), pa.array(full / np.log(10))], names=["word", "known", "base", "full"])

    rated = map_arrow(words, rate, "word binary, known boolean, base double, full double")
    found = blocks.where(F.col("word").isNotNull()).select("block", "word", "at").join(rated, "word").select("block", "at", "known", "base", "full", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("postings"))
    heads = blocks.where(F.col("word").isNull()).select("block", F.lit(-1).alias("at"), F.lit(False).alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("full"), "docs", "postings")
    end_base, end_full = np.log10((ends + 1) / (total + kinds + 1)), np.log10(stop)

    def gather(part: pa.Table) -> pa.Table:
        get = lambda c: part.column(c).to_numpy()
        at = get("at")
        head = int(np.flatnonzero(at < 0)[0])
        about, post = part.column("docs")[head].as_py(), part.column("postings")[head].as_py()
        n = int(np.frombuffer(about, "<i8", 1)[0])
        ids, null, learn, size = np.frombuffer(about, "<i8", n, 8), np.frombuffer(about, np.uint8, n, 8 + 8 * n), np.frombuffer(about, np.uint8, n, 8 + 9 * n), np.frombuffer(about, "<i8", n, 8 + 10 * n)
        kind, m_ = post[:3].decode(), int(np.frombuffer(post, "<i8", 1, 3)[0])
        wide = int(kind[2])
        doc, which, count = np.frombuffer(post, kind, m_, 11), np.frombuffer(post, "<u4", m_, 11 + wide * m_), np.frombuffer(post, "<u4", m_, 11 + (wide + 4) * m_)
        value = np.zeros((3, max(len(at) - 1, 1)))
        rest = at >= 0
        for i, c in enumerate(("known", "base", "full")):
            value[i, at[rest]] = part.column(c).to_numpy()[rest]
        known, base, full = (np.bincount(doc, value[i][which] * count, minlength=n) for i in range(3))
        return pa.table({key: pa.array(ids, pa.int64(), mask=null.astype(bool)), "_learn": learn.astype(bool), "n_tokens": size + 1, "n_known": np.round(known).astype(np.int64) + int(ends > 0), "train_tokens": np.full(n, total, np.int64), "base_score": base + end_base, "score": full + end_full})

    return found.unionByName(heads).groupBy("block").applyInArrow(gather, f"{key} bigint, _learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = score(table(spark, sf_dir, "documents"), ~held_out)
    return got.select("doc_id", (~F.col("_learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
