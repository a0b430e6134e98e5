"""Toxicity by compression distance: which of two zstandard dictionaries compresses a window of text better.

One dictionary is made from toxic and one from ordinary text, as raw dictionary content. The words of a class that stand
in many different surroundings, and that the other class has hardly at all, go in (counting surroundings, not documents,
keeps copies of one text from voting many times). Texts are reduced to lower-case letters, cut into windows, and each
window is compressed with both; the bytes saved by the toxic dictionary over all windows of the whole text are summed up
in four numbers, which a logistic fit turns into a score. The fit and the threshold, put at 0.7, come from the last
quarter of the sample of either class, which the dictionaries have not seen, at every size of the sample.

This isn't what zstandard's own trainer gives. README has the figures of that: it picks what is frequent, and toxic
text is mostly ordinary text, so its two dictionaries hardly differ.

Labels come from at most TOXIC + ORDINARY rows with crc32(doc_id as text) mod 3 != 1, of at most LONGEST bytes each, in
the order of a hash of their ids: a bounded sample, brought to the driver. Every text is scored whole.

Null and empty texts have no windows that differ and get the score of such. Equal texts get equal scores; repeated rows
are scored each. Without labels of both classes all scores are 0; an empty table gives no rows. Of labels that contradict
each other the toxic one counts. Other columns pass through, whatever their names, but for one of the result's own name. A text takes some ten times its bytes while it is scored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, annotate, buffer_of, fresh, table, word_spans

#: Bounds of the labelled sample: rows of either class, and bytes of a row's text.
TOXIC, ORDINARY, LONGEST = 2000, 4000, 20_000
WINDOW, OVERLAP, THRESHOLD = 32, 20, 0.7
#: Different neighbours on either side that a toxic word must have.
LEAST = 3
#: Bytes of a dictionary.
SIZE = 31 << 10
#: Before each word, so that a match of the 7 bytes that zstandard needs has the first letters of a word or 7 inside.
MARK, END = b"\x01\x01\x01", b"\x02"
#: Begins every window and ends both dictionaries: without one sure match zstandard would store short windows raw.
ANCHOR = bytes(range(3, 9)) + bytes(range(14, 32)) + b"\x7f\x7f" + bytes(range(31, 13, -1))
LETTERS = np.array([c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)
IS_LETTER = np.arange(256) != 32
_PLAIN = LETTERS.tobytes()


def spell(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MARK and the bytes of each word, every byte moved on by its place in the word: parts of words only match at the same place."""
    size = ends - starts
    begin = np.cumsum(size + len(MARK)) - size
    out = np.full(int((size + len(MARK)).sum()), MARK[0], np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + place] = words[np.repeat(starts, size) + place] + (37 * np.minimum(place, 255)).astype(np.uint8)
    return out


def windows(body: bytes) -> list[bytes]:
    """Anchored windows of a spelled text."""
    return [ANCHOR + body[i : i + WINDOW + OVERLAP] for i in range(0, max(1, len(body) - OVERLAP), WINDOW)]


def spelled(arr: pa.LargeStringArray) -> list[bytes]:
    data, offsets = buffer_of(arr)
    data = LETTERS[data]
    starts, ends, first = word_spans(data, offsets, IS_LETTER)
    body = spell(data, starts, ends).tobytes()
    at = np.concatenate([[0], np.cumsum(ends - starts + len(MARK))])[first]
    return [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _content(words: list[bytes]) -> bytes:
    size = np.array([len(w) for w in words], np.int64)
    body = spell(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, np.cumsum(size)).tobytes()
    at = np.cumsum(size + len(MARK))
    return b"".join(body[a:b] + MARK[:1] + END for a, b in zip((at - size - len(MARK)).tolist(), at.tolist(), strict=True))[-SIZE:]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0, 0, 0]))
    cut: float = 0.0

    def compressors(self) -> tuple:
        import zstandard as z

        # Fast strategy with a target length leaves literals as they are: lengths then only differ by matches.
        how = z.ZstdCompressionParameters.from_level(1, window_log=15, hash_log=14, chain_log=14, strategy=z.STRATEGY_FAST, target_length=1, min_match=7, write_content_size=False, write_dict_id=False)
        made = []
        for content in (self.toxic, self.ordinary):
            words = z.ZstdCompressionDict(content + ANCHOR, dict_type=z.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=how)
            made.append(z.ZstdCompressor(dict_data=words, compression_params=how))
        return tuple(made)

    def features(self, bodies: list[bytes]) -> np.ndarray:
        toxic, ordinary = self.compressors()
        out = np.zeros((len(bodies), 4))
        for i, body in enumerate(bodies):
            saved = np.array([len(ordinary.compress(x)) - len(toxic.compress(x)) for x in windows(body)])
            top, over = -np.partition(-saved, min(2, len(saved) - 1))[:3], np.maximum(saved - 2, 0)
            out[i] = top.max(), top.mean(), over.mean(), np.log1p(over.sum())
        return out

    def logit(self, features: np.ndarray) -> np.ndarray:
        return self.weights[0] + (features - self.mean) / self.scale @ self.weights[1:]

    def score(self, arr: pa.LargeStringArray) -> np.ndarray:
        z = self.logit(self.features(spelled(arr))) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _surroundings(data: list[bytes]) -> tuple[dict[bytes, int], int]:
    """After how many different words and before how many each word occurs, the lesser of the two; and the number of words."""
    left: dict[bytes, set] = defaultdict(set)
    right: dict[bytes, set] = defaultdict(set)
    total = 0
    for text in data:
        words = [b"", *text.translate(_PLAIN).split(), b""]
        total += len(words) - 2
        for a, w, b in zip(words, words[1:], words[2:], strict=False):
            left[w].add(a)
            right[w].add(b)
    return {w: n for w in left if (n := min(len(left[w]), len(right[w]))) > 1}, total


def _dictionaries(t: list[bytes], o: list[bytes]) -> Model:
    """Dictionaries of the words that mark toxic texts, and of ordinary ones."""
    (ct, nt), (co, no) = _surroundings(t), _surroundings(o)
    least = max(LEAST, 10 * len(t) // 1500)
    rate = lambda w, c, n: (c.get(w, 0) + 0.5) / max(n, 1)
    marks = sorted((w for w, n in ct.items() if n >= least and rate(w, ct, nt) > 20 * rate(w, co, no)), key=lambda w: (ct[w], w))
    # The ordinary dictionary is made of common words that begin as toxic ones do, then of the commonest others, so that
    # a match of mere beginnings is as good in either.
    begin = {w[:4] for w in marks}
    plain = sorted((w for w, n in co.items() if n >= 2 and len(w) > 3 and rate(w, ct, nt) < 2 * rate(w, co, no)), key=lambda w: (w[:4] in begin, co[w], w))
    model = Model(_content(marks), b"")
    model.ordinary = _content(plain)[-max(len(model.toxic), 1) :].rjust(len(model.toxic), END)
    return model


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """Dictionaries from the first three quarters of either class, weights and threshold from the rest. share: of toxic rows among all."""
    cut = [-(-len(rows) * 3 // 4) for rows in (toxic, ordinary)]
    t, o = toxic[cut[0] :], ordinary[cut[1] :]
    if not t or not o:
        return Model()
    model = _dictionaries(toxic[: cut[0]], ordinary[: cut[1]])
    x = model.features(spelled(pa.array([r.decode() for r in t + o], pa.large_string())))
    y = np.r_[np.ones(len(t)), np.zeros(len(o))]
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, b = np.c_[np.ones(len(x)), (x - model.mean) / model.scale], np.zeros(5)
    for _ in range(40):  # Newton steps of logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        b += np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + 0.05 * np.eye(5), z.T @ (weight * (y - p)) - 0.05 * b)
    model.weights = b
    s = z @ b
    tries = np.unique(s)
    f1 = [2 * weight[(s >= c) & (y == 1)].sum() / (weight[s >= c].sum() + weight[y == 1].sum()) for c in tries]
    best = int(np.argmax(f1))
    # A text in which the toxic dictionary saves nothing stays below the threshold, whatever few rows may say.
    model.cut = max(float((tries[best] + tries[max(best - 1, 0)]) / 2), float(model.logit(np.zeros((1, 4)))[0]) + 1e-3)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    known = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & (F.crc32(F.col("_k").cast("string")) % 3 != 1)).groupBy("_k").agg(F.max("_y").alias("_y"))
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    texts_ = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.octet_length("_t") <= LONGEST)
    there = known.join(texts_.select("_k").distinct(), "_k")  # ids first: whose text is missing or too long makes room
    picked = None
    for y, most in ((1, TOXIC), (0, ORDINARY)):
        part = there.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = texts_.join(F.broadcast(picked), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t")).orderBy(F.xxhash64("_k"), "_k").collect()  # TOXIC + ORDINARY rows at most
    by = {y: [r._t.encode() for r in rows if r._y == y] for y in (0, 1)}
    return fit(by[1], by[0], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, into: str = "toxicity", text: str = "text") -> DataFrame:
    """docs with a struct `into` that holds the score of the whole text."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 32 KB at most

    def make():
        def run(arr: pa.LargeStringArray) -> dict:
            return {"score": box.value.score(arr)}

        return run

    return annotate(docs, make, "score double", into, text, PIECE)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    (name,) = fresh(docs, "_toxicity")
    return score(docs, train(docs, labels), name).where(F.col(f"{name}.score") < THRESHOLD).drop(name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"))
