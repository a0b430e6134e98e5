"""Token counts by a compiled finite-state transducer.

Byte-pair encoding is local: a token sequence is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs. So an automaton whose state holds, for each place where a token may still begin, the token
before it and the node of the vocabulary's trie reached since, reads a piece byte by byte and always knows the one
encoding of what it has read. Determinising it gives a transducer: every transition carries the tokens it settles,
every state the tokens that its end adds. Its states are compiled when they are first met, and the compiled tables
are dropped and begun anew at a bound, so that memory doesn't grow with the corpus.

Texts are cut into words, words into pieces by the tokenizer's own rule; the transducer runs over all different pieces
of new words at once, one byte a step. Words that a task has met keep their counts in a table that compares their
bytes. White space resets the transducer, so a text's count is the sum over its words. Pieces of over CHUNK bytes are cut;
each chunk has a state map, from the states that the bytes before it lead to, to exit state and count; all chunks advance
side by side, and their maps compose in a tree, as a parallel prefix scan does. A map that lacks an entry is run for it
when it is composed, so the count is exact; maps of all states that may be would have to compile them all.

Null and empty texts have 0 tokens; special strings count as one token each, as the library does by default. Repeated
rows are counted each on its own, an empty table gives no rows; other columns pass through, whatever their names, but
for one of the result's own name. A text takes some forty times its bytes while it is counted.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, held, table
from .wordcache import WordTable

CHUNK, WARM = 256, 64
#: Compiled states at which the tables are dropped.
MOST_STATES = 100_000


def byte_of_char() -> dict[str, int]:
    """The byte for each character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts of BPE tokens of pieces, for a vocabulary of merges with an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = byte_of_char()
        strip = lambda t: (t[: -len(suffix)], True) if suffix and t.endswith(suffix) else (t, False)
        # Tokens by number: 0-255 the bytes, 256-511 the last bytes of pieces, then the merges in order of rank.
        number = {(c, last): b + 256 * last for c, b in chars.items() for last in (False, True)}
        self.left, self.right, self.merged = list(range(512)), list(range(512)), {}
        self.spelled: list[tuple[bytes, bool]] = [(bytes([b]), last) for last in (False, True) for b in range(256)]
        for merge in merges:
            first, second = merge if isinstance(merge, list) else merge.split(" ")
            a, b = number[strip(first)], number[strip(second)]
            n = len(self.left)
            self.left.append(a)
            self.right.append(b)
            self.merged.setdefault((a, b), n)
            self.spelled.append((self.spelled[a][0] + self.spelled[b][0], self.spelled[b][1]))
            number[strip(first + second)] = n
        self.child: dict[tuple[int, int], int] = {}
        self.inner, self.last = [-1], [-1]  # token that ends at a node, inside a piece and at its end
        for n, (word, ends) in enumerate(self.spelled):
            node = 0
            for b in word:
                node = self.child.setdefault((node, b), len(self.inner))
                if node == len(self.inner):
                    self.inner.append(-1)
                    self.last.append(-1)
            (self.last if ends else self.inner)[node] = n
        self.classes = np.zeros(256, np.int64) - 1
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((-1, 0, 0),)]
        self.known = {self.states[0]: 0}
        self.agree: dict[tuple[int, int], bool] = {}
        wide = max(64, int(self.classes.max()) + 1)
        # Transitions hold next state * 16 + tokens settled; a step settles fewer than 16, as no token is that deep in merges.
        self.next = np.full((1024, wide), -1, np.int32)
        self.end = np.full((1024, wide), -1, np.int8)

    def valid(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are the encoding of their bytes.

        Undo merges from the last on; no two parts that meet at the border may have a merge that came before the
        next one that touches either.
        """
        key = (a, b)
        if key not in self.agree:
            limit, ok = len(self.left), True
            while True:
                if self.merged.get((a, b), limit) < limit:
                    ok = False
                    break
                if a < 512 and b < 512:
                    break
                if b < 512 or (a >= 512 and a > b):
                    limit, a = a, self.right[a]
                else:
                    limit, b = b + 1, self.left[b]
            self.agree[key] = ok
        return self.agree[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition of a state on an inner byte: next state and tokens settled."""
        found, token, count = [], -1, 0
        for before, node, extra in self.states[state]:
            node = self.child.get((node, byte), -1)
            if node >= 0:
                found.append((before, node, extra))
                t = self.inner[node]
                if t >= 0 and (before < 0 or self.valid(before, t)):
                    token, count = t, extra + 1
        found.append((token, 0, count))
        least = min(x[2] for x in found)
        to = tuple((before, node, extra - least) for before, node, extra in found)
        if to not in self.known:
            self.known[to] = len(self.states)
            self.states.append(to)
            if len(self.states) > len(self.next):
                self.next, self.end = (np.concatenate([t, np.full_like(t[: len(t) // 2], -1)]) for t in (self.next, self.end))
        return self.known[to], least

    def link(self, state: int, byte: int) -> int:
        to, n = self.step(state, byte)
        if n > 15:
            raise ValueError("a transition settles too many tokens")
        self.next[state, self.classes[byte]] = made = to << 4 | n
        return made

    def finish(self, state: int, byte: int) -> int:
        """Tokens still to add when a piece ends with this byte."""
        for before, node, extra in self.states[state]:
            node = self.child.get((node, byte), -1)
            if node >= 0 and (t := self.last[node]) >= 0 and (before < 0 or self.valid(before, t)):
                return extra + 1
        raise ValueError("no encoding")

    def columns(self, values: np.ndarray) -> np.ndarray:
        """Table columns of bytes; new bytes get one."""
        for b in np.unique(values[self.classes[values] < 0]).tolist():
            self.classes[b] = self.classes.max() + 1
            if self.classes[b] >= self.next.shape[1]:
                self.next, self.end = (np.concatenate([t, np.full_like(t[:, :32], -1)], axis=1) for t in (self.next, self.end))
        return self.classes[values]

    def _compile(self, states: np.ndarray, values: np.ndarray, at: np.ndarray, last: bool) -> None:
        for key in np.unique(states[at] * 256 + values[at]).tolist():
            s, b = key >> 8, key & 255
            if last:
                self.end[s, self.classes[b]] = self.finish(s, b)
            else:
                self.link(s, b)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]; all pieces advance together."""
        size = ends - starts
        out = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(size > CHUNK).tolist():
            out[i] = self.scan(data[starts[i] : ends[i]])
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= CHUNK)]
        if not len(order):
            return out
        if len(self.states) > MOST_STATES:
            self.reset()
        begin, size, state, total = starts[order], size[order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces of at least so many bytes
        for k in range(int(size[0])):
            now, more = int(alive[k]), int(alive[k + 1]) if k + 1 < size[0] else 0
            values = data[begin[:now] + k]
            column = self.columns(values)
            for last, part in ((False, slice(0, more)), (True, slice(more, now))):
                s, c = state[part], column[part]
                if not len(s):
                    continue
                to = (self.end if last else self.next)[s, c]
                if len(miss := np.flatnonzero(to < 0)):
                    self._compile(s, values[part], miss, last)
                    to = (self.end if last else self.next)[s, c]
                if last:
                    total[part] += to
                else:
                    total[part] += to & 15
                    state[part] = to >> 4
        out[order] = total
        return out

    def take(self, states: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Transitions of states on inner bytes, compiled where they are new."""
        column = self.columns(values)
        to = self.next[states, column]
        if len(miss := np.flatnonzero(to < 0)):
            self._compile(states, values, miss, False)
            to = self.next[states, column]
        return to

    def advance(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens settled by data[begin:end], each entered in a state; all advance together."""
        states, total = states.astype(np.int64), np.zeros(len(states), np.int64)
        for k in range(int((end - begin).max(initial=0))):
            live = np.flatnonzero(begin + k < end)
            to = self.take(states[live], data[begin[live] + k])
            total[live] += to & 15
            states[live] = to >> 4
        return states, total

    def entries(self, piece: np.ndarray, at: int) -> np.ndarray:
        """The states that piece[:at] most likely leads to: a start some bytes before it, after which states mostly agree."""
        begin = np.unique(np.maximum(0, at - np.array([WARM, 2 * WARM])))
        return np.unique(self.advance(piece, begin, np.full(len(begin), at), np.zeros(len(begin), np.int64))[0])

    def compose(self, piece: np.ndarray, first: "ChunkMap", second: "ChunkMap") -> "ChunkMap":
        """The map of two neighbouring ranges; exits that the second has no entry for are run over its whole range now."""
        if len(new := np.setdiff1d(first.exits, second.states)):
            n = len(new)
            exits, counts = self.advance(piece, np.full(n, second.begin), np.full(n, second.end), new)
            order = np.argsort(states := np.append(second.states, new))
            second = ChunkMap(second.begin, second.end, states[order], np.append(second.exits, exits)[order], np.append(second.counts, counts)[order])
        at = np.searchsorted(second.states, first.exits)
        return ChunkMap(first.begin, second.end, first.states, second.exits[at], first.counts + second.counts[at])

    def chunk_maps(self, piece: np.ndarray) -> list["ChunkMap"]:
        """The maps of all chunks of a piece but for its last byte."""
        cuts = [*range(0, len(piece) - 1, CHUNK), len(piece) - 1]
        sets = [self.entries(piece, a) for a in cuts[:-1]]
        n = [len(x) for x in sets]
        exits, counts = self.advance(piece, np.repeat(cuts[:-1], n), np.repeat(cuts[1:], n), np.concatenate(sets))
        at = np.cumsum([0, *n])
        return [ChunkMap(a, b, x, exits[i:j], counts[i:j]) for a, b, x, i, j in zip(cuts, cuts[1:], sets, at, at[1:], strict=False)]

    def scan(self, piece: np.ndarray) -> int:
        """Count of one long piece: its chunks' maps, composed in a tree."""
        maps = self.chunk_maps(piece)
        while len(maps) > 1:
            maps = [self.compose(piece, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        at = int(np.searchsorted(maps[0].states, 0))
        return int(maps[0].counts[at]) + self.finish(int(maps[0].exits[at]), int(piece[-1]))


@dataclass
class ChunkMap:
    """What reading data[begin:end] does to states (sorted): where they go and how many tokens that settles."""

    begin: int
    end: int
    states: np.ndarray
    exits: np.ndarray
    counts: np.ndarray


class Counter:
    """Token counts of texts for a tokenizer file: NFC, lower case, pieces by its pattern, BPE of the pieces' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, parts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            raise ValueError("this transducer reads word-level BPE files with NFC, Replace, Lowercase; Split, ByteLevel")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"] + "|\n")
        self.table = WordTable(lambda words: (np.zeros(0, np.uint32), self.words(words.to_pylist())))
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")

    def normalise(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def words(self, words: list[str]) -> np.ndarray:
        """Token counts of different words without white space."""
        extra = np.zeros(len(words), np.int64)
        plain = list(words)
        for i, w in enumerate(words):
            if "<|" in w:  # special strings are one token each and are found before anything else
                for s in self.special:
                    extra[i] += plain[i].count(s)
                    plain[i] = plain[i].replace(s, " ")
        found = self.pattern.findall(self.normalise("\n".join(plain) + "\n"))
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        names = coded.dictionary
        offsets = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
        data = np.frombuffer(names.buffers()[2], np.uint8) if names.buffers()[2] else np.zeros(0, np.uint8)
        line = pc.equal(names, "\n").to_numpy(zero_copy_only=False)
        size = np.where(line, 0, np.diff(offsets))
        each = self.machine.counts(data, offsets[:-1], offsets[:-1] + size)
        codes = coded.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(each[codes])])
        at = np.flatnonzero(line[codes])
        return np.diff(total[np.concatenate([[0], at + 1])]) + extra  # a newline ends each word

    def __call__(self, arr: pa.LargeStringArray) -> np.ndarray:
        """Token counts of texts."""
        return self.table.sizes(arr)


def split_words(arr: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray, np.ndarray]:
    """The texts' words [^\\x20\\x09-\\x0D]+: codes in order, the different words, and each text's first code."""
    split = pc.ascii_split_whitespace(arr)
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    there = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = flat.filter(there).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, kept[offsets - offsets[0]]


_MADE: dict[str, Counter] = held()


def counter(path: str) -> Counter:
    """One compiled counter in each worker process."""
    if path not in _MADE:
        _MADE[path] = Counter(path)
    return _MADE[path]


def vocabulary(name: str) -> str:
    """Where the installed tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, into: str = "tokens", text: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """docs with a struct `into`: n_bytes (UTF-8) and n_tokens of the whole text."""

    def make():
        run = counter(vocabulary(tokenizer))
        return lambda arr: {"n_bytes": pc.binary_length(arr), "n_tokens": run(arr)}

    return annotate(docs, make, "n_bytes bigint, n_tokens bigint", into, text, 8 << 20)


def op5(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    got = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("tokens.n_bytes").alias("n_bytes"), F.col("tokens.n_tokens").alias("n_tokens"), (F.col("tokens.n_tokens") > limit).alias("over_limit"))
