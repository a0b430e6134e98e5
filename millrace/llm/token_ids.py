"""Token ids of whole texts, with each different word encoded once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .transducer import vocabulary
from .wordcache import WordTable

#: Tokenizers and word tables outlive a task: making them anew cost more than the memory of an idle worker.
_MADE: dict[str, object] = {}


def tokenizer(name: str):
    """The library's tokenizer, loaded once in each worker process."""
    if name not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _MADE[name] = Tokenizer.from_file(vocabulary(name))
        kind = _MADE[name].normalizer
        if kind is None or "Replace" not in repr(kind):
            raise ValueError("words are encoded on their own, so the tokenizer must drop white space")
    return _MADE[name]


#: Words that the normaliser changes letter by letter and that can be encoded side by side: printable ASCII and Latin-1 letters.
PLAIN = "^[\\x{21}-\\x{7E}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}]+$"
#: Fixed value: the pre-tokenizer's pattern, with upper-case contractions as they are before lower-casing.
PART = "(?i:'s|'t|'re|'ve|'m|'ll|'d)|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"


#: Plain characters beyond ASCII, in lower case, as the letters that stand for their two bytes in the vocabulary.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
SPELLED = {chr(c): "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


def _spelled(plain: str) -> str:
    for c, x in SPELLED.items():  # none of the letters put in is replaced later
        plain = plain.replace(c, x)
    return plain


@dataclass
class _Ends:
    """Which ids end a part of a word, and the model without its normaliser, for parts with spaces between.

    None if the vocabulary doesn't mark ends or treats words otherwise.
    """

    last: np.ndarray | None
    model: object = None


def _ends(name: str) -> _Ends:
    if name not in _ENDS:
        t = tokenizer(name)
        with open(vocabulary(name), encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        patterns = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [[x["type"] for x in (spec.get(step) or {}).get(name, [])] for step, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        levels = [(p["add_prefix_space"], p["use_regex"]) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]
        usual = kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and levels == [(False, False)] and all("<|" in x["content"] for x in spec.get("added_tokens") or [])
        last = model = None
        if usual and suffix and patterns == [PART.replace("(?i:", "").replace("'d)", "'d").replace("\\p{L}+|\\p{N}", "[\\p{L}]+|[\\p{N}]")]:
            last = np.zeros(t.get_vocab_size(), bool)
            last[[i for w, i in t.get_vocab().items() if w.endswith(suffix)]] = True
            from tokenizers import Tokenizer, pre_tokenizers

            model = Tokenizer.from_file(vocabulary(name))
            model.normalizer, model.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        _ENDS[name] = _Ends(last, model)
    return _ENDS[name]


_ENDS: dict[str, _Ends] = {}


def _one_by_one(words: list[str], name: str, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    t, ids, size = tokenizer(name), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), step):
        got = [e.ids for e in t.encode_batch_fast(words[i : i + step], add_special_tokens=False)]
        size.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(size[-1].sum())))
    return np.concatenate(ids), np.concatenate(size)


def _encode_words(words: pa.LargeStringArray, name: str, step: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words and how many each has.

    Plain words are lower-cased, parted and encoded many at a time with spaces between; ids that end a part, and how many
    parts each word has, tell where words end. Where the sums don't agree, and for other words, each is encoded on its own.
    """
    last, model = _ends(name).last, _ends(name).model
    plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False) if last is not None else np.zeros(len(words), bool)
    some, rest = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
    parted = pc.replace_substring_regex(pc.utf8_lower(some), PART, r"\0 ")
    parts, names = pc.count_substring(parted, " ").to_numpy(), parted.to_pylist()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lines = [_spelled("".join(names[i : i + step])) for i in range(0, len(names), step)]
    for i, e in zip(range(0, len(names), step), model.encode_batch_fast(lines, add_special_tokens=False) if lines else [], strict=True):
        ids = np.array(e.ids, np.uint32)
        ends, n = np.flatnonzero(last[ids]) + 1, parts[i : i + step]
        if len(ends) == n.sum() and n.all():
            found.append((ids, np.diff(ends[np.cumsum(n) - 1], prepend=0)))
        else:
            found.append(_one_by_one(some.slice(i, step).to_pylist(), name))
    found.append(_one_by_one(rest.to_pylist(), name))
    ids, size = (np.concatenate(x) for x in zip(*found, strict=True))
    # Back to the order of the words: the plain ones came first.
    order = np.empty(len(words), np.int64)
    order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
    begin, size_in_order = np.cumsum(size) - size, size[order]
    at = np.repeat(begin[order] - (np.cumsum(size_in_order) - size_in_order), size_in_order)
    return ids[at + np.arange(len(at))], size_in_order


_TABLES: dict[str, WordTable] = {}  # of bounded size


def encode(arr: pa.LargeStringArray, name: str = "word_bpe_49k.json") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's begin (n + 1 numbers).

    The tokenizer drops ASCII white space, and neither its normaliser nor its pieces cross it, so the ids of a
    text are those of its words.
    """
    if name not in _TABLES:
        tokenizer(name)
        _TABLES[name] = WordTable(lambda words: _encode_words(words, name))
    return _TABLES[name].all_values(arr)
