"""Encoders that are exact with their libraries and fast on whole corpora.

Both rest on one property: no merge of the vocabulary crosses certain places
of a text, so the pieces between such places encode alone. Each distinct piece
is encoded once by the library and its ids are kept in flat arrays; a text is
then a list of piece numbers, and its ids are one gather.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import engine

#: Distinct words that an encoder keeps until it begins anew: the bound is on memory, never on a result.
MAX_STORED = 600_000
#: New words that are encoded at once; it bounds memory only.
AT_ONCE = 4096
#: Words that need no normalising but lower case, and are split into letters and one run of signs; none of these signs begins a contraction.
SIMPLE = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")


class Store:
    """Flat arrays of the ids of distinct words."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.count, self.ids = array("q"), array("q"), array("i")

    def add(self, keys: list[str], ids: list[int], counts: np.ndarray) -> np.ndarray:
        """Take in different new words with their ids in a row and how many each has; gives the words' numbers."""
        first = len(self.start)
        self.number.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.start.frombytes((np.cumsum(counts) - counts + len(self.ids)).tobytes())
        self.count.frombytes(counts.tobytes())
        self.ids.extend(ids)
        return np.arange(first, first + len(keys))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each word has."""
        start, count = np.frombuffer(self.start, np.int64)[numbers], np.frombuffer(self.count, np.int64)[numbers]
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.frombuffer(self.ids, np.int32)[at], count


#: Alternatives of a splitter's pattern that match no white space; one of letters alone, one of signs alone.
SPACELESS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"}


def words_stand_alone(spec: dict) -> bool:
    """Whether a vocabulary treats stretches between white space alone, as its normaliser, splitter and added tokens say."""

    def steps(part: str, inner: str) -> list[dict]:
        own = spec.get(part) or {}
        return own.get(inner, []) if own.get("type") == "Sequence" else [own] if own else []

    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    normal = [n for n in steps("normalizer", "normalizers") if n not in ({"type": "NFC"}, {"type": "Lowercase"}, blank)]
    split = steps("pre_tokenizer", "pretokenizers")
    if normal or {"type": "Lowercase"} not in steps("normalizer", "normalizers") or [s.get("type") for s in split] != ["Split", "ByteLevel"]:
        return False
    first, second = split
    added = spec.get("added_tokens") or []
    return (
        set(first.get("pattern", {}).get("Regex", "").split("|")) == SPACELESS
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and not second.get("add_prefix_space")
        and not second.get("use_regex")
        and spec.get("post_processor") is None
        and not any(a.get("normalized") or a.get("single_word") or any(map(str.isspace, a["content"])) or SIMPLE.fullmatch(a["content"].lower()) for a in added)
    )


class WordEncoder:
    """A vocabulary of the ``tokenizers`` library, with what a library call gives by default.

    Where words stand alone (``words_stand_alone``: composition never joins a
    space with what follows it, and the splitter's pattern matches no white
    space) each distinct word is encoded once. Words of plain letters, then
    plain signs, go straight to the library's merges, all others through its
    whole chain. Any other vocabulary gets whole texts through the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = words_stand_alone(json.load(f))
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x21, 0x100)) if SIMPLE.fullmatch(c)} | {0x20: " "}
        self.merge = self.tokenizer.model.tokenize
        self.kept = Store()

    def _ids(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of many words in a row, and how many each has."""
        matches = [SIMPLE.fullmatch(w) for w in " ".join(words).lower().split(" ")]
        parts = [m[1] + " " + m[2] if m and m[1] and m[2] else m[0] if m else "" for m in matches]
        ids: list[int] = []
        ends = [0]
        for word, match, spelt in zip(words, matches, "\n".join(parts).translate(self.spelt).split("\n"), strict=True):
            if match:
                for part in spelt.split(" "):
                    ids += [t.id for t in self.merge(part)] if part else ()
            else:
                ids += self.tokenizer.encode(word, add_special_tokens=False).ids
            ends.append(len(ids))
        return ids, np.diff(np.array(ends, np.int64))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is the empty text. Special strings of the vocabulary are their ids."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        if not len(texts):
            return []
        # an empty word stands where white space begins or ends a text; it has no ids
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        every = words.flatten().dictionary_encode()
        distinct = every.dictionary.to_numpy(zero_copy_only=False)
        if len(self.kept.number) > MAX_STORED:
            self.kept.clear()
        numbers = np.fromiter(map(self.kept.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = numbers < 0
        fresh = distinct[new].tolist()
        numbers[new] = np.concatenate([np.empty(0, np.int64), *(self.kept.add(lot, *self._ids(lot)) for lot in (fresh[k : k + AT_ONCE] for k in range(0, len(fresh), AT_ONCE)))])
        numbers, last = numbers[every.indices.to_numpy()], np.cumsum(pc.list_value_length(words).to_numpy())
        del words, every, distinct, fresh
        pa.default_memory_pool().release_unused()  # a worker's memory is shared with its executor
        ids, counts = self.kept.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return np.split(ids, ends[last][:-1])


def word_encoder(path: str) -> WordEncoder:
    return engine(("words", path), lambda: WordEncoder(path))
