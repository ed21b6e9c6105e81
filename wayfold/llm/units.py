"""Encoding of whole texts through the distinct pieces between safe boundaries.

A boundary is safe if no token crosses it and neither side's tokens depend on the
other side. Texts repeat their words, so each distinct piece is encoded once per
worker and cache, and a text's ids are the pieces' ids in order. Nothing is
approximated; ``tests/llm`` compares whole texts with the libraries.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from wayfold.llm.common import gather, worker_state

#: The Unicode White_Space characters besides the space and the line feed.
OTHER_SPACE = (
    "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: Characters that str.split() takes as white space and Unicode's White_Space does not.
PYTHON_ONLY_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = " \n" + OTHER_SPACE
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORDS = re.compile(f"[^{SPACE}]+")
#: Outside of these characters lower case may depend on the neighbours or on the version of Unicode.
NO_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: A word that is one token of its own and set between words encoded as one text.
BETWEEN = "~"
#: ASCII marks at the end of a word. ">" isn't one of them, as it ends added tokens.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in BETWEEN + ">")
RAW = "\x00"
LONGEST_CACHED = 200


class UnitTable:
    """Ids of pieces, looked up by key; starts anew when it holds ``limit`` keys.

    ``encode`` gives (ids, starts, lengths) of a list of keys: the ids of key k are
    ``ids[starts[k] : starts[k] + lengths[k]]``. With ``tails``, a key that ends in these
    characters after a Latin letter or an ASCII digit is taken as its stem and its tail, which
    never share a token; ``lead`` stands before the tail, where that makes another key of it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple], limit: int = 200_000, tails: str = "", lead: str = ""):
        self.encode, self.limit, self.tails, self.lead = encode, limit, tails, lead
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.flat = array("q"), array("i"), array("i")

    def add(self, keys: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.index.update(zip(keys, range(len(self.starts), len(self.starts) + len(keys))))
        self.starts.frombytes((starts + len(self.flat)).astype(np.int64).tobytes())
        self.lengths.frombytes(lengths.astype(np.int32).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def halves(self, key: str) -> tuple[str, str]:
        """Stem and tail of a key; the tail is empty where nothing can be cut."""
        stem = key.rstrip(self.tails)
        # Other letters can end in a mark once they are normalised or lowered, which then joins the tail.
        cut = stem and len(stem) < len(key) and not NO_LATIN.match(stem[-1]) and (stem[-1].isalpha() or stem[-1] in "0123456789")
        return (stem, self.lead + key[len(stem) :]) if cut else (key, "")

    def rows(self, keys: list[str]) -> np.ndarray:
        """The row of each key; new keys are encoded together."""
        if len(self.index) > self.limit:
            self.clear()
        fresh = list(set(keys).difference(self.index))
        ended: list[str] = []
        halves: list[str] = []
        if self.tails:
            single = set()
            for key in fresh:
                stem, tail = self.halves(key)
                if tail:
                    ended.append(key)
                    halves += (stem, tail)
                else:
                    single.add(key)
            fresh = list(single.union(halves).difference(self.index))
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            self.add(some, *self.encode(some))
        if ended:
            parts = np.fromiter(map(self.index.__getitem__, halves), np.int64, len(halves))
            lengths = self.counts(parts)
            ids, whole = self.ids(parts), lengths.reshape(-1, 2).sum(axis=1)
            self.add(ended, ids, np.cumsum(whole) - whole, whole)
        out = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        for key in fresh + ended:
            if len(key) > LONGEST_CACHED:
                self.index.pop(key, None)
        return out

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.lengths, np.int32)[rows].astype(np.int64) if len(rows) else np.zeros(0, np.int64)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0, np.int32)
        starts, lengths = np.frombuffer(self.starts, np.int64), np.frombuffer(self.lengths, np.int32)
        return gather(np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32), starts[rows], lengths[rows])


def spaced_pieces(text: str) -> list[str]:
    """Keys of the pieces of a text, each a run of white space and the word after it.

    A piece starts at white space after a non-space. Key: the piece behind RAW, or,
    where all gaps are one space or one line feed, the word (for a space before it)
    or the line feed and the word.
    """
    if not text:
        return []
    plain = not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or RAW in text or any(c in text for c in OTHER_SPACE)
    )
    if not plain:
        return [RAW + p for p in PIECES.findall(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = RAW + keys[0]
    return keys


def piece_of(key: str) -> str:
    return key[1:] if key[0] == RAW else key if key[0] == "\n" else " " + key


def words(text: str) -> list[str]:
    """The runs of a text without white space; Latin texts in lower case.

    Added tokens are found in the text as it is written, so a text that may hold one keeps its case.
    """
    if "<|" not in text and not NO_LATIN.search(text):
        text = text.lower()
    return WORDS.findall(text) if any(c in text for c in PYTHON_ONLY_SPACE) else text.split()


def library(path: str):
    """A tokenizers tokenizer on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def laid_flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths) of lists of ids."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.array([i for some in lists for i in some], np.int32), np.cumsum(lengths) - lengths, lengths


def one_by_one(found, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths) of the keys, each encoded as a text of its own."""
    return laid_flat([e.ids for e in found.encode_batch_fast(keys, add_special_tokens=False)])


def together(found, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths) of words without white space, encoded as few texts with BETWEEN between them.

    One text for many words spares the library an object per word. Where a word holds BETWEEN
    itself, the marks don't match and all are encoded one by one.
    """
    texts = [f" {BETWEEN} ".join(keys[at : at + 256]) + f" {BETWEEN}" for at in range(0, len(keys), 256)]
    ids = np.array([i for e in found.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
    (mark,) = found.encode(BETWEEN, add_special_tokens=False).ids
    ends = np.flatnonzero(ids == mark)
    if len(ends) != len(keys):
        return one_by_one(found, keys)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    return ids, starts, ends - starts


def byte_level(path: str) -> UnitTable:
    """Pieces of a byte-level tokenizer, for which white space before a word belongs to it."""

    def make():
        found = library(path)
        return UnitTable(lambda keys: one_by_one(found, [piece_of(k) for k in keys]))

    return worker_state(("byte level", path), make)


def word_level(path: str) -> UnitTable:
    """Words of a tokenizer that drops white space and lowers case."""

    def make():
        found = library(path)

        def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return together(found, keys)

        return UnitTable(encode, 600_000, MARKS)

    return worker_state(("word level", path), make)


def split_all(texts: list[str], split: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray]:
    """Keys of all texts and the number of keys of each."""
    keys: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = split(text)
        sizes[i] = len(found)
        keys += found
    return keys, sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the consecutive groups of the given sizes, empty groups included."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
