"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Two token sequences of one byte string have a shared cut wherever tokens of both end. ``groups``
finds all of them by halving: it seeks a common end near the middle of an interval by bisection,
leaping from one sequence's ends to the other's, and goes on in both halves; an interval without
an inner common end is a group. A single space after a character that is no white space is a
shared cut known beforehand, because neither tokenizer lets a token cross it and both encode
the two sides independently. Texts are divided there first, and the part between two
such cuts (mostly a word) is encoded and halved once per worker and cache.

The last tokens of a group end together and are linked. Of two linked tokens the shorter one's
bytes end the longer one's, so the number of id pairs is bounded by the two vocabularies
(``possible_pairs``) whatever the size of the corpus. Every task adds up its own pairs, the sums are
added by pair, and the table of counts, checked against the bound, goes to all executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, gather, kept, texts_of, worker_state
from wayfold.llm.units import LONGEST_CACHED, SPACE, library, split_all, sums

BATCH_BYTES = 1_000_000
#: Parts kept by a worker.
PARTS_KEPT = 250_000
BLANK = "▁"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
#: A space after white space is no known cut.
IRREGULAR = re.compile(f"[{SPACE}] ")
PARTS = re.compile(f"(?<=[^{SPACE}]) ")
LINES = re.compile(f"(?<=[^{SPACE}])\n")
#: Parts of one encoded text, and the word before the first, so that no part is at the beginning.
BLOCK, OPENER = 1024, "a"
#: Before a part without a space in front; no text holds half of a surrogate pair.
DIRECT = "\ud800"
#: Marks that can be a cut after a letter; an apostrophe isn't, as it may begin a contraction.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
AFTER_LETTER = {m: re.compile(f"[A-Za-z]{re.escape(m)}".encode()) for m in MARKS}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes in order for those from U+0100.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer's file; added tokens by their text."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    alphabet = byte_alphabet()
    found = {i: bytes(alphabet[c] for c in t) for t, i in data["model"]["vocab"].items() if all(c in alphabet for c in t)}
    found |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", []) if t["id"] not in found}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a SentencePiece model: U+2581 is a space, <0xHH> a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a piece crosses from one word into the next")
    out = []
    for i, piece in enumerate(pieces):
        single = BYTE_PIECE.fullmatch(piece) if model.is_byte(i) else None
        out.append(bytes([int(single[1], 16)]) if single else piece.replace(BLANK, " ").encode())
    return out


def possible_pairs(left: list[bytes], right: list[bytes]) -> int:
    """How many pairs (left id, right id) there are of which one's bytes end the other's."""

    def endings(of: list[bytes], within: list[bytes], proper: int) -> int:
        ids: dict[bytes, int] = {}
        for token in of:
            ids[token] = ids.get(token, 0) + 1
        return sum(ids.get(token[k:], 0) for token in within for k in range(proper, len(token)))

    return endings(right, left, 0) + endings(left, right, 1)


def groups(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of left, tokens of right) up to each shared cut, ascending; both are ascending ends with an equal last one.

    All open intervals are halved at once, level by level.
    """
    if not len(left) or not len(right) or left[-1] != right[-1]:
        raise ValueError("both sequences must end together")
    cut_left, cut_right = [np.array([len(left)])], [np.array([len(right)])]
    # Inner ends of the open intervals: left[a0:a1] and right[b0:b1].
    a0, a1, b0, b1 = (np.array([k]) for k in (0, len(left) - 1, 0, len(right) - 1))
    while len(a0):
        i, j = near_middle(left, right, a0, a1, b0, b1)
        found = i >= 0
        i, j, a0, a1, b0, b1 = (x[found] for x in (i, j, a0, a1, b0, b1))
        cut_left.append(i + 1)
        cut_right.append(j + 1)
        a0, a1 = np.concatenate([a0, i + 1]), np.concatenate([i, a1])
        b0, b1 = np.concatenate([b0, j + 1]), np.concatenate([j, b1])
        wide = (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
    return np.sort(np.concatenate(cut_left)), np.sort(np.concatenate(cut_right))


def near_middle(left: np.ndarray, right: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a common end among left[a0:a1] and right[b0:b1] of each interval, -1 where there is none.

    From the middle a search goes up and one goes down; each leaps to the place of the other sequence's
    next end by bisection, until the ends are equal or the interval is left.
    """
    i, j = np.full(len(a0), -1), np.full(len(a0), -1)
    live = np.flatnonzero((a0 < a1) & (b0 < b1))
    low = np.minimum(left[a0[live]], right[b0[live]])
    middle = (low + np.maximum(left[a1[live] - 1], right[b1[live] - 1]) + 1) // 2
    up_a, up_b = (np.clip(np.searchsorted(x, middle), first[live], last[live]) for x, first, last in ((left, a0, a1), (right, b0, b1)))
    down_a, down_b = up_a - 1, up_b - 1
    while len(live):
        goes_up = (up_a < a1[live]) & (up_b < b1[live])
        x, y = left[np.minimum(up_a, len(left) - 1)], right[np.minimum(up_b, len(right) - 1)]
        hit = goes_up & (x == y)
        goes_down = (down_a >= a0[live]) & (down_b >= b0[live])
        u, v = left[np.maximum(down_a, 0)], right[np.maximum(down_b, 0)]
        other = goes_down & (u == v) & ~hit
        for at, p, q in ((hit, up_a, up_b), (other, down_a, down_b)):
            i[live[at]], j[live[at]] = p[at], q[at]
        stay = (goes_up | goes_down) & ~hit & ~other
        live, up_a, up_b, down_a, down_b, x, y, u, v = (z[stay] for z in (live, up_a, up_b, down_a, down_b, x, y, u, v))
        behind, ahead = x < y, u > v
        up_a = np.where(behind, np.searchsorted(left, y), up_a)
        up_b = np.where(behind, up_b, np.searchsorted(right, x))
        down_a = np.where(ahead, np.searchsorted(left, v, side="right") - 1, down_a)
        down_b = np.where(ahead, down_b, np.searchsorted(right, u, side="right") - 1)
    return i, j


def parts(text: str, lines: bool = True) -> list[str]:
    """Keys of the parts between a text's known cuts, of a space and the text.

    A key is the part without its first space, or, for a part that begins with a line feed, DIRECT and the part.
    """
    if not text:
        return []
    if lines and "\n" in text:
        text = LINES.sub(f" {DIRECT}\n", text)
    return PARTS.split(text) if text[0] == " " or IRREGULAR.search(text) else text.split(" ")


def part_of(key: str) -> str:
    return key[1:] if key[:1] == DIRECT else " " + key


class Pair(NamedTuple):
    """The two tokenizers of one worker."""

    left: object
    right: object
    left_bytes: list[bytes]
    right_bytes: list[bytes]


class PartTable:
    """Alignment of parts, kept under a limit: token numbers, groups as text, and pairs of linked ids."""

    def __init__(self, tokenizers: Pair, limit: int = PARTS_KEPT):
        self.t, self.limit = tokenizers, limit
        self.width = len(tokenizers.right_bytes)
        self.left_sizes, self.right_sizes = (np.array(list(map(len, b)), np.int64) for b in (tokenizers.left_bytes, tokenizers.right_bytes))
        # A token's text in the groups: within its side, last of the left side, within the right side, last of the group.
        self.said = [f"{i}{mark}" for names, marks in ((self.left_sizes, ",|"), (self.right_sizes, ",;")) for mark in marks for i in range(len(names))]
        #: A line feed is a cut where no piece holds one.
        self.lines = not any(b"\n" in b and b != b"\n" for b in tokenizers.right_bytes)
        #: Marks that follow a Latin letter in no piece: a part's stem and its closing marks share no token.
        self.marks = "".join(m for m in MARKS if not any(AFTER_LETTER[m].search(b) for b in tokenizers.right_bytes))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.n_left, self.n_right, self.n_groups, self.starts, self.flat = array("i"), array("i"), array("i"), array("q"), array("q")

    def add(self, keys: list[str]) -> None:
        """Encodes and aligns new parts, as few texts of many parts; one that would spoil its neighbours is a text of its own."""
        alone = [k for k in keys if not k or k[-1] in SPACE or BLANK in k or k[0] == DIRECT and k[1] in MARKS]
        odd = set(alone)
        together = [k for k in keys if k not in odd]
        blocks = [together[at : at + BLOCK] for at in range(0, len(together), BLOCK)] + [[k] for k in alone]
        texts = [OPENER + "".join(map(part_of, block)) for block in blocks]
        lefts = [e.ids for e in self.t.left.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        for block, text, a, b in zip(blocks, texts, lefts, self.t.right.encode(texts, num_threads=1)):
            if not self.enter(block, text, a, b):
                if len(block) > 1:
                    self.add_singly(block)
                else:
                    self.note(block, np.zeros(1, int), np.zeros(1, int), np.full(1, -1), [""], np.zeros(0, np.int64))

    def add_singly(self, block: list[str]) -> None:
        for key in block:
            text = OPENER + part_of(key)
            a, b = self.t.left.encode(" " + text, add_special_tokens=False).ids, self.t.right.encode(text)
            if not self.enter([key], text, a, b):
                self.note([key], np.zeros(1, int), np.zeros(1, int), np.full(1, -1), [""], np.zeros(0, np.int64))

    def enter(self, block: list[str], text: str, a: list[int], b: list[int]) -> bool:
        """Notes the parts of a text behind its opener; False if a tokenizer doesn't give the bytes back or a part's end is no cut."""
        raw = (" " + text).encode()
        if b"".join([self.t.left_bytes[i] for i in a]) != raw or b"".join([self.t.right_bytes[i] for i in b]) != raw:
            return False
        a, b = np.array(a), np.array(b)
        cut_a, cut_b = groups(np.cumsum(self.left_sizes[a]), np.cumsum(self.right_sizes[b]))
        ends = np.cumsum([len(OPENER) + 1] + [len(part_of(k).encode()) for k in block])
        last = np.searchsorted(np.cumsum(self.left_sizes[a])[cut_a - 1], ends)
        if not np.array_equal(np.cumsum(self.left_sizes[a])[cut_a[last] - 1], ends):
            return False
        links = a[cut_a - 1] * self.width + b[cut_b - 1]
        # The tokens' texts group by group: all of the left side, then all of the right.
        of_a, of_b = np.searchsorted(cut_a, np.arange(len(a)), side="right"), np.searchsorted(cut_b, np.arange(len(b)), side="right")
        place = np.concatenate([np.arange(len(a)) + np.append(0, cut_b)[of_a], np.arange(len(b)) + cut_a[of_b]])
        n = len(self.left_sizes)
        word = np.concatenate([a, b + 2 * n])
        word[cut_a - 1] += n
        word[len(a) + cut_b - 1] += self.width
        line = np.empty(len(word), np.int64)
        line[place] = word
        said = list(map(self.said.__getitem__, line.tolist()))
        stops = (cut_a[last] + cut_b[last]).tolist()
        names = ["".join(said[p:q]) for p, q in zip(stops, stops[1:])]
        self.note(block, np.diff(cut_a[last]), np.diff(cut_b[last]), np.diff(last), names, links[last[0] + 1 :])
        return True

    def note(self, keys: list[str], n_left: np.ndarray, n_right: np.ndarray, n_groups: np.ndarray, names: list[str], links: np.ndarray) -> None:
        """Appends parts; -1 groups mark one that isn't given back byte by byte."""
        self.index.update(zip(keys, range(len(self.names), len(self.names) + len(keys))))
        self.names += names
        sizes = np.maximum(n_groups, 0)
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        for store, values in ((self.n_left, n_left), (self.n_right, n_right), (self.n_groups, n_groups)):
            store.frombytes(values.astype(np.int32).tobytes())
        self.flat.frombytes(links.astype(np.int64).tobytes())

    def halves(self, key: str) -> tuple[str, str]:
        """The keys of a part's stem and of its closing marks; the latter is empty where there is no cut between them."""
        stem = key.rstrip(self.marks)
        cut = stem and len(stem) < len(key) and stem[-1].isascii() and stem[-1].isalpha()
        return (stem, DIRECT + key[len(stem) :]) if cut else (key, "")

    def rows(self, keys: list[str]) -> np.ndarray:
        """The row of each key; new parts are encoded together, those with closing marks put together from their halves."""
        if len(self.index) > self.limit:
            self.clear()
        fresh = list(set(keys).difference(self.index))
        ended, halves, single = [], [], set()
        for key in fresh:
            stem, tail = self.halves(key)
            if tail:
                ended.append(key)
                halves += (stem, tail)
            else:
                single.add(key)
        new = list(single.union(halves).difference(self.index))
        for at in range(0, len(new), 8 * BLOCK):
            self.add(new[at : at + 8 * BLOCK])
        if ended:
            two = np.fromiter(map(self.index.__getitem__, halves), np.int64, len(halves)).reshape(-1, 2)
            count = lambda c: np.frombuffer(c, np.int32)[two]
            whole = (count(self.n_groups) >= 0).all(axis=1)
            self.add([key for key, good in zip(ended, whole) if not good])
            two, ended = two[whole], [key for key, good in zip(ended, whole) if good]
            n_left, n_right, n_groups = (count(c).sum(axis=1) for c in (self.n_left, self.n_right, self.n_groups))
            names = [self.names[p] + self.names[q] for p, q in two.tolist()]
            self.note(ended, n_left, n_right, n_groups, names, self.pairs(two.ravel()))
        out = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        for key in fresh + new:
            if len(key) > LONGEST_CACHED:
                self.index.pop(key, None)
        return out

    def pairs(self, rows: np.ndarray) -> np.ndarray:
        n = np.maximum(np.frombuffer(self.n_groups, np.int32)[rows], 0)
        return gather(np.frombuffer(self.flat, np.int64), np.frombuffer(self.starts, np.int64)[rows], n)


def tokenizer_pair(left: str, right: str) -> Pair:
    from sentencepiece import SentencePieceProcessor

    found = library(left)
    found.encode_special_tokens = True
    return Pair(found, SentencePieceProcessor(model_file=right), byte_level_tokens(left), piece_tokens(right))


def aligned(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows of two kinds. Documents: (id, n_a, n_b, n_groups, groups, groups_sha256, links); pairs: (pair, times) of one task.

    ``links`` holds the pairs of linked ids in order, little-endian 64-bit; a pair is a * (ids of the right
    tokenizer) + b. ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids. Null and empty texts, and
    texts that a tokenizer doesn't give back byte by byte, have no tokens and no groups.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = worker_state(("alignment", left, right), lambda: PartTable(tokenizer_pair(left, right)))
        total, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        none = lambda n, t: pa.nulls(n, t)
        id_type = None
        for batch in by_size(batches, "text", batch_bytes):
            id_type = batch.schema.field(0).type
            texts = texts_of(batch, "text")
            keys, sizes = split_all(texts, lambda text: parts(text, found.lines))
            at = found.rows(keys)
            del keys
            n_groups = np.frombuffer(found.n_groups, np.int32)[at] if len(at) else np.zeros(0, np.int32)
            whole = sums(n_groups < 0, sizes) == 0
            used = np.repeat(whole, sizes)
            at, sizes = at[used], np.where(whole, sizes, 0)
            count = lambda c: sums(np.frombuffer(c, np.int32)[at] if len(at) else np.zeros(0, np.int64), sizes)
            n_a, n_b, n_g = count(found.n_left), count(found.n_right), count(found.n_groups)
            links = found.pairs(at) if len(at) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            stops = np.concatenate([[0], np.cumsum(n_g)])
            places, hashes, raw = at.tolist(), [], links.astype("<u8").tobytes()
            for k in range(len(texts)):
                said = "".join([found.names[p] for p in places[ends[k] : ends[k + 1]]])
                hashes.append(hashlib.sha256(said[:-1].encode()).hexdigest() if said else "")
            packed = [raw[8 * a : 8 * z] for a, z in zip(stops, stops[1:])]
            waiting.append(np.unique(links, return_counts=True))
            if len(waiting) == 16:
                total, times = added(total, times, waiting)
                waiting = []
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_g, pa.int64()),
                 pa.array(hashes, pa.string()), pa.array(packed, pa.binary()), none(n, pa.int64()), none(n, pa.int64())], names=NAMES)
        total, times = added(total, times, waiting)
        for at in range(0, len(total), 100_000):
            some, n = total[at : at + 100_000], len(total[at : at + 100_000])
            yield pa.RecordBatch.from_arrays(
                [none(n, id_type), *[none(n, pa.int64())] * 3, none(n, pa.string()), none(n, pa.binary()),
                 pa.array(some, pa.int64()), pa.array(times[at : at + n], pa.int64())], names=NAMES)

    return rows.mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, times long"
    )


NAMES = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "times"]


def added(total: np.ndarray, times: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their counts of a running sum and more counted pairs."""
    if not more:
        return total, times
    keys, at = np.unique(np.concatenate([total, *[m[0] for m in more]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([times, *[m[1] for m in more]]), len(keys)).astype(np.int64)


class Counts(NamedTuple):
    pairs: np.ndarray
    times: np.ndarray
    best: np.ndarray


def pair_counts(rows: DataFrame, left: str, right: str) -> Counts:
    """Links of each pair in the whole corpus, and whether that is the most of its right id.

    The table has at most ``possible_pairs`` rows, a figure of the two vocabularies that doesn't grow with
    the corpus; more rows raise an error.
    """
    right_bytes = piece_tokens(right)
    bound = possible_pairs(byte_level_tokens(left), right_bytes)
    summed = rows.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("times"))
    if summed.count() > bound:
        raise RuntimeError("more pairs of linked ids than the vocabularies allow")
    found = summed.toArrow()
    pairs, times = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(pairs)
    pairs, times = pairs[order].astype(np.int64), times[order].astype(np.int64)
    most = np.zeros(len(right_bytes), np.int64)
    np.maximum.at(most, pairs % len(right_bytes), times)
    return Counts(pairs, times, times == most[pairs % len(right_bytes)])


def align(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``left``: file of a byte-level tokenizer; ``right``: SentencePiece model whose pieces don't cross words.
    A pair's count is the number of links that hold it in all of ``docs``; ``n_best``: links whose
    count is the highest of their right id; ``count_sum``: the counts of a document's links
    together. Rows without tokens (null, empty, or not given back byte by byte) have zeros and an
    empty ``groups_sha256``. Repeated rows count each, null ids stay null, other columns
    are ignored, an empty table gives an empty result.
    """
    stored = kept(aligned(docs, left, right, id_col, text_col, batch_bytes), docs.sparkSession)
    counts = pair_counts(stored, left, right)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(counts))  # bounded by the vocabularies
    rows = stored.filter("pair IS NULL").select("id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    kind = dict(rows.dtypes)["id"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, best = shared.value
        for batch in by_size(batches, "links", 8_000_000):
            raw = batch.column(5).to_pylist()
            n_links = np.array([len(r) // 8 for r in raw], np.int64)
            at = np.searchsorted(pairs, np.frombuffer(b"".join(raw), "<u8").astype(np.int64))
            n_best = sums(best[at], n_links) if len(at) else np.zeros(len(raw), np.int64)
            total = sums(times[at], n_links) if len(at) else np.zeros(len(raw), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n_links), pa.array(n_best.astype(np.int64)), pa.array(total.astype(np.int64)), batch.column(4)],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = rows.mapInArrow(
        weigh, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)
