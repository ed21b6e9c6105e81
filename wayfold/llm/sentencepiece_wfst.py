"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a model file into three machines: the normaliser (a rewriting
transducer: escape of spaces, a space in front), the pieces (one path per piece from the
characters to its id) with byte fallback (a path from any other character to the ids of its
bytes), and an acceptor over pairs of ids. Encoding composes them with a text and takes the
shortest path in the tropical semiring:

* a unigram model weighs a piece by its negative score and accepts every pair;
* a BPE model weighs pieces by nothing and accepts a pair of ids (0, else infinity) exactly
  if merging the two pieces' characters by the model's priorities ends in this pair. A
  sequence of pieces is the result of the merges if and only if all its neighbours are such
  pairs, so the only path of finite weight is the library's encoding.

No piece goes on across a space into the next word, so the composed machine has one state
there, through which every path runs, and shortest paths are found word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, texts_of, worker_state
from wayfold.llm.units import MARKS, RAW, UnitTable, laid_flat, split_all, sums

SPACE = "▁"
BATCH_BYTES = 2_000_000
#: Fixed values of the model file: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
INFINITY = float("inf")
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Pairs of pieces and distinct words that a worker keeps.
PAIRS_KEPT, WORDS_KEPT = 200_000, 600_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model(NamedTuple):
    pieces: list[str]
    kinds: list[int]
    arcs: dict[str, tuple[int, float]]
    bytes: list[int]
    unknown: int
    merges: bool
    longest: int
    prefix: bool
    squeeze: bool


def compile_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, kinds, scores, kind, prefix, squeeze = [], [], [], UNIGRAM, True, True
    for number, value in fields(data):
        if number == 1:
            entry = dict(fields(value))
            pieces.append(entry[1].decode())
            scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(entry.get(3, NORMAL))
        elif number == 2:
            kind = dict(fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(fields(value))
            if rules.get(2) or not rules.get(5, 1):
                raise ValueError("only identity normalisation with escaped spaces is compiled")
            prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
    if kind not in (UNIGRAM, BPE) or USER in kinds:
        raise ValueError("only unigram and BPE models without user-defined symbols are compiled")
    arcs = {p: (i, -scores[i]) for i, p in enumerate(pieces) if kinds[i] == NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in arcs):
        raise ValueError("a piece crosses from one word into the next")
    found = {p: i for i, p in enumerate(pieces) if kinds[i] == BYTE}
    fallback = [found[f"<0x{b:02X}>"] for b in range(256)] if found else []
    return Model(pieces, kinds, arcs, fallback, kinds.index(UNKNOWN), kind == BPE, max(map(len, arcs)), prefix, squeeze)


class Transducer:
    """The composed machine of a model; one per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.pairs: dict[tuple[str, str], bool] = {}
        self.derivations: dict[str, tuple | None] = {}
        # Fixed rule of the library: an unknown character costs 10 more than the worst piece.
        self.unknown_cost = max(c for _, c in model.arcs.values()) + 10.0
        # Text of each id; bytes of ASCII characters stand alone, the others need their neighbours.
        self.plain = list(model.pieces)
        for b, i in enumerate(model.bytes):
            self.plain[i] = chr(b)
        for i, kind in enumerate(model.kinds):
            if kind in (UNKNOWN, CONTROL):
                self.plain[i] = ""
        self.high = set(model.bytes[128:])
        # Length of the longest piece by its first three characters; others have two at most.
        self.heads: dict[str, int] = {}
        for piece in model.arcs:
            if len(piece) > 2:
                self.heads[piece[:3]] = max(len(piece), self.heads.get(piece[:3], 0))
        # Marks that no piece holds behind a letter or a digit: no path runs across, so a word ends before them.
        behind = {b for piece in model.arcs for a, b in zip(piece, piece[1:]) if a.isalpha() or a in "0123456789"}
        self.tails = "".join(c for c in MARKS if c not in behind)

    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)

    def words(self, text: str) -> list[str]:
        """Words of the normalised text: where the composed machine has a single state."""
        text = self.normalise(text)
        if not text:
            return []
        if text[0] == SPACE and SPACE * 2 not in text and text[-1] != SPACE:
            return text[1:].split(SPACE)  # keys without the space in front
        return [RAW + w for w in WORDS.findall(text)]

    def derivation(self, piece: str):
        """How the merges build a piece from its characters: costs in order, and the first and last part after each.

        None for a piece that its own characters don't merge into.
        """
        known = self.derivations.get(piece, 0)
        if known != 0:
            return known
        parts, arcs = list(piece), self.model.arcs
        costs, firsts, lasts = [], [], []
        while len(parts) > 1:
            best, at = INFINITY, -1
            for k in range(len(parts) - 1):
                found = arcs.get(parts[k] + parts[k + 1])
                if found and found[1] < best:
                    best, at = found[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            costs.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        known = self.derivations[piece] = (costs, firsts, lasts) if len(parts) == 1 else None
        return known

    def accepts(self, left: str, right: str) -> bool:
        """Whether the merges of both pieces' characters end in this pair.

        Merges inside either piece go on as they would alone until one across the boundary is
        the best at hand; then the pair can't come out.
        """
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[pair] = self.apart(left, right)
        return known

    def apart(self, left: str, right: str) -> bool:
        one, two = self.derivation(left), self.derivation(right)
        if one is None or two is None:
            return False
        arcs = self.model.arcs
        costs, _, lasts = one
        others, firsts, _ = two
        i = j = 0
        a, b = left[-1], right[0]
        while True:
            across = arcs.get(a + b)
            x = across[1] if across else INFINITY
            c = costs[i] if i < len(costs) else INFINITY
            d = others[j] if j < len(others) else INFINITY
            if x < c and x <= d:
                return False
            if c == INFINITY and d == INFINITY:
                return True
            if c <= d:
                a, i = lasts[i], i + 1
            else:
                b, j = firsts[j], j + 1

    def shortest(self, word: str) -> list[int]:
        """Ids on the shortest path through the machine composed with a word."""
        arcs = self.model.arcs
        ids: list[int] = []
        for piece in self.finite_path(word) if self.model.merges else self.least_path(word):
            found = arcs.get(piece)
            if found:
                ids.append(found[0])
            elif self.model.bytes:
                ids += [self.model.bytes[b] for b in piece.encode("utf-8", "replace")]
            else:
                ids.append(self.model.unknown)
        return ids

    def finite_path(self, word: str) -> list[str]:
        """The path of finite weight through a BPE machine, depth first with the longest piece first.

        A state is a place and the last piece; one from which the end wasn't reached is not entered again.
        """
        arcs, pairs, heads, n = self.model.arcs, self.pairs, self.heads, len(word)
        path: list[str] = []
        dead: set[tuple[int, str]] = set()
        at, size = 0, min(heads.get(word[:3], 2), n)
        while at < n:
            while size:
                piece = word[at : at + size]
                if size == 1 or piece in arcs:
                    if path:
                        fits = pairs.get((path[-1], piece))
                        if fits is None:
                            fits = self.accepts(path[-1], piece)
                    else:
                        fits = self.derivation(piece) is not None
                    if fits and (not dead or (at + size, piece) not in dead):
                        break
                size -= 1
            if size:
                path.append(piece)
                at += size
                size = min(heads.get(word[at : at + 3], 2), n - at)
            elif path:
                last = path.pop()
                dead.add((at, last))
                at -= len(last)
                size = len(last) - 1
            else:
                raise ValueError("no path: the model's merges are not consistent")
        return path

    def least_path(self, word: str) -> list[str]:
        """The path of least weight through a unigram machine; of equal ones the one whose last piece is longest."""
        arcs, longest, n = self.model.arcs, self.model.longest, len(word)
        cost, came = [0.0] + [INFINITY] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                found = arcs.get(word[begin:end])
                if found is None and end - begin > 1:
                    continue
                total = cost[begin] + (found[1] if found else self.unknown_cost)
                if total < cost[end]:
                    cost[end], came[end] = total, begin
        path = []
        while n:
            path.append(word[came[n] : n])
            n = came[n]
        return path[::-1]

    def encode(self, keys: list[str]) -> list[list[int]]:
        return [self.shortest(k[1:] if k[0] == RAW else SPACE + k) if k else self.shortest(SPACE) for k in keys]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces, bytes joined to characters (invalid ones replaced), spaces back."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if self.model.prefix and text[:1] == " " else text
        out, raw = [], bytearray()
        low = self.model.bytes[0] if self.model.bytes else 0
        for i in ids:
            kind = self.model.kinds[i]
            if kind == BYTE:
                raw.append(i - low)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == NORMAL:
                out.append(self.model.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


def transducer(path: str) -> tuple[Transducer, UnitTable]:
    def make():
        machine = Transducer(compile_model(path))
        return machine, UnitTable(lambda keys: laid_flat(machine.encode(keys)), WORDS_KEPT, machine.tails, RAW)

    return worker_state(("transducer", path), make)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds ``ids`` (array of int) to all rows; a null or empty text has no ids.

    Other columns are kept; one named like ``ids_col`` raises. There is no shuffle.
    """
    if ids_col in docs.columns:
        raise ValueError(f"{ids_col} is a column already")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, found = transducer(model)
        for batch in by_size(batches, text_col, batch_bytes):
            keys, sizes = split_all(texts_of(batch, text_col), machine.words)
            rows = found.rows(keys)
            ends = np.concatenate([[0], np.cumsum(sums(found.counts(rows), sizes))]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ids(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, ids_col])

    fields_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields_of}, `{ids_col}` array<int>")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids give null, no ids the empty text."""
    if text_col in encoded.columns:
        raise ValueError(f"{text_col} is a column already")
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = transducer(model)
        for batch in batches:
            texts = [machine.decode(ids.as_py()) if ids.is_valid else None for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    fields_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields_of}, `{text_col}` string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_equal): encoding of each whole text, decoded again in the same task.

    ``decoded_equal``: the decoded text is the text, in which U+2581 counts as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, found = transducer(model)
        for batch in by_size(batches, "text", batch_bytes):
            texts = texts_of(batch, "text")
            keys, sizes = split_all(texts, machine.words)
            rows = found.rows(keys)
            del keys
            ends = np.concatenate([[0], np.cumsum(sums(found.counts(rows), sizes))]).astype(np.int32)
            ids = found.ids(rows)
            equal = [machine.decode(ids[a:z].tolist()) == t.replace(SPACE, " ") for a, z, t in zip(ends, ends[1:], texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
                 pa.array(np.diff(ends).astype(np.int64)), pa.array(equal, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "decoded_equal"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded_equal boolean")
