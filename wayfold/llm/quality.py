"""Quality classifier: histogram gradient-boosted trees over document statistics.

*Statistics.* ``statistics`` computes ``FEATURES`` for a whole batch of texts at once with array
operations on their UTF-8 bytes: shares of byte classes, word and line forms, repeats of words,
word pairs and lines, and the worst block of ``BLOCK`` words, so that a spoilt passage of a
good text shows. Every text is read whole; nothing but its bytes counts.

*Training.* Logistic loss; values are binned at the sample's quantiles, each node sums gradients and
hessians per bin and splits where the gain is largest. The sample is bounded by
``MAX_LABELLED`` rows, in the order of a hash of the id; its statistics are computed on the executors
and only they (some 40 numbers a row) are gathered for the fit.

*Scoring.* The trees are flattened into arrays of one complete layout; all rows walk all trees
level by level with array indexing. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size

#: Bound of the labelled sample.
MAX_LABELLED = 50_000
TREES, DEPTH, BINS = 80, 5, 64
RATE, RIDGE, LEAST_HESSIAN = 0.15, 1.0, 3.0
BLOCK = 32
LONG_WORD, SHORT_LINE = 20, 4
BATCH_BYTES = 1_500_000
LOWER, UPPER, DIGIT, BLANK, NEWLINE, MARK, SHOUT, QUOTE, SYMBOL, BAR, HIGH = range(11)
FEATURES = (
    "log_bytes", "lower", "upper_of_letters", "digits", "blanks", "newlines", "marks", "shouts", "quotes", "symbols", "bars", "high",
    "log_words", "word_mean", "word_sd", "log_longest_word", "words_of_one", "words_long", "words_upper", "words_end_symbol", "words_end_mark",
    "words_start_upper", "words_bare", "words_distinct", "word_commonest", "pairs_distinct", "words_echoed",
    "log_lines", "line_words", "lines_distinct", "line_commonest", "lines_end_mark", "lines_short",
    "worst_upper", "worst_symbol", "worst_echo", "worst_shout", "worst_bar", "blocks_spoilt",
)


def byte_classes() -> np.ndarray:
    out = np.full(256, SYMBOL, np.uint8)
    for cls, chars in ((MARK, ".,;:"), (SHOUT, "!?"), (QUOTE, "()[]\"'-"), (BAR, "|"), (NEWLINE, "\n"), (BLANK, " \t\r\x0b\x0c")):
        out[[ord(c) for c in chars]] = cls
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1], out[128:] = LOWER, UPPER, DIGIT, HIGH
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CLASSES = byte_classes()
PLACES = 64
#: A number for each byte at each place of a word; a word's key is their sum.
KEYS = mixed(np.arange(PLACES * 256, dtype=np.uint64)).reshape(PLACES, 256)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); null is the empty text."""
    filled = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it; the first row does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its commonest occurs."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(keys):
        _, at, times = np.unique(mixed(keys + mixed(doc.astype(np.uint64))), return_index=True, return_counts=True)
        distinct = np.bincount(doc[at], minlength=n).astype(float)
        np.maximum.at(most, doc[at], times)
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of an Arrow column of texts; an empty or null text has zeros."""
    data, offsets = bytes_of(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = {name: np.zeros(n) for name in FEATURES}
    out["log_bytes"] = np.log1p(sizes)
    if not len(data):
        return np.column_stack([out[f] for f in FEATURES]).astype(np.float32)
    classes = CLASSES[data]
    of_doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(of_doc * 16 + classes, minlength=16 * n).reshape(n, 16)
    for name, cls in (("lower", LOWER), ("digits", DIGIT), ("blanks", BLANK), ("newlines", NEWLINE), ("marks", MARK), ("shouts", SHOUT),
                      ("quotes", QUOTE), ("symbols", SYMBOL), ("bars", BAR), ("high", HIGH)):
        out[name] = share(counts[:, cls], sizes)
    out["upper_of_letters"] = share(counts[:, UPPER], counts[:, UPPER] + counts[:, LOWER])

    gap = (classes == BLANK) | (classes == NEWLINE)
    solid = np.flatnonzero(~gap)
    if not len(solid):
        return np.column_stack([out[f] for f in FEATURES]).astype(np.float32)
    begins = np.ones(len(solid), bool)
    begins[1:] = (np.diff(solid) > 1) | (of_doc[solid[1:]] != of_doc[solid[:-1]])
    first = np.flatnonzero(begins)
    starts, lengths = solid[first], np.diff(np.append(first, len(solid)))
    doc = of_doc[starts]
    words = np.bincount(doc, minlength=n).astype(float)
    per_doc = lambda flag: np.bincount(doc, flag, n)
    in_word = lambda cls: np.add.reduceat(classes[solid] == cls, first, dtype=np.int64)
    upper, lower, high = in_word(UPPER), in_word(LOWER), in_word(HIGH)
    last = classes[starts + lengths - 1]
    shouted = (upper >= 2) & (lower == 0)
    ends_symbol, ends_mark = (last == SYMBOL) | (last == BAR), (last == MARK) | (last == SHOUT)
    shouts, bars = in_word(SHOUT), in_word(BAR)
    out["log_words"] = np.log1p(words)
    out["word_mean"] = share(per_doc(lengths), words)
    out["word_sd"] = np.sqrt(np.maximum(share(per_doc(lengths.astype(float) ** 2), words) - out["word_mean"] ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, lengths)
    out["log_longest_word"] = np.log1p(longest)
    for name, flag in (("words_of_one", lengths == 1), ("words_long", lengths >= LONG_WORD), ("words_upper", shouted),
                       ("words_end_symbol", ends_symbol), ("words_end_mark", ends_mark), ("words_start_upper", classes[starts] == UPPER),
                       ("words_bare", upper + lower + high == 0)):
        out[name] = share(per_doc(flag), words)

    place = np.arange(len(solid)) - np.repeat(first, lengths)
    keys = np.add.reduceat(KEYS[place % PLACES, data[solid]], first, dtype=np.uint64) + lengths.astype(np.uint64)
    distinct, most = repeats(keys, doc, n)
    out["words_distinct"], out["word_commonest"] = share(distinct, words), share(most, words)
    follows = ~first_of(doc)
    echo = np.zeros(len(doc), bool)
    echo[1:] = follows[1:] & (keys[1:] == keys[:-1])
    out["words_echoed"] = share(per_doc(echo), words)
    second = np.flatnonzero(follows)
    distinct, _ = repeats(mixed(keys[second - 1]) + keys[second], doc[second], n)
    out["pairs_distinct"] = share(distinct, words - 1)

    line = np.cumsum(classes == NEWLINE)[starts]
    head = np.flatnonzero(first_of(doc, line))
    line_doc, line_words = doc[head], np.diff(np.append(head, len(doc)))
    lines = np.bincount(line_doc, minlength=n).astype(float)
    within = np.arange(len(doc)) - np.repeat(head, line_words)
    line_keys = np.add.reduceat(mixed(keys + within.astype(np.uint64)), head, dtype=np.uint64)
    distinct, most = repeats(line_keys, line_doc, n)
    out["log_lines"], out["line_words"] = np.log1p(lines), share(words, lines)
    out["lines_distinct"], out["line_commonest"] = share(distinct, lines), share(most, lines)
    tail = head + line_words - 1
    out["lines_end_mark"] = share(np.bincount(line_doc, ends_mark[tail], n), lines)
    out["lines_short"] = share(np.bincount(line_doc, line_words < SHORT_LINE, n), lines)

    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    head = np.flatnonzero(first_of(doc, rank // BLOCK))
    block_doc, block_words = doc[head], np.diff(np.append(head, len(doc)))
    spoilt = np.zeros(len(head), bool)
    for name, flag in (("worst_upper", shouted), ("worst_symbol", ends_symbol), ("worst_echo", echo), ("worst_shout", shouts), ("worst_bar", bars)):
        value = np.add.reduceat(flag.astype(np.int64), head) / block_words
        np.maximum.at(out[name], block_doc, value)
        spoilt |= value > 0.5
    out["blocks_spoilt"] = share(np.bincount(block_doc, spoilt, n), np.bincount(block_doc, minlength=n))
    return np.column_stack([out[f] for f in FEATURES]).astype(np.float32)


class Trees(NamedTuple):
    """Complete trees of equal depth as arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); larger values go right
    value: np.ndarray  # (trees, leaves)
    offset: float


def margin(trees: Trees, x: np.ndarray) -> np.ndarray:
    """The sum of the leaves that each row of ``x`` reaches, all trees at once."""
    count, inner = trees.feature.shape
    if not count:
        return np.full(len(x), trees.offset)
    at, tree, row = np.zeros((len(x), count), np.int64), np.arange(count), np.arange(len(x))[:, None]
    for _ in range(int(np.log2(inner + 1))):
        right = x[row, trees.feature[tree, at]] > trees.threshold[tree, at]
        at = 2 * at + 1 + right
    return trees.offset + trees.value[tree, at - inner].sum(axis=1)


def probability(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Ascending inner bounds of bins, halfway between neighbouring quantiles."""
    levels = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1), method="nearest"))
    return ((levels[1:] + levels[:-1]) / 2).astype(np.float32)


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Gradient-boosted trees for labels y in {0, 1}; without rows, a model that gives 0.5 to all."""
    n, width = x.shape
    inner, offset = 2**depth - 1, float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32)
    value, made = np.zeros((trees, inner + 1)), 0
    if not n or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], value[:0], offset)
    bounds = [cuts(x[:, f], bins) for f in range(width)]
    binned = [np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)]
    m = np.full(n, offset)
    gain_of = lambda g, h: g * g / (h + RIDGE)
    for t in range(trees):
        p = probability(m)
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, base = 2**level, 2**level - 1
            local = at - base
            sum_g, sum_h = np.bincount(local, g, nodes), np.bincount(local, h, nodes)
            best = np.full(nodes, 1e-6)
            for f in range(width):
                k = len(bounds[f]) + 1
                if k == 1:
                    continue
                key = local * k + binned[f]
                left_g = np.bincount(key, g, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(key, h, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = gain_of(left_g, left_h) + gain_of(right_g, right_h) - gain_of(sum_g, sum_h)[:, None]
                gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
                place = gain.argmax(axis=1)
                top = gain[np.arange(nodes), place]
                for k_node in np.flatnonzero(top > best):
                    best[k_node] = top[k_node]
                    feature[t, base + k_node], threshold[t, base + k_node] = f, bounds[f][place[k_node]]
            right = x[np.arange(n), feature[t, at]] > threshold[t, at]
            at = 2 * at + 1 + right
        leaf = at - inner
        value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        m += value[t][leaf]
        made = t + 1
        if not np.isfinite(threshold[t]).any():
            break  # no node could be split
    return Trees(feature[:made], threshold[:made], value[:made], offset)


def held_out(doc_id: Column) -> Column:
    """Rows that give no labels; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                    limit: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents that are not held out, in the order of a hash.

    Of several labels of a document the smallest counts; null labels count as none.
    """
    seen = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = seen.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
    some = one.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(limit)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("text", "label")  # at most ``limit`` small rows


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees of a labelled sample (text, label); the rows that reach the driver are the bounded sample's statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            found = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), batch.column(1)], names=["x", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "x binary, label int").toArrow()
    raw = rows.column(0).to_pylist()
    # Executors finish in any order; the sums of floats should not depend on it.
    order = sorted(range(len(raw)), key=raw.__getitem__)
    x = np.frombuffer(b"".join(raw[k] for k in order), np.float32).reshape(-1, len(FEATURES))
    y = np.array(rows.column(1).to_pylist(), float)[order] if raw else np.zeros(0)
    return boost(x, y, trees, depth, bins)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row; ``score`` is the probability of label 1.

    Null and empty texts have statistics of zero and the score the trees give them. Repeated rows
    are scored each, null ids stay null, other columns are ignored, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most TREES * 2^DEPTH nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Trees(*shared.value)
        for batch in by_size(batches, "text", BATCH_BYTES):
            found = probability(margin(m, statistics(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
