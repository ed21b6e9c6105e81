"""Toxic passages by maximum-scoring segments.

*Token scores.* A token's log-odds of the toxic class against the rest come from labelled
texts with Dirichlet priors in a chain: the prior of a word is the posterior of its prefix of
``PREFIXES`` letters, whose prior is that of the shorter prefix, and so on to all tokens. A
token seldom seen keeps the odds of its prefix. Counts live in hashed tables of fixed size
(``BITS``), so the model doesn't grow with the vocabulary and can be sent to every executor.

*Segments.* One linear scan over a text's scores (Ruzzo and Tompa) finds all maximal
segments: passages whose score neither grows nor can be split for a larger sum.

*Calibration.* The largest segment score of n unrelated tokens has an extreme-value
distribution: P(S >= x) = 1 - exp(-K n exp(-lambda x)). lambda solves the equation of
Karlin and Altschul on the token scores of non-toxic calibration texts, K is the maximum-likelihood
value for their largest segments. Passages with a p-value under ``SIGNIFICANT`` are reported;
a document's passages together have
a p-value by the statistic for sums of several maxima; its -log is mapped to a probability by a logistic curve fitted on the
calibration texts' binned counts.

Labels are learned from a bounded sample: at most ``MAX_LABELLED`` labelled rows, in the order
of a hash; a third of them calibrate and the rest gives the token counts.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, partitions, texts_of, worker_state

#: Bound of the labelled sample.
MAX_LABELLED = 200_000
BITS = 17
PREFIXES = (3, 4, 5, 6)
#: Weight of a prior, in tokens.
PRIOR = 8.0
#: Taken from every token's score, so that unrelated text drifts downwards.
DRIFT = 1.0
SCORE_CAP = 8.0
#: Evidence beyond this counts no more.
MOST = 30.0
SIGNIFICANT = 0.01
BATCH_BYTES = 1_500_000
TOKEN = re.compile(r"[^\W\d_]+")
#: Score histogram: from -SCORE_CAP-DRIFT in steps of a tenth.
STEP = 0.1


def held_out(doc_id: Column) -> Column:
    """Rows that give no labels; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def slots(token: str) -> tuple[int, ...]:
    """Places in the count tables: one per prefix length, then the word; a short word is its own prefix."""
    parts = [f"{n}{token[:n]}" for n in PREFIXES] + ["w" + token]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts)


LEVELS = len(PREFIXES) + 1


class SlotCache:
    """Slots of words, kept per worker."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = array("i")

    def of(self, found: list[str]) -> np.ndarray:
        """(tokens, levels) places."""
        if len(self.index) > self.limit:
            self.clear()
        for t in set(found).difference(self.index):
            self.index[t] = len(self.index)
            self.flat.extend(slots(t))
        used = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        return np.frombuffer(self.flat, np.int32).reshape(-1, LEVELS)[used] if len(used) else np.zeros((0, LEVELS), np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, calibrate) of at most ``limit`` labelled documents that are not held out.

    Of several labels of a document the largest counts; null labels count as none.
    """
    seen = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col)))
    one = seen.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "_id")
    some = one.orderBy(order, "_id").limit(limit).withColumn("calibrate", F.pmod(order, F.lit(3)) == 0)
    # At most ``limit`` rows of three small columns.
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("text", (F.col("toxic") > 0).alias("toxic"), "calibrate")


class Model(NamedTuple):
    counts: np.ndarray  # (levels, 2, slots)
    root: float
    lam: float
    k: float
    slope: float
    offset: float


def token_counts(sample: DataFrame) -> np.ndarray:
    """(levels, 2, slots) token counts per class, summed on the executors in blocks of slots."""
    blocks, width = 64, (1 << BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LEVELS, 2, 1 << BITS), np.int64)
        cache = worker_state(("slots", BITS, PREFIXES), SlotCache)
        for batch in by_size(batches, "text", BATCH_BYTES):
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for side in (0, 1):
                found: list[str] = []
                for t in texts_of(batch.filter(pa.array(toxic == bool(side))), "text"):
                    found += tokens(t)
                if found:
                    places = cache.of(found)
                    for level in range(LEVELS):
                        total[level, side] += np.bincount(places[:, level], minlength=1 << BITS)
        cut = total.reshape(LEVELS * 2, blocks, width).transpose(1, 0, 2).reshape(blocks, -1)
        used = [k for k in range(blocks) if cut[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([sparse(cut[k]) for k in used], pa.binary())], names=["block", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = np.frombuffer(raw, np.int64).reshape(2, -1)
                sums.setdefault(block, np.zeros(LEVELS * 2 * width, np.int64))[at] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"]
        )

    def sparse(values: np.ndarray) -> bytes:
        at = np.flatnonzero(values)
        return np.stack([at, values[at]]).astype(np.int64).tobytes()

    parts = sample.filter("NOT calibrate").select("text", "toxic").mapInArrow(count, "block int, counts binary")
    summed = parts.repartition(min(blocks, partitions(sample.sparkSession)), "block").mapInArrow(add, "block int, counts binary")
    # ``blocks`` rows of fixed size.
    out = np.zeros((blocks, LEVELS * 2, width), np.int64)
    for row in summed.collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64).reshape(LEVELS * 2, width)
    return out.transpose(1, 0, 2).reshape(LEVELS, 2, 1 << BITS)


def token_scores(places: np.ndarray, counts: np.ndarray, root: float) -> np.ndarray:
    """Log-odds of tokens over those of all tokens, less the drift, by the chain of priors.

    A level whose tokens are all those of the level above adds nothing new and is passed over.
    """
    share, above = np.full(len(places), root), np.full(len(places), np.iinfo(np.int64).max)
    for level in range(LEVELS):
        clean, toxic = counts[level, 0][places[:, level]], counts[level, 1][places[:, level]]
        n = (clean + toxic).astype(np.int64)
        share = np.where(n < above, (toxic + PRIOR * share) / (n + PRIOR), share)
        above = n
    odds = np.log(share / (1 - share)) - np.log(root / (1 - root))
    return np.clip(odds, -SCORE_CAP, SCORE_CAP) - DRIFT


def text_scores(places: np.ndarray, counts: np.ndarray, root: float) -> np.ndarray:
    """Token scores of one text; the j-th time a token comes its positive score counts 1/j, so echoes don't add up."""
    scores = token_scores(places, counts, root)
    good = np.flatnonzero(scores > 0)
    if len(good) > 1:
        word = places[good, -1]
        order = np.argsort(word, kind="stable")
        new = np.ones(len(good), bool)
        new[1:] = word[order[1:]] != word[order[:-1]]
        begun = np.maximum.accumulate(np.where(new, np.arange(len(good)), 0))
        scores[good[order]] /= np.arange(len(good)) - begun + 1
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum), left to right, in linear time.

    A stack holds candidate segments with the sums of everything before them (l) and up to
    their end (r). A new positive score is joined to the nearest candidate with a smaller l as
    long as that one's r is smaller than its own.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    firsts, ends, lefts, rights, links = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, total[i], total[i + 1]
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= right:
                firsts.append(first)
                ends.append(i + 1)
                lefts.append(left)
                rights.append(right)
                links.append(j)
                break
            first, left = firsts[j], lefts[j]
            del firsts[j:], ends[j:], lefts[j:], rights[j:], links[j:]
    return [(a, z, float(r - l)) for a, z, l, r in zip(firsts, ends, lefts, rights)]


def surprise(best: float, n: int, lam: float, k: float) -> float:
    """-log of the probability that n unrelated tokens have a segment of this sum or more."""
    if best <= 0:
        return 0.0
    return -math.log(max(-math.expm1(-k * max(n, 1) * math.exp(-lam * best)), 1e-300))


def evidence(sums: list[float], n: int, lam: float, k: float) -> float:
    """-log p of a text's passages together: the best over r of the r largest.

    For r > 1 this is the extreme-value statistic of Karlin and Altschul for sums: with
    t = sum(lambda S - log(K n)) over the r largest, p is about exp(-t) t^(r-1) / (r! (r-1)!).
    Each r beyond the first costs log 2, for the choice.
    """
    if not sums:
        return 0.0
    ordered = sorted(sums, reverse=True)
    best, t, base = surprise(ordered[0], n, lam, k), 0.0, math.log(k * max(n, 1))
    for r, s in enumerate(ordered, 1):
        gain = lam * s - base
        if gain <= 0:
            break
        t += gain
        if r > 1:
            best = max(best, t - (r - 1) * math.log(max(t, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def solve_lambda(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(weight * exp(lambda * value)) = 1, by bisection."""
    weight = weight / weight.sum()
    if (weight * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: (weight * np.exp(np.minimum(x * values, 500.0))).sum() - 1
    while f(high) < 0 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the toxic share over x by Newton steps with a weak ridge; one count is added to both classes."""
    a, b = 0.5, -2.0
    n = good + bad
    if n.sum() == 0:
        return a, b
    target = bad
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        ga = (x * (target - n * p)).sum() - 0.01 * a
        gb = (target - n * p).sum() - 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.01, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = max(1.0, abs(da), abs(db))
        a, b = a + da / scale, b + db / scale
    return float(a), float(b)


def calibrate(sample: DataFrame, counts: np.ndarray, root: float) -> tuple[float, float, float, float]:
    """(lambda, K, slope, offset) from the calibration texts; rows that reach the driver are histograms."""
    size = int(2 * (SCORE_CAP + DRIFT) / STEP) + 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(("slots", BITS, PREFIXES), SlotCache)
        histogram = np.zeros(size, np.int64)
        rows: list[tuple[bool, int, list[float]]] = []
        for batch in by_size(batches, "text", BATCH_BYTES):
            for text, toxic in zip(texts_of(batch, "text"), batch.column(1).to_pylist()):
                found = tokens(text)
                values = text_scores(cache.of(found), counts, root)
                if not toxic:
                    histogram += np.bincount(((values + SCORE_CAP + DRIFT) / STEP).astype(int), minlength=size)
                rows.append((bool(toxic), len(found), [x for _, _, x in segments(values)]))
        bins = np.flatnonzero(histogram)
        names = ["kind", "toxic", "n", "sums", "bin", "count"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(["text"] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.nulls(len(rows), pa.int32()), pa.array([1] * len(rows), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["bin"] * len(bins), pa.string()), pa.nulls(len(bins), pa.bool_()), pa.nulls(len(bins), pa.int64()),
             pa.nulls(len(bins), pa.list_(pa.float64())), pa.array(bins, pa.int32()), pa.array(histogram[bins], pa.int64())], names=names)

    from wayfold.llm.common import kept

    schema = "kind string, toxic boolean, n long, sums array<double>, bin int, count long"
    seen = kept(sample.filter("calibrate").select("text", "toxic").mapInArrow(scan, schema), sample.sparkSession)
    bins = seen.filter("kind = 'bin'").groupBy("bin").agg(F.sum("count").alias("count")).collect()
    if not bins:
        return 1.0, 1.0, 0.5, -2.0
    values = np.array([r["bin"] for r in bins]) * STEP - SCORE_CAP - DRIFT
    lam = solve_lambda(values, np.array([r["count"] for r in bins], float))
    texts = seen.filter("kind = 'text'")
    largest = F.coalesce(F.array_max("sums"), F.lit(0.0))
    size_sum, n_clean = texts.filter("NOT toxic").agg(
        F.sum(F.greatest("n", F.lit(1)) * F.exp(-F.lit(lam) * largest)), F.count(F.lit(1))
    ).first()
    k = float(n_clean / size_sum) if size_sum else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [evidence(s, n, lam, k) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.floor(np.clip(z, 0, MOST) * 10).astype(np.int32))], names=["toxic", "at"])

    # Tenths up to MOST: a few hundred bins a class.
    grid = texts.select("toxic", "sums", "n").mapInArrow(weigh, "toxic boolean, at int").groupBy("at").agg(
        F.count_if(F.col("toxic")).alias("bad"), F.count_if(~F.col("toxic")).alias("good")
    ).collect()
    at = np.array([r["at"] / 10 + 0.05 for r in grid])
    slope, offset = fit_logistic(at, np.array([r["good"] for r in grid], float), np.array([r["bad"] for r in grid], float))
    return lam, k, max(slope, 1e-3), offset


def fit(sample: DataFrame) -> Model:
    """The model of a labelled sample (text, toxic, calibrate); an empty sample gives a model that flags nothing."""
    from wayfold.llm.common import kept

    rows = kept(sample, sample.sparkSession)
    counts = token_counts(rows).astype(np.int32)
    clean, toxic = counts[0, 0].sum(), counts[0, 1].sum()
    root = float((toxic + 1) / (toxic + clean + 20))
    lam, k, slope, offset = calibrate(rows, counts, root)
    return Model(counts, root, lam, k, slope, offset)


def judge(places: np.ndarray, m: Model) -> tuple[float, list[dict]]:
    """(probability, significant passages) of a text."""
    found = segments(text_scores(places, m.counts, m.root))
    z = min(evidence([x for _, _, x in found], len(places), m.lam, m.k), MOST)
    rows = []
    for first, end, total in found:
        p = math.exp(-surprise(total, len(places), m.lam, m.k))
        if p <= SIGNIFICANT:
            rows.append({"first": first, "end": end, "sum": total, "p": p})
    return 1 / (1 + math.exp(-(m.slope * z + m.offset))), rows


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows with the score of the document and its significant passages.

    (id, score, predicted, n_passages, passages): score is a probability; passages are
    (first token, end token, sum, p-value). Null and empty texts have no tokens and the score of
    no surprise. Every text is scored whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))  # three tables of 2^BITS slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache = worker_state(("slots", BITS, PREFIXES), SlotCache)
        passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("sum", pa.float64()), ("p", pa.float64())]))
        for batch in by_size(batches, "text", BATCH_BYTES):
            found, sizes = [], []
            for text in texts_of(batch, "text"):
                some = tokens(text)
                found += some
                sizes.append(len(some))
            places = cache.of(found)
            scores, kept_passages, at = [], [], 0
            for n in sizes:
                value, rows = judge(places[at : at + n], m)
                at += n
                scores.append(value)
                kept_passages.append(rows)
            out = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64()), pa.array((out >= threshold).astype(np.int32)),
                 pa.array(kept_passages, passage)], names=["id", "score", "predicted", "passages"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, score double, predicted int, passages array<struct<first:int,end:int,sum:double,p:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns; scored in place, without a shuffle."""
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain arrays, so the package need not be installed there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache = worker_state(("slots", BITS, PREFIXES), SlotCache)
        for batch in by_size(batches, text_col, BATCH_BYTES):
            stays = []
            for text in batch.column(at).to_pylist():
                stays.append(judge(cache.of(tokens(text or "")), m)[0] < threshold)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
