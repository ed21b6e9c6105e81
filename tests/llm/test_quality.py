"""The quality classifier: statistics and trees against plain versions, accuracy on held-out rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from wayfold.llm import quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^ \t\r\x0b\x0c\n]+")
KIND = {c: k for k, cs in {"mark": b".,;:", "shout": b"!?", "quote": b"()[]\"'-", "bar": b"|", "newline": b"\n", "blank": b" \t\r\x0b\x0c"}.items() for c in cs}


def kind(c):
    if c >= 128:
        return "high"
    if 97 <= c <= 122:
        return "lower"
    if 65 <= c <= 90:
        return "upper"
    return "digit" if 48 <= c <= 57 else KIND.get(c, "symbol")


def plain(text):
    raw = (text or "").encode()
    n, c = max(len(raw), 1), Counter(map(kind, raw))
    words = WORD.findall(raw)
    k = max(len(words), 1)
    lines = [found for found in (WORD.findall(x) for x in raw.split(b"\n")) if found]
    m = max(len(lines), 1)
    shouted = [sum(kind(b) == "upper" for b in w) >= 2 and not any(kind(b) == "lower" for b in w) for w in words]
    symbol = [kind(w[-1]) in ("symbol", "bar") for w in words]
    ends = lambda w: kind(w[-1]) in ("mark", "shout")
    echo = [False] + [a == b for a, b in zip(words, words[1:])]
    shouts = [sum(kind(b) == "shout" for b in w) for w in words]
    bars = [w.count(b"|") for w in words]
    mean = sum(map(len, words)) / k
    blocks = [slice(i, i + quality.BLOCK) for i in range(0, len(words), quality.BLOCK)]
    worst = [[sum(f[s]) / len(words[s]) for s in blocks] for f in (shouted, symbol, echo, shouts, bars)]
    most = lambda things: max(Counter(things).values(), default=0)
    pairs = list(zip(words, words[1:]))
    keys = [tuple(x) for x in lines]
    return [
        math.log1p(len(raw)), c["lower"] / n, c["upper"] / max(c["upper"] + c["lower"], 1), c["digit"] / n, c["blank"] / n, c["newline"] / n,
        c["mark"] / n, c["shout"] / n, c["quote"] / n, c["symbol"] / n, c["bar"] / n, c["high"] / n,
        math.log1p(len(words)), mean, math.sqrt(max(sum(len(w) ** 2 for w in words) / k - mean**2, 0)), math.log1p(max(map(len, words), default=0)),
        sum(len(w) == 1 for w in words) / k, sum(len(w) >= 20 for w in words) / k, sum(shouted) / k, sum(symbol) / k, sum(map(ends, words)) / k,
        sum(kind(w[0]) == "upper" for w in words) / k, sum(not any(kind(b) in ("upper", "lower", "high") for b in w) for w in words) / k,
        len(set(words)) / k, most(words) / k, len(set(pairs)) / max(len(words) - 1, 1), sum(echo) / k,
        math.log1p(len(lines)), len(words) / m, len(set(keys)) / m, most(keys) / m, sum(ends(x[-1]) for x in lines) / m, sum(len(x) < 4 for x in lines) / m,
        *[max(w, default=0) for w in worst], sum(any(w[i] > 0.5 for w in worst) for i in range(len(blocks))) / max(len(blocks), 1),
    ]


def test_statistics_equal_the_plain_ones(odd):
    rng = random.Random(2)
    parts = ["the", "The", "THE", "THE!!", "a|", "|", "x$$$", "ü", "12", "...", " ", " ", " ", "\n", "\t", "\x1c", "w" * 90, "'s"]
    texts = [r.text for r in odd.collect()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    want = np.array([plain(t) for t in texts])
    for column in (pa.array(texts, pa.string()), pa.array(["cut", *texts, None], pa.string()).slice(1, len(texts))):
        assert np.allclose(quality.statistics(column), want, atol=2e-4)
    for column in ([], [None], ["", None], [" ", ""]):
        assert quality.statistics(pa.array(column, pa.string())).shape == (len(column), len(quality.FEATURES))


def test_flat_trees_equal_a_walk_and_a_plain_split():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.boost(x, y, trees=30, depth=3)

    def walk(row):
        total = model.offset
        for t in range(len(model.feature)):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.threshold[t, at])
            total += model.value[t, at - model.feature.shape[1]]
        return total

    found = quality.margin(model, x)
    assert np.allclose(found, [walk(r) for r in x])
    assert ((found > 0) == (y > 0)).mean() > 0.97
    # The first split of one tree is the best over all bounds, by trying each.
    one = quality.boost(x, y, trees=1, depth=1)
    p = quality.probability(np.array([one.offset]))[0]
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
    best = max((gain(x[:, f] <= b) + gain(x[:, f] > b), -f) for f in range(5) for b in quality.cuts(x[:, f], quality.BINS)
               if min(h[x[:, f] <= b].sum(), h[x[:, f] > b].sum()) >= quality.LEAST_HESSIAN)
    left = x[:, one.feature[0, 0]] <= one.threshold[0, 0]
    assert math.isclose(gain(left) + gain(~left), best[0], rel_tol=1e-9)


def test_models_without_two_classes():
    x = np.zeros((0, len(quality.FEATURES)), np.float32)
    assert quality.probability(quality.margin(quality.boost(x, np.zeros(0)), x[:0])).shape == (0,)
    ones = np.ones((4, 2), np.float32)
    assert quality.probability(quality.margin(quality.boost(ones, np.ones(4)), ones)).tolist() == [5 / 6] * 4
    assert np.allclose(quality.margin(quality.boost(ones, np.array([0.0, 1, 0, 1])), ones), 0)  # nothing to split


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.labelled_sample(docs, labels))
    rows = quality.score(docs, model).join(labels, "doc_id").withColumn("out", quality.held_out(F.col("doc_id")))
    found = [(r.quality, r.predicted, r.score) for r in rows.collect() if r.out]
    bad, good = [s for q, _, s in found if q == 0], [s for q, _, s in found if q == 1]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(q == p for q, p, _ in found) / len(found) > 0.93


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(odd.withColumn("label", F.lit("x")), labels)
    taken = {1: 1, 4: 0, 7: 1}
    ids = {r.doc_id for r in labels.filter(~quality.held_out(F.col("doc_id"))).collect()}
    rows = [r for r in odd.collect() if r.doc_id in taken and r.doc_id in ids]
    assert Counter((r.text, r.label) for r in sample.collect()) == Counter((r.text, taken[r.doc_id]) for r in rows)
    model = quality.fit(sample)
    got = quality.score(odd.withColumn("score", F.lit("x")), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(none, model).count() == 0
    empty = quality.fit(quality.labelled_sample(odd, labels.limit(0)))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.labelled_sample(odd, labels, limit=1).select("label").distinct().count() <= 1
