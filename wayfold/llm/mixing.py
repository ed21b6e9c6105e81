"""Mixing sources to target weights: temperature mixing with block permutations.

DataFrame functions only. Sources' token shares are raised to an exponent and normalised;
the exponent is bisected so that the weights meet a target entropy or a limit on
repetition. The weights become token budgets; each source is read in epochs, every epoch
a permutation of its documents, until its budget is met; the copies are dealt into blocks
that all hold the sources in the target proportions, and permuted inside each block.

Running sums over a source use two levels (sums per bucket of the random order, then rows
inside a bucket), so a source with a third of all rows is not one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import fresh_dir

#: Candidates per pass over the shares: eight halvings of the interval at a time.
STEPS = 256
PASSES = 5


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shares(sized: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of rows (source, tokens); a null source is a source of its own.

    Sources without tokens have no share and are left out.
    """
    by = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = by.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return by.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(total))


def _measures(by: DataFrame, low: float, step: float) -> DataFrame:
    """Per exponent a = low + k * step, k from 0 to STEPS: the entropy (nats) of share^a, normalised, and the largest ratio of repetitions.

    The ratio compares a source's copies per token with those of the least repeated source.
    With p = share^a and Z their sum, the entropy is log Z - sum(p log p) / Z.
    """
    power = F.pow("share", "a")
    rate = F.pow("share", F.col("a") - 1)
    return (
        by.select("share", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k"))
        .withColumn("a", F.lit(low) + F.col("k") * F.lit(step))
        .groupBy("a")
        .agg(
            F.sum(power).alias("z"),
            F.sum(power * F.col("a") * F.log("share")).alias("plogp"),
            (F.max(rate) / F.min(rate)).alias("repeats"),
        )
        .select("a", (F.log("z") - F.col("plogp") / F.col("z")).alias("entropy"), "repeats")
    )


def exponent(by: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] for a target, by bisection.

    ``entropy``: share of the largest possible entropy (log of the number of sources) that the
    weights should reach; the largest exponent that does is taken. ``max_repeats``: the
    smallest exponent at which no source is repeated more than this many times as often as
    the least repeated one. Entropy falls and repetition falls as the exponent grows.
    A target met by the shares themselves gives 1, one out of reach 0.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    n = by.count()
    if n < 2:
        return 1.0
    if entropy is not None:
        wanted = entropy * math.log(n)
        met = F.col("entropy") >= wanted - 1e-12
    else:
        met = F.col("repeats") <= max_repeats
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / STEPS
        measured = _measures(by, low, step).select("a", met.alias("met"))
        if entropy is not None:  # met up to some exponent
            best = measured.filter("met").agg(F.max("a")).first()[0]
            if best is None:
                return 0.0
            low, high = best, min(best + step, 1.0)
        else:  # met from some exponent on
            best = measured.filter("met").agg(F.min("a")).first()[0]
            if best is None:
                return 1.0
            low, high = max(best - step, 0.0), best
        if low == high:
            break
    return low if entropy is not None else high


def weights(by: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, share, weight, budget): weights share^a, normalised, and token budgets.

    ``budget``: tokens of the whole mixture. None: the smallest mixture that reads every
    source whole at least once, so that no document is lost.
    """
    power = by.withColumn("power", F.pow("share", F.lit(a)))
    z, rate = power.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    out = power.withColumn("weight", F.col("power") / F.lit(z))
    if budget is None:
        amount = F.greatest(F.col("tokens"), F.round(F.lit(rate) * F.col("power")).cast("long"))
    else:
        amount = F.floor(F.col("weight") * F.lit(budget)).cast("long")
    return out.select("source", "tokens", "docs", "share", "weight", amount.alias("budget"))


def _position(rows: DataFrame, keys: list[str], value: str, per_bucket: int = 2_000) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of the same keys that come earlier in the order (rank, key, tokens).

    ``keys`` end with a count of rows, ``docs``, which sets the number of buckets of a key.
    """
    buckets = F.greatest(F.ceil(F.col("docs") / per_bucket), F.lit(1)).cast("long")
    # The rank is an unsigned 32-bit number, so equal slices of its range hold equal numbers of rows.
    cut = rows.withColumn("bucket", F.floor(F.col("rank") * buckets / F.lit(1 << 32)).cast("long"))
    sums = cut.groupBy(*keys, "bucket").agg(F.sum(value).alias("bucket_sum"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "bucket", F.coalesce(F.sum("bucket_sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("rank", F.col("key"), "tokens").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("inner_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["bucket"] == offsets["bucket"]]
    out = local.join(offsets, match).select(local["*"], offsets["offset"])
    return out.withColumn("before", F.col("offset") + F.col("inner_before")).drop("offset", "inner_before", "bucket", "docs")


def _random(*parts: Column) -> Column:
    """A number in [0, 2^32) from the digest of the parts."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def schedule(sized: DataFrame, weighted: DataFrame, seed: int = 0, block_tokens: int = 1_000_000) -> DataFrame:
    """(key, source, tokens, epoch, block, slot): one row per copy of a document in the mixture.

    ``sized``: (key, source, tokens), key a number. Epoch e of a source is the order of its
    rows by a seeded digest of (seed, e, key), ties by key and tokens; rows equal in all three
    keep a copy each. A copy is taken if it starts inside the source's budget, so the last one
    may pass the budget by less than one document. Its place in the budget, as a fraction,
    gives its ``block``; ``slot`` numbers the copies of a block by another seeded digest.
    Documents without tokens come once, cost nothing and are dealt over the blocks by their
    digest; there are enough blocks that they hold ``block_tokens`` rows each, too.
    """
    amounts = weighted.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(max(amounts, sized.count()) / block_tokens))
    w = weighted.select("source", F.col("tokens").alias("source_tokens"), "docs", "budget")
    rows = sized.select("key", "source", "tokens")
    match = rows["source"].eqNullSafe(w["source"])
    placed = rows.join(w, match, "left").select(rows["*"], "source_tokens", "docs", "budget")
    last = F.when(F.col("tokens") > 0, F.floor((F.col("budget") - 1) / F.col("source_tokens"))).otherwise(0)
    epochs = F.sequence(F.lit(0), F.greatest(F.coalesce(last, F.lit(0)), F.lit(0)).cast("int"))
    copies = placed.withColumn("epoch", F.explode(epochs))
    ranked = copies.withColumn("rank", _random(F.lit(seed), F.col("epoch"), F.coalesce("key", F.lit(-1))))
    columns = ["key", "source", "tokens", "epoch"]
    summed = _position(ranked.filter("tokens > 0"), ["source", "epoch", "source_tokens", "budget", "docs"], "tokens")
    at = F.col("epoch") * F.col("source_tokens") + F.col("before")
    paid = summed.filter(at < F.col("budget")).select(*columns, (at / F.col("budget")).alias("share"))
    free = ranked.filter("tokens = 0").select(*columns, (F.col("rank") / F.lit(1 << 32)).alias("share"))
    dealt = paid.unionByName(free).withColumn("block", F.floor(F.col("share") * F.lit(blocks)).cast("long"))
    inside = Window.partitionBy("block").orderBy(
        _random(F.lit(seed), F.lit("slot"), F.col("epoch"), F.coalesce("key", F.lit(-1))), "key", "epoch", "tokens", "source"
    )
    return dealt.select("key", "source", "tokens", "epoch", "block", F.row_number().over(inside).cast("long").alias("slot"))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that texts are counted once and every pass reads the counts."""
    path = fresh_dir(df.sparkSession, "mixing")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mixture(
    docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 0,
    block_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(key, source, tokens, epoch, block, slot, weight) of the mixture of ``docs``; see the functions above.

    Null texts have no tokens; other columns are ignored; an empty table gives an empty mixture.
    """
    sized = _stored(docs.select(
        F.col(id_col).cast("long").alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("tokens")
    ))
    by = _stored(shares(sized))
    weighted = weights(by, exponent(by, entropy, max_repeats), budget)
    rows = schedule(sized, weighted, seed, block_tokens)
    w = weighted.select(F.col("source").alias("of"), "weight")
    return rows.join(w, rows["source"].eqNullSafe(w["of"]), "left").select(
        rows["*"], F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight")
    )
