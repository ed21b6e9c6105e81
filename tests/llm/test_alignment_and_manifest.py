"""Token alignment and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayfold.llm import alignment, merkle
from wayfold.llm.queries import tokenizer

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_tokens(text):
    """Ids and bytes of both tokenizers over a whole text; empty where the contract wants none."""
    left, right = tokenizer(LEFT), tokenizer(RIGHT)
    pair = alignment.tokenizer_pair(left, right)
    if not text:
        return [], [], pair
    a = pair.left.encode(" " + text, add_special_tokens=False).ids
    b = pair.right.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.left_bytes[i] for i in a) != whole or b"".join(pair.right_bytes[i] for i in b) != whole:
        return [], [], pair
    return a, b, pair


def plain_alignment(texts):
    """The contract's columns, by sets of ends over whole texts."""
    found, times = [], Counter()
    for text in texts:
        a, b, pair = plain_tokens(text)
        ends_a, ends_b, at = {}, {}, 0
        for k, i in enumerate(a):
            at += len(pair.left_bytes[i])
            ends_a[at] = k
        at = 0
        for k, i in enumerate(b):
            at += len(pair.right_bytes[i])
            ends_b[at] = k
        said, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            p, q = ends_a[end] + 1, ends_b[end] + 1
            said.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        times.update(links)
        found.append((len(a), len(b), ";".join(said), links))
    most = defaultdict(int)
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, len(links), len(links), sum(times[x] == most[x[1]] for x in links), sum(times[x] for x in links),
         hashlib.sha256(said.encode()).hexdigest() if said else "")
        for n_a, n_b, said, links in found
    ]


@pytest.mark.parametrize("limit", [40, 3_000_000])
def test_alignment_equals_whole_texts(spark, odd, none, limit):
    rng = random.Random(5)
    parts = ["the", "Thére", " ", "  ", "\n", "\t", "'s", "12", ".", "<|endoftext|>", "<s>", "</s>", "<0x41>", "é", "漢字", "　", "\xa0", "ab" * 30, "naïve"]
    made = [(100 + k, "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25)))) for k in range(150)]
    made += [(1, "▁ has the mark"), (2, None), (2, ""), (3, " "), (3, "   "), (4, "x\x00y z"), (4, "trailing "), (None, "no id")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).withColumn("n_a", F.lit("clash"))
    rows = docs.collect()
    want = Counter(zip([str(r.doc_id) for r in rows], plain_alignment([r.text for r in rows])))
    got = alignment.align(docs, tokenizer(LEFT), tokenizer(RIGHT), batch_bytes=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((str(r[0]), tuple(r[1:])) for r in got.collect()) == want
    assert alignment.align(none, tokenizer(LEFT), tokenizer(RIGHT)).count() == 0


def test_halving_finds_every_shared_cut():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        b = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        shared = sorted(set(a) & set(b))
        found = alignment.groups(np.array(a), np.array(b))
        assert list(zip(*map(np.ndarray.tolist, found))) == [(a.index(e) + 1, b.index(e) + 1) for e in shared]
    # No inner cut in a long interval: one group, found in few steps.
    even, odd = np.array([*range(2, 40_000, 2), 40_001]), np.array([*range(1, 40_000, 2), 40_001])
    assert [x.tolist() for x in alignment.groups(even, odd)] == [[len(even)], [len(odd)]]
    with pytest.raises(ValueError):
        alignment.groups(np.array([3]), np.array([2]))


def test_pairs_of_linked_ids_are_bounded_by_the_vocabularies():
    left, right = [b"a", b"ba", b"c", b""], [b"a", b"cba", b"a"]
    want = sum(1 for x in left for y in right if x and y and (x.endswith(y) or y.endswith(x)))
    assert alignment.possible_pairs(left, right) == want


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, arity=8):
    """Every row's columns from whole lists of digests."""
    leaf = lambda r, text: h(*map(frame, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
        return levels

    def way(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // arity * arity
            out.append((level[first:at], level[at + 1 : first + arity]))
            at //= arity
        return out

    trees = defaultdict(list)
    for r in rows:
        trees[r.lang].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    climbs = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        climbs[lang] = climb([leaf(r, r.text) for r in trees[lang]])
    top = climb([climbs[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(trees[lang]):
            path = way(climbs[lang], at) + way(top, k)
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = leaf(r, lower(r.text) if bad else r.text)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((str(r.doc_id), leaf(r, r.text), climbs[lang][-1][0], top[-1][0],
                        h(*[x for b, a in path for x in b + a]), folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_the_plain_tree(spark, odd, none, levels):
    rng = random.Random(levels)
    made = [(k, rng.choice(["Some Text", "lower", None, ""]), rng.choice(["en"] * 9 + ["de", "É", None, "z"]), "s", k % 7) for k in range(20, 620)]
    made += [(700, None, "only", None, None), (None, None, None, None, None), (701, "Big", "", "s", 2**40)]
    docs = odd.union(spark.createDataFrame(made, odd.schema)).repartition(5).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x"))
    got = merkle.manifest(docs, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter((str(r[0]), *r[1:]) for r in got.collect()) == plain_manifest(docs.collect())
    assert merkle.manifest(none).count() == 0


def test_manifest_of_few_rows(spark, odd):
    """One leaf alone is its subroot and the root; nine leaves need a second level."""
    one = spark.createDataFrame([(5, "A", "en", "s", 1)], odd.schema)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()
    for n in (8, 65):
        docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 1) for k in range(n)], odd.schema)
        assert Counter((str(r[0]), *r[1:]) for r in merkle.manifest(docs, levels=1).collect()) == plain_manifest(docs.collect())


def test_manifest_with_own_tampering(spark, odd):
    docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 1) for k in range(30)], odd.schema)
    got = {r.doc_id: r.verified for r in merkle.manifest(docs, tampered=F.col("doc_id") == 4).collect()}
    assert got == {k: k != 4 for k in range(30)}
