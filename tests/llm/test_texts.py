"""Operators on texts against the libraries and brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from wayfold.llm import mixing, repeats, sentencepiece_wfst, simhash, token_counts, token_files, toxicity, units
from wayfold.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def test_token_counts(spark, odd, none):
    path = tokenizer("byte_bpe_50k.json")
    encode = library("byte_bpe_50k.json").encode
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.count_tokens(odd.withColumn("n_tokens", F.lit(0)), path, batch_bytes=1000)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_files(spark, odd, none, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    encode = library("word_bpe_49k.json").encode
    manifest = token_files.store_tokens(odd, path, 1, folder=f"file://{tmp_path}/t", shards=3)
    rows = token_files.read(manifest).orderBy("start").collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    assert [key(r) for r in rows] == sorted(key(r) for r in odd.collect())
    texts, at = {r.doc_id: r.text or "" for r in odd.collect()}, 0
    for r in rows:
        ids = np.array([*encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert token_files.read(token_files.store_tokens(none, path, 1, folder=f"file://{tmp_path}/e")).count() == 0


def test_word_level_units_equal_the_library():
    """Marks after letters, added tokens in any case, characters that change when lowered, the separator itself."""
    parts = ["a", "B", "É", "e\u0301", "İ", "Σ", "\u0958", "~", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'", "1", "!", ".", ",", "=", ">"]
    parts += ["\x1c", "\x85", " ", " ", "\n", "漢", "ǅ", "\u0338", "\u200b", "x" * 300]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    found, encode = units.word_level(tokenizer("word_bpe_49k.json")), library("word_bpe_49k.json").encode
    keys, sizes = units.split_all(texts, units.words)
    rows = found.rows(keys)
    ends = np.cumsum(units.sums(found.counts(rows), sizes))
    for text, ids in zip(texts, np.split(found.ids(rows), ends[:-1])):
        assert ids.tolist() == encode(text, add_special_tokens=False).ids, text


def test_token_frames_random_access_and_checksum(tmp_path):
    import pyarrow as pa

    with open(tmp_path / "f", "wb") as out:
        w = token_files.ShardWriter(out, 2, 3)
        for k in range(5):
            w.add(k, np.arange(k, dtype="<u2").tobytes())
        w.close()
    r = token_files.ShardReader(pa.OSFile(str(tmp_path / "f")))
    assert r.ids == [0, 1, 2, 3, 4] and r.document(3).tolist() == [0, 1, 2]
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[int(r.offsets[4]) - 2] ^= 1
    (tmp_path / "g").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.ShardReader(pa.OSFile(str(tmp_path / "g"))).document(3)


def test_sentencepiece(spark, odd, none):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_wfst.decode(sentencepiece_wfst.encode(odd, path), path).collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)
    assert sentencepiece_wfst.round_trip(none, path).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_wfst.encode(odd.withColumn("ids", F.lit(1)), path)
    machine = sentencepiece_wfst.Transducer(sentencepiece_wfst.compile_model(path))
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aabeinsth  \n▁éß漢😀<>0x.,!") for _ in range(rng.randint(0, 25)))
        assert [i for ids in machine.encode(machine.words(text)) for i in ids] == sp.encode(text)


def test_words_are_encoded_once_whatever_marks_follow():
    """op1: marks that no piece holds behind a letter are set apart, so a stem is encoded once; ids stay the library's."""
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    machine, found = sentencepiece_wfst.transducer(path)
    found.clear()
    text = "haantion, haantion. haantion haantion.) (haantion, 12².5 2.5, é."
    keys = machine.words(text)
    rows = found.rows(keys)
    assert found.ids(rows).tolist() == sp.encode(text)
    once = []
    found.clear()
    encode, found.encode = found.encode, lambda keys: once.extend(keys) or encode(keys)
    found.rows(keys)
    found.encode = encode
    assert once.count("haantion") == 1 and not {"haantion,", "haantion.", "haantion.)"} & set(once)


def brute_repeats(rows, window):
    """Result columns of each row; rows of one id are at the same place, so neither is earlier."""
    first, out = {}, []
    split = [(doc, WORD.findall(text)) for doc, text in rows]
    for doc, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    for doc, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (doc, s):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch", [1, 200, 1_000, 1_000_000])
def test_repeats(spark, batch):
    """Batches of one text to all texts; repeated ids with equal and with other texts."""
    rng = random.Random(3)
    passages = [[rng.choice("abcd") for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = [(d, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(passages))) for d in range(80)]
    rows += [(d, " ".join("ab" * 90)) for d in (90, 91)]
    common = " ".join(f"q{k}" for k in range(25))
    rows += [(200, common), (201, common + " x"), (201, common + " y"), (201, common + " y"), (202, "z " + common), (202, "z " + common + " v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(df, keep_text=False, batch_bytes=batch).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 20)


def test_repeats_do_not_depend_on_the_dealing_of_rows(spark):
    """Two texts of one id in another partition than the earlier document."""
    common = " ".join(f"q{k}" for k in range(25))
    first, rest = [(0, common)], [(1, common + " x"), (1, common + " y")]
    shape = "doc_id long, text string"
    apart = spark.createDataFrame(first, shape).coalesce(1).union(spark.createDataFrame(rest, shape).coalesce(1))
    for df in (apart, apart.coalesce(1)):
        assert sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect()) == [(0, 0), (1, 25), (1, 25)]
    with pytest.raises(ValueError, match="n_words"):
        repeats.remove_repeats(apart.withColumn("n_words", F.lit(1)))


def test_repeats_odd_rows(spark, odd, none):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.source): r for r in rows}
    assert by[1, None].n_words == 0 and by[1, None].text is None
    assert by[6, None].n_removed == by[6, None].n_words and by[7, "b"].n_removed == 0
    assert repeats.remove_repeats(none).count() == 0


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark, odd, none):
    for r in odd.filter("n_chars < 100 OR n_chars IS NULL").collect():
        assert simhash.fingerprint(r.text) == brute_fingerprint(r.text)
    rows = {(r.doc_id, r.f): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert rows[1, 0] == rows[2, 0] == rows[3, 0] == 1
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("whole", [512, 8])
def test_simhash_links(spark, whole, monkeypatch):
    monkeypatch.setattr(simhash, "WHOLE_BUCKET", whole)
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(10)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(40)})
    parent = {v: v for v in values}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "f long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    other = {v: v for v in values}

    def top(x):
        return x if other[x] == x else top(other[x])

    for a, b in links:
        other[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(v) == root(v) for v in values)


def test_representatives(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    near = base[:150] + ["new"] + base[151:]
    far = [f"v{rng.randint(0, 500)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(far)), (5, ""), (6, None), (None, "x")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "5", "6", "None"]


def test_near_copies_against_plain_jaccard(spark, monkeypatch):
    """Pairs of similarity 0.6 to 0.95, families on templates below the threshold and short texts: only exact links join."""
    monkeypatch.setattr(simhash, "SET_BYTES", 60_000)
    rng = random.Random(12)
    rows, word = [], lambda: f"w{rng.randint(0, 9999)}"
    for k in range(72):
        base = [word() for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        for at in range(10, 10 + 5 * (k % 18 + 1), 5):
            base[at] = word()
        rows.append((len(rows), " ".join(base)))
    template = [word() for _ in range(250)]
    rows += [(len(rows) + k, " ".join(template + [word() for _ in range(48)])) for k in range(80)]
    for k in range(60):
        base = [word() for _ in range(8 + k % 5)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [word()]))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    first = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(first))
    assert 80 < len(set(first)) < len(rows) - 40


def test_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-3, 4, rng.integers(0, 14)).astype(float)
        found = toxicity.segments(scores)
        total = max([scores[a:z].sum() for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)], default=0)
        assert max([s for *_, s in found], default=0) == max(total, 0)
        assert all(scores[a:z].sum() == s > 0 for a, z, s in found)
        assert all(z <= a for (_, z, _), (a, _, _) in zip(found, found[1:]))


def test_toxicity_learns_and_handles_odd_rows(spark, odd, none):
    rng = random.Random(4)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for d in range(600):
        text = [rng.choice(plain) for _ in range(40)]
        toxic = d % 5 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randint(0, 40), rng.choice(["vile", "foul"]))
        rows.append((d, " ".join(text)))
        labels += [(d, int(toxic))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labelled))
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in scored if r.held)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.keep_clean(docs, model).count() == 480 and toxicity.keep_clean(none, model).count() == 0
    untrained = toxicity.fit(toxicity.labelled_sample(none, labelled))
    assert not any(r.predicted for r in toxicity.score(odd, untrained).collect())


def test_mixture(spark, odd, none):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(1, 30)), "en", s, 1) for k, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["small"] * 20)]
    docs = spark.createDataFrame(rows, odd.schema)
    copies = mixing.mixture(docs, max_repeats=3.0, block_tokens=500).collect()
    times = {}
    for r in copies:
        times[r.key] = times.get(r.key, 0) + 1
    assert set(times) == set(range(380)) and max(times.values()) <= 4
    tokens, have = {}, {}
    for r in copies:
        tokens[r.source] = tokens.get(r.source, 0) + r.tokens
    for k, text, _, s, _ in rows:
        have[s] = have.get(s, 0) + len(text.split())
    rates = {s: tokens[s] / have[s] for s in have}
    assert abs(rates["big"] - 1) < 0.05 and abs(max(rates.values()) - 3) < 0.15
    for block in {r.block for r in copies}:
        slots = sorted(r.slot for r in copies if r.block == block)
        assert slots == list(range(1, len(slots) + 1))
    assert copies and mixing.mixture(none, entropy=0.9).count() == 0
    assert {r.key for r in mixing.mixture(odd, entropy=0.9).collect()} == {None, *range(1, 9)}


def test_exponent_meets_entropy(spark):
    by = mixing.shares(spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long"))
    a = mixing.exponent(by, entropy=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.8) < 1e-6


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(60))
    rows = [(k, text(), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, None, None, None, None), (102, "", "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {*range(60), 101, 102} and all(r.decoded_equal for r in out)
