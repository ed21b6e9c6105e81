"""Removal of repeated word windows across documents, by seed and extend.

Every window of ``window`` words has one *anchor*: the word k-gram with the smallest hash
inside it (the leftmost on ties), which is what winnowing selects. Equal windows have equal
anchors at the same offset, so a repeat of ``window`` words or more always meets at an anchor
and nothing else has to be compared. Occurrences of an anchor travel to the task of its hash
with the digests of their windows, that is of every way to extend the seed to both sides up
to the threshold. There the earliest start of every window is found; the windows of an
occurrence that start elsewhere first are joined to maximal stretches, and the union of the
stretches of a document is removed.

No pair of documents is ever listed: a passage shared by n documents costs n rows at most,
and each Arrow batch sends only the earliest start of a window, since a later one in the same
batch is known to be a repeat. Windows are equal if the 64-bit hash of the anchor and 48 bits
of an independent hash of the window agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, partitions, worker_state

BATCH_BYTES = 3_000_000
#: Buckets of anchors per task, taken one after another.
FINE = 8
GRAM = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words as the contract cuts them: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() takes as white space besides ASCII white space.
OTHER = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii() and any(c in text for c in OTHER[4:]) or any(c in text for c in OTHER[:4]):
        return WORD.findall(text)
    return text.split()


class WordHashes:
    """64-bit hashes of words, cached per worker."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.known = limit, {}

    def of(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for w in set(found).difference(known):
            known[w] = digest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def spans(hashes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes: a sum with a different rotation of each place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for place in range(size):
        out = out * MULTIPLIER + hashes[place : place + n]
    return mix(out ^ np.uint64(salt))


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of every ``width`` consecutive values, by doubling."""
    n = len(values)
    best, done = np.arange(n), 1
    while done < width:
        step = min(done, width - done)
        a, b = best[:-step] if step else best, best[step:]
        best = np.where(values[b] < values[a], b, a)
        done += step
    return best


def occurrences(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int):
    """(start, anchor hash, window hash) of the windows inside each document of a batch.

    ``start`` counts words over the whole batch.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    grams = spans(hashes, gram, 1)
    anchors = leftmost_min(grams, window - gram + 1)[:n]
    left = np.repeat(ends, sizes)[:n] - np.arange(n)
    start = np.flatnonzero(left >= window)
    return start, grams[anchors[start]], spans(hashes, window, 2)[start]


PACKED = np.dtype([("anchor", "<u8"), ("window", "u1", (6,)), ("doc", "<u4"), ("start", "<u4")])


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, text_key, first, last): maximal stretches of words of a document that repeat an earlier place.

    Earlier: a smaller doc_id, or the same doc_id and an earlier start. Words of the stretch
    are covered by windows that start earlier elsewhere. Stretches of a document may overlap.
    ``text_key``, a hash of the text, tells rows of one doc_id apart; equal windows at one
    place of one doc_id start at the same place, so neither is earlier. Rows without an id and
    texts under ``window`` words take no part.
    """
    tasks = partitions(docs.sparkSession)
    count = FINE * tasks
    schema = "bucket int, docs binary, rows binary, doc_id long, text_key long, first long, last long"
    names = [c.split()[0] for c in schema.split(", ")]
    out = names[3:]
    out_schema = ", ".join(schema.split(", ")[3:])

    def spans_of(docs: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Columns of the maximal stretches of windows; docs: (doc_id, text_key) rows; sorted by doc and start."""
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(doc)) - 1
        return [docs[doc[at], 0], docs[doc[at], 1], start[at], start[stop] + window]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("word hashes",), WordHashes)
        for batch in by_size(batches, "text", batch_bytes):
            docs = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2)], axis=1)
            order = np.argsort(docs[:, 0], kind="stable")
            docs = docs[order]
            found, sizes = [], np.zeros(len(docs), np.int64)
            texts = batch.column(1).to_pylist()
            for i, k in enumerate(order):
                w = words(texts[k])
                sizes[i] = len(w)
                found += w
            start, anchor, digest = occurrences(hashes.of(found), sizes, window, gram)
            del found, texts
            if not len(start):
                continue
            offsets = np.cumsum(sizes) - sizes
            doc = np.searchsorted(np.cumsum(sizes), start, side="right")
            place = start - offsets[doc]
            if (docs[1:, 0] > docs[:-1, 0]).all():
                rank = np.argsort(digest, kind="stable")
            else:
                rank = np.lexsort((place, docs[doc, 0], digest))
            later, copy = repeats(rank, digest, anchor, docs[doc, 0], place, docs[doc, 1])
            if later.any():
                columns = spans_of(docs, doc[later], place[later])
                none = pa.nulls(len(columns[0]), pa.binary())
                bucket = pa.array((columns[0] % count).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, none, none, *(pa.array(c) for c in columns)], names=names)
            keep = ~(later | copy)
            rows = np.empty(int(keep.sum()), PACKED)
            rows["anchor"], rows["doc"], rows["start"] = anchor[keep], doc[keep], place[keep]
            rows["window"] = np.ascontiguousarray(digest[keep]).view(np.uint8).reshape(-1, 8)[:, :6]
            bucket = (rows["anchor"] % np.uint64(count)).astype(np.int32)
            rank = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[rank], np.arange(count + 1))
            full = np.flatnonzero(np.diff(cuts))
            packed = [pack(docs, rows[rank[cuts[b] : cuts[b + 1]]]) for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), *(pa.array(list(c), pa.binary()) for c in zip(*packed)),
                 *(pa.nulls(len(full), pa.int64()) for _ in range(4))], names=names,
            )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts, seen, open_bucket = [], [], 0, None
        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(n) for n in out], names=out)
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                rows = batch.column("rows")[k].as_py()
                if rows is None:
                    continue
                if bucket != open_bucket and parts:
                    yield from matched(tables, parts)
                    tables, parts, seen = [], [], 0
                open_bucket = bucket
                tables.append(np.frombuffer(batch.column("docs")[k].as_py(), "<i8").reshape(-1, 2))
                parts.append(unpack(rows, seen))
                seen += len(tables[-1])
        if parts:
            yield from matched(tables, parts)

    def matched(tables: list, parts: list) -> Iterator[pa.RecordBatch]:
        docs = np.concatenate(tables)
        anchor, digest, doc, start = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        # Windows met once have no partner; only the others are put in order.
        both = mix(anchor ^ mix(digest))
        rank = np.argsort(both)
        near = both[rank[1:]] == both[rank[:-1]]
        some = rank[np.append(near, False) | np.insert(near, 0, False)] if len(rank) > 1 else rank[:0]
        del both, rank
        anchor, digest, doc, start = anchor[some], digest[some], doc[some], start[some].astype(np.int64)
        if not len(some):
            return
        rank = np.lexsort((start, docs[doc, 0], digest, anchor))
        later, _ = repeats(rank, digest, anchor, docs[doc, 0], start, docs[doc, 1])
        doc, start = doc[later], start[later]
        rank = np.lexsort((start, doc))
        columns = spans_of(docs, doc[rank], start[rank])
        for k in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in columns], names=out)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")
    ).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(seeds, schema).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(extend, out_schema)


def repeats(rank: np.ndarray, digest: np.ndarray, anchor: np.ndarray, ids: np.ndarray, start: np.ndarray, texts: np.ndarray):
    """(later, copy): windows that start elsewhere first, and further rows of a window's first place with the same text.

    ``rank`` puts equal windows together, each with its earliest place first. Another text of the same
    id is no copy: the window may prove to start earlier still, and then both texts lose it.
    """
    head = np.ones(len(rank), bool)
    head[1:] = (digest[rank[1:]] != digest[rank[:-1]]) | (anchor[rank[1:]] != anchor[rank[:-1]])
    first = rank[np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))]
    there = (ids[rank] == ids[first]) & (start[rank] == start[first])
    later, copy = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    later[rank] = ~there
    copy[rank] = there & ~head & (texts[rank] == texts[first])
    return later, copy


def pack(docs: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    """The windows of one bucket by column, in order of document and place; docs: (doc_id, text_key).

    Neighbouring windows of one anchor share a head; each sends its own 6 bytes.
    """
    new = np.ones(len(rows), bool)
    new[1:] = (
        (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1])
        | (rows["start"][1:] != rows["start"][:-1] + 1)
    )
    begun = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    new |= (np.arange(len(rows)) - begun) % 255 == 0
    heads = rows[new]
    lengths = np.diff(np.append(np.flatnonzero(new), len(rows)))
    used, doc = np.unique(heads["doc"], return_inverse=True)
    body = b"".join((
        np.array([len(heads), len(rows)], "<i8").tobytes(), heads["anchor"].tobytes(), doc.astype("<u4").tobytes(),
        heads["start"].tobytes(), lengths.astype("<u1").tobytes(), rows["window"].tobytes(),
    ))
    return docs[used].astype("<i8").tobytes(), body


def unpack(body: bytes, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window hash, document number + shift, start) of every window."""
    heads, rows = np.frombuffer(body, "<i8", 2)
    at = 16
    columns = []
    for kind in ("<u8", "<u4", "<u4", "<u1"):
        columns.append(np.frombuffer(body, kind, heads, at))
        at += columns[-1].nbytes
    anchor, doc, start, lengths = columns
    lengths = lengths.astype(np.int64)
    digest = np.zeros((rows, 8), np.uint8)
    digest[:, :6] = np.frombuffer(body, np.uint8, 6 * rows, at).reshape(rows, 6)
    step = np.arange(rows) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (
        np.repeat(anchor, lengths), digest.view("<u8").reshape(-1), np.repeat(doc.astype(np.int64) + shift, lengths),
        (np.repeat(start, lengths) + step).astype(np.uint32),
    )


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` without their repeated stretches.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space). With
    ``keep_text`` a text that lost words becomes the kept words joined by one space, while the
    others keep their characters; a null text stays null and has no words. Rows of one doc_id
    are judged each on its own text: neither is earlier than the other at one start. Rows without an id
    are kept whole. A column of ``docs`` named like a result raises.
    """
    spans_by_doc = (
        repeated_spans(docs, window, gram, id_col, text_col, batch_bytes).groupBy(F.col("doc_id").alias("_of"), F.col("text_key").alias("_key"))
        .agg(F.collect_list("first").alias("_firsts"), F.collect_list("last").alias("_lasts"))
    )
    names = docs.columns
    added = ["n_words", "n_removed", "kept_sha256"]
    if clash := set(names) & {"_of", "_key", "_firsts", "_lasts", *added}:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
    match = (docs[id_col].cast("long") == spans_by_doc["_of"]) & (F.xxhash64(docs[text_col]) == spans_by_doc["_key"])
    joined = docs.join(spans_by_doc, match, "left").drop("_of", "_key")
    at = names.index(text_col)
    out_names = names if keep_text else [n for n in names if n != text_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in out_names)
    fields += ", n_words long, n_removed long, kept_sha256 string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            firsts, lasts = batch.column(len(names)), batch.column(len(names) + 1)
            totals, removed, digests = [], [], []
            for i, text in enumerate(texts):
                found = words(text)
                kept = found
                if firsts[i].is_valid:
                    change = np.zeros(len(found) + 1, np.int64)
                    a, z = np.array(firsts[i].as_py()), np.array(lasts[i].as_py())
                    inside = z <= len(found)
                    np.add.at(change, a[inside], 1)
                    np.add.at(change, z[inside], -1)
                    kept = [w for w, gone in zip(found, (np.cumsum(change[:-1]) > 0).tolist()) if not gone]
                whole = " ".join(kept)
                totals.append(len(found))
                removed.append(len(found) - len(kept))
                digests.append(hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest())
                if len(kept) < len(found):
                    texts[i] = whole
            columns = [
                pa.array(texts, batch.schema.field(k).type) if k == at else batch.column(k)
                for k, n in enumerate(names) if n in out_names
            ]
            columns += [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*out_names, *added])

    return joined.mapInArrow(cut, fields)
