"""Near copies by shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found without loss
by a binary trie self-join of SimHash fingerprints and an exact check.

Shingles: words are those of simhash.fingerprint (A-Z lower-cased, runs without space and \\t..\\r); a shingle is SHINGLE words,
known by a 64-bit hash; a text of fewer words is one shingle, also one without words.  Only distinct sets are compared.  A set's
fingerprint has a 1 where over half of its shingles' hashes have one.

Keys of the join: with the shingles of every set in one order, two sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1
of their n shingles.  Any order is right; shingles that are common in a sample come last, so few sets meet.  A pair is followed
up only if its sizes, and what is left of both sets after the shared shingle, allow the similarity.

Links: below a key, sorted fingerprints are the leaves of a binary trie.  In a first round each leaf is paired with the one before
it, which ties the halves of every node, and with the first.  In a second one the trie is joined with itself, as in simhash, with
a budget of BITS; nodes that the first round has put into one component are not followed down.  So a large group of near copies costs its
size.  At similarity 0.8 a bit differs with a probability of about 0.15, 10 bits of 64, so hardly a link is outside the budget; pairs of
a key that are outside it, or whose fingerprints are equal, and whose components differ, are the rest, which isn't dropped.

Checks: each set has a sketch of n to 2 n bits, the parities of how many shingles fall on each.  The bits in which two sketches differ are
no more than the shingles that only one set has, so a pair with too many can't be similar.  The shingles of what is left, of the trie
join and of the rest, are intersected.

Disk: prefixes and sketches are written once, texts are read again only for the sets of the last check, and of the documents only those are
dealt out that may have a copy.  Which ones these are is told by bitmaps of a fixed size; false positives cost time only.

Nulls and edge cases: a null text is an empty one.  Of each component the row with the smallest (doc_id, hash of the text) stays,
null ids last; of equal rows, one.  Texts may be of any length.  An empty table gives an empty one.  All columns are passed on, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, materialize, spread, text_chunks
from .components import components
from .line_dedup import bitmap
from .simhash import ROWS_AT_ONCE, first_rows, trie_links

SHINGLE = 5
#: Documents of the sample that tells which shingles are common, and how many of those are told to the tasks.
SAMPLE_DOCS, COMMON = 40_000, 400_000
#: Differing bits of 64 within which the trie join pairs fingerprints; rows and pairs of nodes that it holds at once.
BITS, TRIE_ROWS, FRONTIER = 24, 50_000, 200_000
#: Size of the bitmaps that tell which rows are read again or dealt out.
MARKS = 1 << 25
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingles(text: str | None, known: dict) -> np.ndarray:
    """The sorted distinct shingles of a text, at least one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1 if size else 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _P + w[k : n + k]
    h = (h ^ (h >> np.uint64(29))) * _Q
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in rising order, how many documents of a sample have each), for those that two or more have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for _, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, known) for t in texts]))], ["h"])

    n = docs.count()
    picked = docs.where(spread(F.col("doc_id"), F.xxhash64("text"), F.lit("shingles")) < SAMPLE_DOCS / max(n, 1)).select(F.col("text").cast("string").alias("text"))
    found = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set under which it is looked up, in the common order."""
    h, n = common
    often = np.zeros(len(found), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, found), len(h) - 1)
        often = np.where(h[at] == found, n[at], 0)
    return found[np.lexsort((found, often))][: len(found) - (4 * len(found) + 4) // 5 + 1]


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        counts += np.unpackbits(found[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit; there are n to 2 n bits, a power of two, 64 at least."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """A number of shingles that at least one, but not both, of two sets must have, from their parities: the longer ones are folded."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set, n, fp, sketch, prefix) of each row of docs; equal sets have equal values."""
    key, sent = uuid.uuid4().hex, bounded_batches(docs.sparkSession).sparkContext.broadcast(_common(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("shingle-words", key, _Words)
        for rows, texts in text_chunks(batches):
            found = [shingles(t, known) for t in texts]
            cut = [_prefix(f, sent.value) for f in found]
            ends = np.cumsum([0, *map(len, cut)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cut)))
            values = [pa.array(_set_ids(found)), pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(fingerprint, found)), pa.int64()), pa.array(list(map(parities, found)), pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), *values, prefix], ["doc_id", "text_hash", "set", "n", "fp", "sketch", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set long, n long, fp long, sketch binary, prefix array<long>")


def _set_ids(found: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f.tobytes(), 42) for f in found], np.uint64).view(np.int64)


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text_hash)


def _has(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    at = keys.to_numpy(zero_copy_only=False) % MARKS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _marked(rows: DataFrame, key: Column, column: Column) -> Column:
    """Whether column may be the key of one of rows: always true if it is, and for few others."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(rows, key, MARKS))

    def has(keys: pa.Array) -> pa.Array:
        return pa.array(_has(sent.value, keys))

    return F.arrow_udf(has, "boolean")(column)


def _may_be(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, if this is the first shingle that they share, can have the similarity: 9 times what they share is 4 times their sizes."""
    return 9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])


def _groups(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by shingle, in parts that hold whole groups; shingles of a single row are left out."""

    def many(part: list[np.ndarray]) -> list[np.ndarray]:
        h = part[0]
        same = h[1:] == h[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return [x[keep] for x in part]

    have: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        have.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            part = [np.concatenate(x) for x in zip(*have, strict=True)]
            last = np.flatnonzero(part[0] != part[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield many([x[:cut] for x in part])
            have, size = [[x[cut:] for x in part]], size - cut
    if size:
        yield many([np.concatenate(x) for x in zip(*have, strict=True)])


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row, and the row after the last, of each row's group."""
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(heads, len(h)))
    return np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)


def _first_round(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (set, other) of each leaf with the one before it and its key's first, within the budget; and the rows of keys of three or more, other null."""
    for h, s, n, at, fp in _groups(batches, ["h", "set", "n", "at", "fp"]):
        if not len(h):
            continue
        head, end = _bounds(h)
        i = np.flatnonzero(np.arange(len(h)) > head)
        i, j = np.concatenate([i, i]), np.concatenate([i - 1, head[i]])
        ok = _may_be(n, at, i, j) & ((np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= BITS) | (end - head == 2)[i])
        pairs = np.unique(np.column_stack([np.minimum(s[i], s[j])[ok], np.maximum(s[i], s[j])[ok]]), axis=0)
        rows = np.flatnonzero(end - head > 2)
        none = pa.nulls(len(pairs), pa.int64())
        names = ["set", "other", "h", "n", "at", "fp"]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none, none], names)
        yield pa.RecordBatch.from_arrays([pa.array(s[rows]), pa.nulls(len(rows), pa.int64()), pa.array(h[rows]), pa.array(n[rows]), pa.array(at[rows]), pa.array(fp[rows])], names)


def _joined(h: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of one key whose components differ and whose fingerprints, sorted below the key, differ by 1 to BITS bits: the tries' self-join."""
    start = 0
    while start < len(h):
        stop = min(start + TRIE_ROWS, len(h))
        if stop < len(h):
            last = np.flatnonzero(h[start:stop] != h[stop])  # the last key may go on
            stop = start + int(last[-1]) + 1 if len(last) else start + int(np.argmax(np.append(h[start:], ~h[start]) != h[start]))
        part = slice(start, stop)
        for i, j in trie_links(h[part], fp[part], 64, BITS, root[part], FRONTIER):
            yield start + i, start + j
        start = stop


def _rest(h: np.ndarray, n: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs that _joined can't give: equal fingerprints, or more than BITS bits apart; their components differ too."""
    by = np.lexsort((n, h))
    h, n, fp, root = h[by], n[by], fp[by], root[by]
    _, end = _bounds(h)
    i, lag = np.arange(len(h)), 1
    while len(i := i[i + lag < end[i]]) and len(i := i[4 * n[i + lag] <= 5 * n[i]]):
        j = i + lag
        bits = np.bitwise_count(fp[i] ^ fp[j])
        ok = (root[i] != root[j]) & ((bits == 0) | (bits > BITS))
        if ok.any():
            yield by[i[ok]], by[j[ok]]
        lag += 1


def _second_round(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each key whose components differ: those of the trie join, and the rest."""
    for h, s, n, at, fp, root in _groups(batches, ["h", "set", "n", "at", "fp", "root"]):
        if not len(h):
            continue
        head, _ = _bounds(h)
        mixed = np.zeros(len(h), bool)
        mixed[head[root != root[head]]] = True
        # longs are sorted with their signs: with the first bit turned they are in the order of unsigned ones, which the tries need
        fp = fp.view(np.uint64) ^ np.uint64(1 << 63)
        h, s, n, at, fp, root = (x[mixed[head]] for x in (h, s, n, at, fp, root))
        if not len(h):
            continue
        for found in (_joined(h, fp, root), _rest(h, n, fp, root)):
            for i, j in found:
                ok = _may_be(n, at, i, j)
                if ok.any():
                    i, j = s[i[ok]], s[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a similarity of 0.8: 9 times the shingles that one set alone has are at most both sizes."""
    for batch in batches:
        sizes = batch.column("m").to_numpy() + batch.column("n").to_numpy()
        apart = np.fromiter(map(unlike, batch.column("x").to_pylist(), batch.column("y").to_pylist()), np.int64, batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(9 * apart <= sizes))


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is 0.8 or more."""
    sketches = [classes.select(F.col("set").alias(p), F.col("n").alias(n), F.col("sketch").alias(x)) for p, n, x in (("a", "m", "x"), ("b", "n", "y"))]
    pairs = materialize(pairs.where("a <> b").distinct(), "candidates")
    pairs = materialize(pairs.join(sketches[0], "a").join(sketches[1], "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_alike, "a long, b long"), "alike")
    met = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = classes.join(met, "set", "left_semi").select(_row_key(F.col("first.doc_id"), F.col("first.text_hash")).alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("key"), MARKS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for _, texts in text_chunks(b.filter(pa.array(_has(sent.value, b.column("key")))) for b in batches):
            found = [shingles(t, known) for t in texts]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_set_ids(found)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["set", "shingles"])

    texts = docs.select(F.col("text").cast("string").alias("text"), _row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"))
    # of equal rows one is enough
    sets = materialize(texts.mapInArrow(run, "set long, shingles array<long>").join(met, "set", "left_semi").dropDuplicates(["set"]), "shingles")
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _postings(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, set, n, at, fp) of each set's prefix, once for each set; only rows that may have a copy are dealt out for that."""
    key = _row_key(F.col("doc_id"), F.col("text_hash"))
    copied = _marked(found.join(classes.where("copies > 1"), "set", "left_semi"), key, key)
    firsts = classes.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    some = found.where(copied).join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").dropDuplicates(["set"])
    each = found.where(~copied).unionByName(some).select("set", "n", "fp", F.posexplode("prefix").alias("at", "h"))
    return each.select("h", "set", "n", F.col("at").cast("long").alias("at"), "fp")


def near_copy_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies: the one with the smallest (doc_id, hash of the text), null ids last; of equal rows, one."""
    found = materialize(_sets(docs), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = found.groupBy("set").agg(first.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "set-classes")
    met = materialize(_postings(found, classes).repartition("h").sortWithinPartitions("h", "fp", "set").mapInArrow(_first_round, "set long, other long, h long, n long, at long, fp long"), "first-round")
    links = materialize(_similar(docs, classes, met.where("other is not null").select(F.col("set").alias("a"), F.col("other").alias("b"))), "first-links")
    roots = components(links)
    crowded = met.where("other is null").join(roots.withColumnRenamed("node", "set"), "set", "left").select("h", "set", "n", "at", "fp", F.coalesce("root", "set").alias("root"))
    rest = crowded.repartition("h").sortWithinPartitions("h", "fp", "set").mapInArrow(_second_round, "a long, b long")
    roots = components(links.unionByName(_similar(docs, classes, rest)))
    joined = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("root", "set").alias("root"), "first", (F.col("root").isNotNull() | (F.col("copies") > 1)).alias("copied"))
    joined = materialize(joined, "roots")
    keep = joined.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash"))
    # rows without a copy stay where they are
    key = _row_key(F.col("doc_id"), F.col("text_hash"))
    copied = _marked(found.join(joined.where("copied"), "set", "left_semi"), key, _row_key(F.col("doc_id"), F.xxhash64("text")))
    return docs.where(~copied).union(first_rows(docs.where(copied), keep))
