"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprint: A-Z are lower-cased, words are runs without space and \\t..\\r, shingles are SHINGLE words joined by a space
(fewer words: all of them), repeats included.  A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).  A text
without words has fingerprint zero, which links like any other.

Links: fingerprints that differ in at most two bits.  Only distinct fingerprints are joined.  Two of them agree in at least two of
four 16-bit blocks, so each goes under six keys (which two blocks, their 32 bits).  Below a key, fingerprints sorted by the remaining
bits form a binary trie that is joined with itself: pairs of nodes are followed down together, differing bits add up, and a
pair is left once they exceed the budget.  A key that holds more than HOT distinct fingerprints is split first: the
remaining 32 bits have two differences in three blocks, so one block is equal and each fingerprint goes under three
longer keys; at most 2^22 can then share one.  A task reports the links of what it holds as stars of its local components, so what it emits grows
with fingerprints and not with pairs.  Components of the stars are the documents' components.

Nulls and edge cases: a null text is an empty one.  component_id is the smallest doc_id of the component, null only if all of its ids are
null.  Repeated rows have equal fingerprints and stay in the result.  Texts may be of any length.  An empty table gives an empty one.  simhash
reads no other columns, simhash_dedup passes them on, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, text_chunks
from .components import components, local_roots

SHINGLE, BUDGET, HOT, FRONTIER = 3, 2, 50_000, 2_000_000
ROWS_AT_ONCE = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    for at in range(0, n, 65536):
        parts = map(joined.__getitem__, map(slice, first[at : at + 65536], last[at : at + 65536]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(42)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of each row of docs; fp holds the 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(found)], ["doc_id", "text_hash", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def trie_links(group: np.ndarray, bits: np.ndarray, width: int, budget: int = BUDGET, root: np.ndarray | None = None, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of one group whose bits differ in 1 to `budget` places, in blocks.

    group and bits are sorted together; bits (uint64) count from `width` - 1 down.  A node of the trie is a range of rows
    that agree in the bits above its depth.  With `root`, pairs of rows of equal roots are left out, and nodes that hold one root are not joined.
    """
    n = len(bits)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    tails = np.append(heads[1:], n)
    many = tails - heads > 1
    heads, tails = heads[many], tails[many]
    if root is not None:
        turns = np.flatnonzero(np.append(root[1:] != root[:-1], True)) + 1
        run = np.repeat(turns, np.diff(np.append(0, turns)))  # place after the last row of the run of equal roots
        split = run[heads] < tails
        heads, tails = heads[split], tails[split]
    ones = [np.concatenate([[0], np.cumsum((bits >> np.uint64(d)) & np.uint64(1), dtype=np.int64)]) for d in range(width)]
    # pairs of nodes at equal depth: rows [a0, a1) and [b0, b1), and the bits that differ above
    stack = [(width, np.column_stack([heads, tails, heads, tails, np.zeros(len(heads), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > frontier:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        a0, a1, b0, b1, diff = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            rest = (bits[i] ^ bits[j]) & np.uint64((1 << depth) - 1)
            near = (np.bitwise_count(rest) + diff[single] <= budget) & (i != j)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, diff = pairs[~single].T
        if depth == 0 or not len(a0):
            # equal bits throughout each node; both nodes of a pair are one if no bit differs
            for x0, x1, y0, y1 in zip(*(x[a0 != b0] for x in (a0, a1, b0, b1)), strict=True):
                for x in range(x0, x1):
                    y = np.arange(y0, y1)
                    y = y if root is None else y[root[y] != root[x]]
                    if len(y):
                        yield np.full(len(y), x), y
            continue
        count = ones[depth - 1]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = (a0 == b0) & (a1 == b1)
        below = [
            np.column_stack([a0, am, b0, bm, diff]),
            np.column_stack([am, a1, bm, b1, diff]),
            np.column_stack([a0, am, bm, b1, diff + 1]),
            np.column_stack([am, a1, b0, bm, diff + 1])[~same],
        ]
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= budget)]
        pairs = pairs[~((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1))]  # a row with itself
        if root is not None:
            a0, a1, b0, b1, _ = pairs.T
            pairs = pairs[(root[a0] != root[b0]) | (run[a0] < a1) | (run[b0] < b1)]
        if len(pairs):
            stack.append((depth - 1, pairs))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))


def _six_keys(fp: Column) -> Column:
    """(key, rest) for each choice of two of four blocks; rest has the other two."""
    out = []
    for t, (i, j) in enumerate(itertools.combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        key = F.lit(t << 32).bitwiseOR(F.shiftleft(_block(fp, i), 16)).bitwiseOR(_block(fp, j))
        out.append(F.struct(key.alias("key"), F.shiftleft(_block(fp, k), 16).bitwiseOR(_block(fp, m)).alias("rest")))
    return F.array(*out)


#: The three blocks of the remaining 32 bits, as (shift, mask).
_PARTS = ((0, 0x7FF), (11, 0x7FF), (22, 0x3FF))


def _longer_keys(rest: Column) -> Column:
    return F.array(*(F.lit((k + 1) << 12).bitwiseOR(F.shiftright(rest, s).bitwiseAND(F.lit(m))).cast("long") for k, (s, m) in enumerate(_PARTS)))


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups in rows sorted by (key, part, rest), as edges from each fingerprint to the least of its local component."""

    def linked(key: np.ndarray, part: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else np.zeros(0, bool)
        edges = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i, j in trie_links(np.cumsum(change), rest.astype(np.uint64), 32):
            nodes, roots = local_roots(np.concatenate([edges[0], fp[i]]), np.concatenate([edges[1], fp[j]]))
            edges = nodes[nodes != roots], roots[nodes != roots]
        return pa.RecordBatch.from_arrays([pa.array(edges[1]), pa.array(edges[0])], ["a", "b"])

    have: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        have.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "rest", "fp")])
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            key, part, rest, fp = (np.concatenate(x) for x in zip(*have, strict=True))
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield linked(key[:cut], part[:cut], rest[:cut], fp[:cut])
            have, size = [[key[cut:], part[cut:], rest[cut:], fp[cut:]]], len(key) - cut
    if size:
        yield linked(*(np.concatenate(x) for x in zip(*have, strict=True)))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) whose components are those of fingerprints at most BUDGET bits apart; distinct: (fp), without repeats."""
    keyed = distinct.select("fp", F.explode(_six_keys(F.col("fp"))).alias("k")).select("fp", "k.key", "k.rest")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("crowded"))
    parts = F.when(F.col("crowded"), _longer_keys(F.col("rest"))).otherwise(F.array(F.lit(0).cast("long")))
    split = keyed.join(crowded, "key", "left").select("key", F.explode(parts).alias("part"), "rest", "fp")
    return split.repartition("key", "part").sortWithinPartitions("key", "part", "rest").mapInArrow(_stars, "a long, b long")


def clustered(found: DataFrame) -> DataFrame:
    """(fp, component_id, keep_id, keep_hash): the smallest doc_id of fp's component, and the smallest (doc_id, text_hash), nulls last; found: fingerprints()."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = materialize(found.groupBy("fp").agg(first.alias("first")), "fingerprints")
    roots = components(links(classes.select("fp")))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    return joined.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keep_hash"))


def simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text)."""
    found = materialize(fingerprints(docs, shingle), "simhash")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", "fp").join(clustered(found), "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of docs for each (id, hash) of keep, the doc_id and text hash of a row; columns stay as they are, whatever their names."""
    # rows are held in one struct, so their names can't meet ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("row.*")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component: the one with the smallest (doc_id, hash of the text), null ids last; of equal rows, one."""
    found = materialize(fingerprints(docs, shingle), "simhash")
    return first_rows(docs, clustered(found).select(F.col("component_id").alias("id"), F.col("keep_hash").alias("hash")).distinct())
