"""Line dedup: exact copies and lines one edit away from an earlier line, by a deletion-neighbourhood join.

A line's words are compared lower-cased; white space doesn't count.  Lines without a word are left alone.  Lines are ordered by doc_id
(nulls last), a hash of the text and the line's number.  A line is dropped if
  * an earlier line has the same words, or
  * it is the first of its copies and one edit away from an earlier line that is the first of its own.
One edit is an inserted, deleted or replaced word where the longer line has `near_words` words (a typing error is one replaced word), else an
inserted, deleted or replaced character, white space counting as one, where the longer line has `near_chars` characters: about one
edit in eight units at most, as one word in three, or the number of a list item, makes another line.
The earliest line is always kept.  Dropping goes by pairs, not chains: the earlier line need not be kept itself.

Steps, none of which makes pairs within a group:
  1. Every line gives a 128-bit key of its words, and hashes of the first and last halves of its words and, if it is short, of its characters.
     Keys are counted with map-side minima.
  2. Lines one edit apart share their first or their last half.  Halves that two different lines have are set in a bitmap of fixed size;
     lines with a half whose bit is set go on (false positives cost time only).
  3. These emit their neighbourhood: a hash for each deletion of one unit in the half that may differ, and one of the whole line.
     Lines with equal variants at the same place differ by a replaced unit: each is paired with the earliest of them.  A line that equals
     another's variant lacks one of its units: each is paired with the line, and the line with the earliest of them.
  4. The pairs' texts are fetched and their edit distance is verified.
  5. Documents are joined with the numbers of their dropped lines.

Nulls and edge cases: null and empty texts stay as they are.  Rows with equal doc_id and text are one document for the order, and keep the
same lines.  A document that loses every line keeps an empty text.  Texts and lines may be of any length.  An empty table gives an empty one.  All
other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, materialize, text_chunks

NEAR_WORDS, NEAR_CHARS, BITMAP_BITS, HOT_KEYS = 8, 8, 1 << 27, 10_000
_ORDER = ["none", "doc_id", "th", "line"]


def words_of(line: str) -> list[str]:
    return line.lower().split()


def _hash(text: str) -> int:
    """64 bits, signed."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def views(words: list[str], near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> list[tuple[bool, list[str] | str, bool]]:
    """(by words, units, whether units may be deleted) of a line: a line that is one unit too short for an edit can only be the shorter one."""
    out: list[tuple[bool, list[str] | str, bool]] = []
    if len(words) >= near_words - 1:
        out.append((True, words, len(words) >= near_words))
    if len(words) < near_words:
        text = " ".join(words)
        if len(text) >= near_chars - 1:
            out.append((False, text, len(text) >= near_chars))
    return out


def halves(units: list[str] | str) -> list[tuple[int, int, int]]:
    """(hash, first place of an edit, place after the last one) of the halves that a line one edit away may share."""
    n, out, kind = len(units), [], "c" if isinstance(units, str) else "w"
    join = (lambda x: x) if kind == "c" else " ".join
    for q in sorted({n // 2, (n - 1) // 2}):
        out.append((_hash(f"{kind}<{q} {join(units[:q])}"), q, n))
        out.append((_hash(f"{kind}>{q} {join(units[n - q :])}"), 0, n - q))
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def variants(units: list[str] | str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the whole line, at place -1, and of the line without the unit at each place in spans."""
    with np.errstate(over="ignore"):
        if isinstance(units, str):
            w = (np.frombuffer(units.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX
            w = (w ^ (w >> np.uint64(31))) * _MIX
        else:
            w = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in units], np.uint64)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(w) - 1, _ODD)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(w * powers, dtype=np.uint64)])
        without = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    use = np.zeros(len(w), bool)
    for a, b in spans:
        use[a:b] = True
    places = np.flatnonzero(use)
    return np.concatenate([sums[-1:], without[places]]).view(np.int64), np.concatenate([[-1], places]).astype(np.int32)


def edit_within_one(a: list[str] | str, b: list[str] | str) -> bool:
    """Edit distance of at most 1 in units."""
    if abs(len(a) - len(b)) > 1:
        return False
    k, m = 0, min(len(a), len(b))
    while k < m and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))


def _keys(docs: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """Each line with words: its order, 128-bit key, and the halves of its views."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            at, line, k1, k2, half = [], [], [], [], []
            for i, t in enumerate(texts):
                for n, x in enumerate(t.split("\n") if t else ()):
                    if words := words_of(x):
                        key = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                        at.append(i), line.append(n)
                        k1.append(int.from_bytes(key[:8], "little", signed=True)), k2.append(int.from_bytes(key[8:], "little", signed=True))
                        half.append([h for _, units, _ in views(words, near_words, near_chars) for h, _, _ in halves(units)])
            doc = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(doc), rows.column("th").take(doc), pa.array(line, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(half, pa.list_(pa.int64()))], ["doc_id", "th", "line", "k1", "k2", "halves"])

    return _rows(docs).mapInArrow(run, "doc_id long, th long, line int, k1 long, k2 long, halves array<long>").select(F.col("doc_id").isNull().alias("none"), "*")


def bitmap(hashes: DataFrame, column: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """The set of hashes modulo `bits`, as bytes; at most bits / 8 of them reach the driver, whatever the input."""
    at = F.pmod(column, F.lit(bits)) + 1
    parts = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return out


def _candidates(docs: DataFrame, lines: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """First copies of lines that share a half with a different line, by words or characters: lid (rises with the order), order, words and the places that may be deleted."""
    shared = lines.select(F.explode("halves").alias("h"), "k1").groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(shared, F.col("h")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

        def has(h: int) -> bool:
            h %= BITMAP_BITS
            return bool(bits[h >> 3] >> (h & 7) & 1)

        for rows, texts in text_chunks(batches):
            doc, th = rows.column("doc_id").to_pylist(), rows.column("th").to_pylist()
            best: dict[tuple[bool, str], tuple] = {}
            for i, t in enumerate(texts):
                for n, x in enumerate(t.split("\n") if t else ()):
                    for by_words, units, deletes in views(words_of(x), near_words, near_chars):
                        found = [(a, b) for h, a, b in halves(units) if has(h)]
                        if found:
                            key = (by_words, " ".join(units) if by_words else units)
                            new = ((doc[i] is None, doc[i] or 0, th[i], n), [{"a": a, "b": b} for a, b in found] if deletes else [])
                            old = best.setdefault(key, new)
                            if new[0] < old[0]:
                                best[key] = new
            cols = list(zip(*((None if none else d, h, n, v, w, s) for (v, w), ((none, d, h, n), s) in best.items()), strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "th", "line", "by_words", "words", "spans"])

    found = _rows(docs).mapInArrow(run, "doc_id long, th long, line int, by_words boolean, words string, spans array<struct<a: int, b: int>>")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line", "spans")
    firsts = found.groupBy("by_words", "words").agg(F.min(order).alias("o")).select("o.*", "by_words", "words")
    firsts = materialize(firsts, "near-lines")
    return materialize(firsts.orderBy(*_ORDER, "by_words").select(F.monotonically_increasing_id().alias("lid"), *_ORDER, "by_words", "words", "spans"), "near-ranked")


def _units(by_words: bool, words: str) -> list[str] | str:
    return words.split(" ") if by_words else words


def _neighbourhood(lines: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in text_chunks(batches, "words", 200_000):
            spans = [[(s["a"], s["b"]) for s in x] for x in part.column("spans").to_pylist()]
            made = [variants(_units(v, w), s) for v, w, s in zip(part.column("by_words").to_pylist(), words, spans, strict=True)]
            size = [len(v) for v, _ in made]
            lid, by_words = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), size) for c in ("lid", "by_words"))
            yield pa.RecordBatch.from_arrays([pa.array(by_words), pa.array(np.concatenate([v for v, _ in made])), pa.array(np.concatenate([p for _, p in made])), pa.array(lid)], ["by_words", "v", "place", "lid"])

    return lines.select("lid", "by_words", "words", "spans").mapInArrow(run, "by_words boolean, v long, place int, lid long")


def _near(lines: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """lid of each candidate line that is one edit away from an earlier one."""
    made = materialize(_neighbourhood(lines), "variants")
    without, whole = made.where("place >= 0"), made.where("place < 0").select("by_words", "v", F.col("lid").alias("other"))
    earliest = without.groupBy("by_words", "v", "place").agg(F.min("lid").alias("win"), F.max("lid").alias("most")).where("win < most").select("by_words", "v", "place", "win")
    replaced = without.join(earliest, ["by_words", "v", "place"]).where("win < lid").select("lid", "win")
    lacking = without.join(whole, ["by_words", "v"]).select("lid", "other")
    longer = lacking.where("other < lid").select("lid", F.col("other").alias("win"))
    shorter = lacking.where("lid < other").groupBy(F.col("other").alias("lid")).agg(F.min("lid").alias("win"))
    pairs = replaced.unionByName(longer).unionByName(shorter).distinct()

    def near(by_words: bool, a: str, b: str) -> bool:
        x, y = _units(by_words, a), _units(by_words, b)
        return max(len(x), len(y)) >= (near_words if by_words else near_chars) and edit_within_one(x, y)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in text_chunks(batches, "words"):
            ok = list(map(near, part.column("by_words").to_pylist(), words, part.column("against").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("lid").filter(pa.array(ok, pa.bool_()))], ["lid"])

    texts = lines.select("lid", "by_words", "words")
    against = lines.select(F.col("lid").alias("win"), F.col("words").alias("against"))
    return pairs.join(texts, "lid").join(against, "win").select("lid", "by_words", "words", "against").mapInArrow(verify, "lid long").distinct()


def dropped_lines(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, th, exact, near) of each document (th: hash of its text) that loses lines: their numbers, sorted."""
    bounded_batches(docs.sparkSession)
    lines = materialize(_keys(docs, near_words, near_chars), "lines")
    firsts = materialize(lines.groupBy("k1", "k2").agg(F.min(F.struct(*_ORDER)).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-lines")
    # fewer than HOT_KEYS lines can have more copies than this, so these are sent to all tasks; the others' copies are dealt by key
    common = F.col("n") > max(1000, lines.count() // HOT_KEYS)
    hot, rest, each = F.broadcast(firsts.where(common)), firsts.where(~common), lines.select("k1", "k2", F.struct(*_ORDER).alias("o"))
    copies = each.join(hot, ["k1", "k2"]).unionByName(each.join(hot, ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    exact = copies.where(F.col("o") != F.col("first")).select("o.*", F.lit(False).alias("is_near"))
    ranked = _candidates(docs, lines, near_words, near_chars)
    near = ranked.select("lid", *_ORDER).join(_near(ranked, near_words, near_chars), "lid", "left_semi").select(*_ORDER, F.lit(True).alias("is_near"))
    found = exact.unionByName(near).groupBy("doc_id", "th")
    numbers = lambda flag: F.array_sort(F.collect_set(F.when(F.col("is_near") == flag, F.col("line"))))
    return materialize(found.agg(numbers(False).alias("exact"), numbers(True).alias("near")), "dropped-lines")


def _keep(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without its dropped lines, lines with words, and how many lines are dropped."""
    for column, exact, near in columns:
        kept, n_lines = [], []
        for start, texts in chunks(column):
            for t, a, b in zip(texts, exact.slice(start, len(texts)).to_pylist(), near.slice(start, len(texts)).to_pylist(), strict=True):
                lines = t.split("\n") if t else []
                gone = {*(a or ()), *(b or ())}
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else t)
                n_lines.append(sum(1 for x in lines if x and not x.isspace()))
        counts = [pc.fill_null(pc.list_value_length(x), 0).cast(pa.int64()) for x in (exact, near)]
        yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), *counts], ["kept", "n_lines", "n_exact", "n_near"])


def _applied(docs: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """(row, done): docs' rows as structs, so that their names can't meet ours, and what _keep gives for each."""
    dropped = dropped_lines(docs, near_words, near_chars).withColumnsRenamed({"doc_id": "id", "th": "text_hash"})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("text_hash")), "left")
    keep = F.arrow_udf(_keep, "struct<kept: string, n_lines: bigint, n_exact: bigint, n_near: bigint>")
    return joined.select("row", keep(F.col("row.text").cast("string"), "exact", "near").alias("done"))


def line_dedup(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the dropped lines taken out of its texts; rows and columns stay as they are."""
    return _applied(docs, near_words, near_chars).select(*(F.col("done.kept").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, lines with words, exact and near copies dropped, and the SHA-1 of what is left, for each row of docs."""
    return _applied(docs.select("doc_id", "text"), near_words, near_chars).select("row.doc_id", "done.n_lines", "done.n_exact", "done.n_near", F.sha1("done.kept").alias("kept_sha1"))
