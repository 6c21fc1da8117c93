"""Toxicity: distance-weighted votes of the nearest labelled examples, found by exact TF-IDF cosine over a block-max inverted index.

Terms are the first STEM characters of runs of letters and digits, lower-cased; all terms of the examples are used, whatever their labels.
An example's vector has (1 + ln count) * ln(1 + examples / examples with the term), at length 1; so has a text's, over the terms that an example has.

Index: examples lie in blocks of BLOCK, alike ones together (halved again and again along the main axis of their common terms).  For
each term it has the blocks where it occurs, its largest weight in each, and its postings there; for terms that many examples have, postings are
rows of weights, which some queries at once are multiplied with.  A query adds up the blocks' bounds, takes blocks in falling order of their
bounds, a few at first and then all that may still reach the k-th best, so results equal those of a full scan; ties go to the
example with the smaller doc_id.

Score: the NEAREST examples vote with weights 1 / (0.05 + distance); an isotonic curve, fitted to the votes that examples get from the
others, turns votes into probabilities.  A text with terms, but none that an example has, scores the examples' share of toxic ones.  Evidence
are the nearest examples with their similarities and labels.

Learning: `examples` labelled documents at most, the first by a hash of the id, and of these no more than have `postings` terms in all; of near copies
one is used.

Nulls and edge cases: null and empty texts and texts without a letter or digit score 0 and have no evidence; without any labelled document every score is
0; null ids stay null and count as not held out.  Repeated rows have equal results.  Texts may be of any length.  An empty table gives an empty
one.  Other columns of the tables aren't read, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, held, held_out, learn_rows, materialize, spread, text_chunks
from .simhash import fingerprint

NEAREST, BLOCK, EVIDENCE, STEM, DENSE, AT_ONCE = 25, 64, 5, 4, 640, 32
_TERM, _STEM = re.compile(r"[^\W_]+"), itemgetter(slice(0, STEM))


def terms_of(text: str | None) -> Counter:
    return Counter(map(_STEM, _TERM.findall(text.lower()))) if text else Counter()


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start up to its stop, one range after the other, and the ranges' lengths."""
    size = stop - start
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else start
    return np.arange(len(shift)) + shift, size


def alike_together(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """An order of the examples: halved along the main axis of their weights of the 256 commonest terms until a part fits a block."""
    df = np.bincount(term, minlength=n_terms)
    common = np.argsort(-df, kind="stable")[:256]
    column = np.full(n_terms, -1)
    column[common] = np.arange(len(common))
    dense, use = np.zeros((n, max(1, len(common)))), column[term] >= 0
    dense[example[use], column[term[use]]] = weight[use]
    parts, done = [np.arange(n)], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        rows = dense[part] - dense[part].mean(axis=0)
        axis = np.linalg.eigh(rows.T @ rows)[1][:, -1]
        axis *= np.sign(axis[np.abs(axis).argmax()]) or 1.0
        part = part[np.argsort(np.round(rows @ axis, 9), kind="stable")]
        middle = BLOCK * max(1, round(len(part) / BLOCK / 2))
        parts += [part[middle:], part[:middle]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Exact top-k by inner product over sparse vectors of length 1, given as entries (example, term, weight).

    The postings of a term that one in 64 of the examples has are kept as a row of weights, zeros included (DENSE terms at most); those of
    others as lists.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        #: The example at each place; places beyond the last example stand for none.
        self.order = alike_together(example, term, weight, n, n_terms)
        self.n, self.n_blocks = n, -(-n // BLOCK)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        at = place[example]
        df = np.bincount(term, minlength=n_terms)
        common = np.argsort(-df, kind="stable")[:DENSE]
        common = common[64 * df[common] >= n]
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.rows = np.zeros((len(common), self.n_blocks * BLOCK))
        self.rows[self.row[term[dense]], at[dense]] = weight[dense]
        term, at, weight = term[~dense], at[~dense], weight[~dense]
        by = np.lexsort((at, term))
        term, at = term[by], at[by]
        self.place, self.weight = at, weight[by]
        block = at // BLOCK
        heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(by) else np.zeros(0, np.int64)
        #: Entry (term, block): its postings, block and largest weight; and each term's entries.
        self.posting = np.append(heads, len(by))
        self.block = block[heads]
        self.most = np.maximum.reduceat(self.weight, heads) if len(by) else np.zeros(0)
        self.entry = np.searchsorted(term[heads], np.arange(n_terms + 1))

    def common_parts(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the score of each place, [queries, places]."""
        values = np.zeros((len(queries), len(self.rows)))
        for i, (terms, value) in enumerate(queries):
            row = self.row[terms]
            values[i, row[row >= 0]] = value[row >= 0]
        return values @ self.rows

    def top(self, terms: np.ndarray, values: np.ndarray, k: int, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(similarities, examples) of the k best over 0, best first, without example `skip`; and how many blocks were scored."""
        common = self.common_parts([(terms, values)])[0] if common is None else common
        rare = self.row[terms] < 0
        entries, size = ranges(self.entry[terms[rare]], self.entry[terms[rare] + 1])
        value, block = np.repeat(values[rare], size), self.block[entries]
        bound = common.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, value * self.most[entries], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        found, score = np.zeros(0, np.int64), np.zeros(0)
        at, least, stop = 0, 0.0, min(self.n_blocks, 2 + -(-(k + 1) // BLOCK))
        while at < stop:
            taken = np.zeros(self.n_blocks, bool)
            taken[order[at:stop]] = True
            use = taken[block]
            chosen = entries[use]
            postings, size = ranges(self.posting[chosen], self.posting[chosen + 1])
            sums = common + np.bincount(self.place[postings], np.repeat(value[use], size) * self.weight[postings], minlength=len(common))
            places = np.flatnonzero(sums > max(0.0, least - 1e-9))
            places = places[taken[places // BLOCK]]
            found, score = np.concatenate([found, self.order[places]]), np.concatenate([score, np.round(sums[places], 12)])
            if skip >= 0:
                score, found = score[found != skip], found[found != skip]
            if len(score) > k:
                near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                score, found = score[near], found[near]
                best = np.lexsort((found, -score))[:k]
                score, found = score[best], found[best]
                least = float(score[-1])
            at, stop = stop, int(np.searchsorted(-bound[order], -(least - 1e-9), side="right")) if least > 0 else int((bound > 0).sum())
        best = np.lexsort((found, -score))
        return score[best], found[best], at


def vote(similarity: np.ndarray, labels: np.ndarray) -> float:
    weights = 1 / (0.05 + np.sqrt(np.maximum(0.0, 2 - 2 * similarity)))
    return float((weights * labels).sum() / weights.sum())


def isotonic(x: list[float], y: list[int]) -> tuple[list[float], list[float]]:
    """Knots of the rising curve of least squares (pool adjacent violators), with one case of each label added at the ends."""
    pools: list[list[float]] = []
    for a, b in [(0.0, 0), *sorted(zip(x, y, strict=True)), (1.0, 1)]:
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][2] == pools[-2][3] == a or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return [v for p in pools for v in (p[2], p[3])], [p[0] / p[1] for p in pools for _ in range(2)]


class Voter:
    """The labelled examples (ids in rising order, labels) with their terms, as entries (example, term, count), and the calibration's knots."""

    def __init__(self, terms: list[str], ids: np.ndarray, labels: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], knots: tuple | None = None):
        example, term, count = entries
        self.terms, self.ids, self.labels, self.knots = terms, ids, labels, knots
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = np.log(1 + len(ids) / np.maximum(1, np.bincount(term, minlength=len(terms))))
        weight = (1 + np.log(count)) * self.idf[term]
        weight /= np.sqrt(np.bincount(example, weight * weight, minlength=len(ids)))[example]
        self.entries = example, term, weight
        self.index = BlockMaxIndex(example, term, weight, len(ids), len(terms))
        self.share = float(labels.mean()) if len(labels) else 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(terms, weights) of a text at length 1, over the terms that an example has; None for a text without terms."""
        bag, number = terms_of(text), self.number
        if not bag:
            return None
        known = sorted((number[t], n) for t, n in bag.items() if t in number)
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, counts = (np.array(x) for x in zip(*known, strict=True))
        values = (1 + np.log(counts)) * self.idf[terms]
        return terms, values / np.sqrt((values * values).sum())

    def nearest(self, texts: list[str | None], skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(similarities, examples) of the nearest examples of each text, without its own one; None for texts without terms."""
        made = [self.vector(t) for t in texts]
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        full = [i for i, v in enumerate(made) if v is not None]
        for a in range(0, len(full), AT_ONCE):
            some = full[a : a + AT_ONCE]
            for i, common in zip(some, self.index.common_parts([made[i] for i in some]), strict=True):
                out[i] = self.index.top(*made[i], NEAREST, -1 if skip is None else skip[i], common)[:2]
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """(probability, [(example's id, similarity, label)]) of each text."""
        out = []
        for near in self.nearest(texts):
            if near is None:
                out.append((0.0, []))
            elif not len(near[0]):
                out.append((self.share, []))
            else:
                p = float(np.interp(vote(near[0], self.labels[near[1]]), *self.knots))
                out.append((p, [(int(self.ids[i]), float(s), int(self.labels[i])) for s, i in zip(near[0][:EVIDENCE], near[1][:EVIDENCE], strict=True)]))
        return out


def first_of_alike(prints: np.ndarray, sizes: np.ndarray, bits: int = 12, least: int = 10) -> list[int]:
    """Places of examples whose fingerprint is over `bits` bits from those kept before; ones of under `least` terms all stay."""
    left, kept = np.ones(len(prints), bool), []
    for i in range(len(prints)):
        if left[i]:
            kept.append(i)
            if sizes[i] >= least:
                left[i + 1 :] &= (np.bitwise_count(prints[i + 1 :] ^ prints[i]) > bits) | (sizes[i + 1 :] < least)
    return kept


def learn(docs: DataFrame, labels: DataFrame, examples: int = 4_000, postings: int = 2_000_000) -> tuple | None:
    """Arguments of a Voter from labels (doc_id, toxic) and their texts; None without any."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(learn_rows(F.col("doc_id"))).distinct()
    draw = spread(F.col("doc_id"), F.lit("toxic"))
    picked = known.orderBy(draw, "doc_id", "label").limit(examples)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            found = [terms_of(t) for t in texts]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(prints), rows.column("text"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["doc_id", "label", "fp", "text", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").distinct()
    sample = materialize(rows.mapInArrow(cut, "doc_id long, label int, fp long, text string, terms array<string>, counts array<long>"), "toxic-sample")
    # copies of one document must not lend it the weight of many: of examples with alike texts, the first one stays
    seen = sample.select("doc_id", "label", "fp", F.size("terms").alias("n")).where("n > 0").orderBy(draw, "doc_id", "label", "fp").toArrow()
    alone = np.array(first_of_alike(seen.column("fp").to_numpy().view(np.uint64), seen.column("n").to_numpy()), np.int64)
    alone = alone[np.cumsum(seen.column("n").to_numpy()[alone]) <= postings]
    kept = docs.sparkSession.createDataFrame([tuple(r.values()) for r in seen.take(alone).select(["doc_id", "label", "fp"]).to_pylist()], "doc_id long, label int, fp long")
    sample = sample.where(F.size("terms") > 0).join(F.broadcast(kept), ["doc_id", "label", "fp"], "left_semi")
    got = sample.select("doc_id", "label", "terms", "counts").orderBy("doc_id", "label", "fp").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    terms = got.column("terms").combine_chunks()
    example = np.repeat(np.arange(got.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    coded = terms.flatten().dictionary_encode()
    # terms are numbered in their own order, so that results don't depend on how rows came
    names = coded.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    entries = example, rank[coded.indices.to_numpy()], got.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    model = (sorted(names), got.column("doc_id").to_numpy(), got.column("label").to_numpy().astype(np.int64), entries)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held("toxicity-examples", key, lambda: Voter(*sent.value))
        for rows, texts in text_chunks(batches):
            places = np.searchsorted(mine.ids, rows.column("doc_id").to_numpy()).tolist()
            near = mine.nearest(texts, places)
            votes = [vote(x[0], mine.labels[x[1]]) if x is not None and len(x[0]) else None for x in near]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), rows.column("label")], ["vote", "label"])

    votes = sample.select("doc_id", "label", "text").repartition(64).mapInArrow(others, "vote double, label int").where("vote is not null").orderBy("vote", "label").collect()
    return (*model, isotonic([r["vote"] for r in votes], [r["label"] for r in votes]))


_NEAR = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `threshold` on) and evidence (the nearest examples) of each row of docs."""
    model = learn(docs, labels)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, evidence: array<struct<doc_id: bigint, similarity: double, toxic: int>>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = held("toxicity", key, lambda: Voter(*sent.value)) if sent.value is not None else None
        for column in columns:
            score, near = [], []
            for _, texts in chunks(column):
                for p, found in mine.scores(texts) if mine else [(0.0, [])] * len(texts):
                    score.append(p)
                    near.append([{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in found])
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(near, _NEAR)], ["score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("found"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.evidence")
