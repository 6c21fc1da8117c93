"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

Observations of a line are features of the line itself, of the line before and of the line after it (zeros beyond the ends).  The field has
one weight vector and a 2x2 transition table.  Forward-backward gives each line's probability of being good; the mean of
these, weighted by the lines' lengths in characters, is the document's score.  Lines without a word don't take part.

Learning: gradient ascent (Adam) on the conditional log-likelihood, where every line of a labelled document has the document's label, over
a bounded sample: `sample_docs` whole documents for each label, drawn by a hash of the id, and of these no more than have half of `sample_bytes`.

Nulls and edge cases: null and empty texts, and texts without a word, have score 0.  Without labelled documents of both kinds every other score is
0.5.  Null ids stay null and count as not held out.  Repeated rows have equal scores.  Texts may be of any length; one with very many lines
takes a step of forward-backward for each.  An empty table gives an empty one.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, held_out, learn_rows, spread

#: Bytes counted for each line: symbols, bars, exclamation marks, digits, capital and small ASCII letters, sentence punctuation.
CLASSES = (b"#*$%&<>{}[]\\^~_=+@", b"|", b"!", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:?")
_TABLE = np.zeros(256, np.uint8)
for _k, _class in enumerate(CLASSES):
    _TABLE[list(_class)] = _k + 1
N_OWN = len(CLASSES) + 9
N_FEATURES = 3 * N_OWN


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features [lines, N_OWN], length of each line, lines of each text) of the lines that have a word."""
    lines, words_of, per_text = [], [], []
    seen_before: list[float] = []
    for t in texts:
        n, seen = 0, set()
        for line in t.split("\n") if t else ():
            words = line.split()
            if words:
                lines.append(line)
                seen_before.append(float(line in seen))
                seen.add(line)
                words_of.append((len(words), len(set(words)), sum(map(eq, words, words[1:])), words[-1][-1] in ".!?"))
                n += 1
        per_text.append(n)
    if not lines:
        return np.zeros((0, N_OWN)), np.zeros(0), np.array(per_text, np.int64)
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    kind = _TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    share = [np.add.reduceat((kind == k + 1).astype(np.float32), starts) / size for k in range(len(CLASSES))]
    words, distinct, again, stopped = np.array(words_of, float).T
    length = np.fromiter(map(len, lines), np.float64, len(lines))
    own = np.column_stack(
        [*share, np.ones(len(lines)), np.log(words) / 5, length / words / 10, (words < 4), distinct / words, again / np.maximum(words - 1, 1), stopped, np.array(seen_before), np.minimum(again, 5) / 5]
    )
    return own, length, np.array(per_text, np.int64)


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(per_text)), per_text)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = text[1:] == text[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.hstack([own, before, after])


class Chains:
    """Lines of many texts, arranged so that the t-th lines of all texts that have one are handled together."""

    def __init__(self, per_text: np.ndarray):
        self.order = np.argsort(-per_text, kind="stable")
        self.sizes = per_text[self.order]
        starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])[self.order] if len(per_text) else np.zeros(0, np.int64)
        self.steps = []
        live = int((self.sizes > 0).sum())
        t = 0
        while live:
            self.steps.append(starts[:live] + t)
            t += 1
            live = int(np.searchsorted(-self.sizes[:live], -t, side="left"))

    def forward_backward(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals [lines, 2], expected transitions [2, 2] and log-likelihood of the partition, for log emissions [lines, 2]."""
        n = len(emit)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t, rows in enumerate(self.steps):
            if t == 0:
                alpha[rows] = emit[rows]
            else:
                came = alpha[self.steps[t - 1][: len(rows)]]
                alpha[rows] = emit[rows] + np.logaddexp(came[:, [0]] + trans[0], came[:, [1]] + trans[1])
        pairs = np.zeros((2, 2))
        total = 0.0
        for t in range(len(self.steps) - 1, -1, -1):
            rows = self.steps[t]
            more = len(self.steps[t + 1]) if t + 1 < len(self.steps) else 0
            if more:
                nxt = self.steps[t + 1]
                ahead = emit[nxt] + beta[nxt]
                beta[rows[:more]] = np.logaddexp(trans[:, 0] + ahead[:, [0]], trans[:, 1] + ahead[:, [1]])
        norm = np.logaddexp.reduce(alpha + beta, axis=1) if n else np.zeros(0)
        for t in range(1, len(self.steps)):
            nxt = self.steps[t]
            rows = self.steps[t - 1][: len(nxt)]
            joint = alpha[rows][:, :, None] + trans[None] + (emit[nxt] + beta[nxt])[:, None, :] - norm[rows][:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        if self.steps:
            total = float(norm[self.steps[0]].sum())
        return np.exp(alpha + beta - norm[:, None]), pairs, total


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights [N_FEATURES, 2], transitions [2, 2]) that maximise the penalised likelihood."""
    own, _, per_text = line_features(texts)
    x = with_neighbours(own, per_text)
    y = np.repeat(np.array(labels), per_text)
    chains = Chains(per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    hot = np.eye(2)[y]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    weights, trans = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for k in range(1, rounds + 1):
        marginal, pairs, _ = chains.forward_backward(x @ weights, trans)
        grads = (x.T @ (hot - marginal) / len(x) - ridge * weights, (seen - pairs) / len(x) - ridge * trans)
        for i, (value, g) in enumerate(zip((weights, trans), grads, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return weights, trans


def document_scores(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    own, length, per_text = line_features(texts)
    out = np.zeros(len(texts))
    if len(own):
        good = Chains(per_text).forward_backward(with_neighbours(own, per_text) @ model[0], model[1])[0][:, 1]
        text = np.repeat(np.arange(len(per_text)), per_text)
        total = np.bincount(text, length, minlength=len(texts))
        out = np.bincount(text, length * good, minlength=len(texts)) / np.maximum(total, 1)
    return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500, sample_bytes: int = 16 << 20) -> tuple[np.ndarray, np.ndarray] | None:
    """A model from labels (doc_id, quality) and their texts; None unless both labels are there."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(learn_rows(F.col("doc_id"))).distinct()
    draw = spread(F.col("doc_id"), F.lit("quality"))
    picked = reduce(DataFrame.unionByName, (known.where(F.col("label") == y).orderBy(draw, "doc_id").limit(sample_docs) for y in (0, 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").where("text rlike '\\\\S'").distinct()
    # the first by the draw, as far as the bytes go; a label's share of them is its own
    upto = Window.partitionBy("label").orderBy(draw, "doc_id", "text")
    fitting = rows.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= sample_bytes // 2)
    got = fitting.select("text", "label").orderBy(draw, "doc_id", "label", "text").collect()
    return fit([r["text"] for r in got], [r["label"] for r in got]) if len({r["label"] for r in got}) == 2 else None


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of each row of docs (doc_id, text)."""
    model = learn(docs, labels)
    sent = bounded_batches(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [document_scores(texts, sent.value) if sent.value is not None else np.array([0.5 if t and t.split() else 0.0 for t in texts]) for _, texts in chunks(column)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
