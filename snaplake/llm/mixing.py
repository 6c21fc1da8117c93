"""Mixing to target weights with soft memberships.

Classifier: a labelled table (doc_id, domain) gives the domains.  Features are white-space tokens, and shapes of tokens, that go with a domain
in the learning sample: log-likelihood ratio at least `ratio`, and `lift` times as often in its documents as in the rest.  A text's posterior
is naive Bayes over the features it has; a text without any has the shares of the domains among such documents of the sample.

Rates: with n tokens and posterior p for each document, rates 0 <= r <= most are fitted so that the expected tokens of each domain, the
sum of n * p * r, are its target.  The squared misses are measured by the inverse of the matrix sum of n * p p', domain by domain, and
rates by n, so that a projected gradient step of length 1 is the exact projection where no bound is met: r becomes r - p.s, held between the bounds,
with s the matrix's inverse times the misses.  A step with the matrix of the documents between the bounds is tried first and kept if it halves
what is left.  A document's rate follows from its posterior and the history of the s, so an iteration is one pass over the narrow table (n, p)
that sums a few numbers per domain, and nothing per document is kept between passes.  It ends when every domain is within `close` of its
own target, or when nothing improves any more (targets that can't all be met: the least squares solution); `residual` tells the largest relative miss.

Targets: weights of the domains; the domain with the largest weight keeps its present tokens unless `total` says how many tokens there
shall be.  Domains without any expected token are left out.  A rate of 2.3 means two copies, and a third with
probability 0.3, drawn by a hash of id and text.

Learning: about `sample_docs` labelled documents, drawn by a hash of the id; of near copies among them one is used.

Nulls and edge cases: null and empty texts have no tokens and the posterior of texts without features.  Without a labelled document all rates
are 1.  Ids may repeat or be null; equal rows have equal rates.  Texts may be of any length.  Of equally likely domains the one that sorts
first is named.  An empty table gives an empty one.  `mixed` passes on all columns, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Generations, bounded_batches, chunks, held, learn_rows, materialize, spread, sums_by_row, text_chunks
from .simhash import fingerprint
from .toxicity import first_of_alike

_CAPITAL, _SMALL = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+")
#: Target shares of tokens.
TARGETS = {"clean": 0.92, "junk": 0.04, "toxic": 0.04}
MOST, CLOSE, ROUNDS = 8.0, 1e-4, 60


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def shape(token: str) -> str:
    """A token's shape as a feature: runs of capital letters become A, runs of small ones a."""
    if token.isascii() and token.isalpha() and token.islower():  # as most are
        return "\x01a"
    return "\x01" + _SMALL.sub("a", _CAPITAL.sub("A", token))


class Classifier:
    """Posteriors of domains; weights are logs of how much likelier a feature is under each domain."""

    def __init__(self, domains: list[str], prior: np.ndarray, bare: np.ndarray, features: dict[str, np.ndarray]):
        self.domains, self.prior, self.bare = domains, np.log(prior), bare
        self.number = {f: i for i, f in enumerate(features)}
        self.weights = np.array(list(features.values())) if features else np.zeros((1, len(domains)))
        #: Sets of features that one token has, as itself and as its shape; a token is known by the number of its set.
        self.sets: list[tuple[int, ...]] = [()]
        self.set_number = {(): 0}
        self.codes = Generations(self._code, lambda token, _: 130 + 2 * len(token), 24 << 20)

    def _code(self, token: str) -> int:
        found = tuple(i for f in (token, shape(token)) if (i := self.number.get(f)) is not None)
        if (code := self.set_number.get(found)) is None:
            code = self.set_number[found] = len(self.sets)
            self.sets.append(found)
        return code

    def posteriors(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """Tokens of each text, and its posterior [texts, domains].  A feature counts once in a text."""
        sizes, found, counts = [], [], []
        for t in texts:
            words = t.split() if t else []
            sizes.append(len(words))
            mine = {i for code in set(map(self.codes.__getitem__, set(words))) for i in self.sets[code]}
            found += sorted(mine)
            counts.append(len(mine))
        logs = self.prior + np.round(sums_by_row(self.weights[np.array(found, np.int64)], counts), 9)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.array(counts) == 0] = self.bare
        return sizes, np.round(p, 9)


def learn(docs: DataFrame, labelled: DataFrame, sample_docs: int = 16_000, features: int = 20_000, ratio: float = 18.0, lift: float = 5.0) -> tuple | None:
    """Arguments of a Classifier from a bounded sample of labelled (doc_id, domain); None without any."""
    bounded_batches(docs.sparkSession)
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    known = known.where("doc_id is not null and domain is not null").where(learn_rows(F.col("doc_id"))).distinct()
    picked = known.orderBy(spread(F.col("doc_id"), F.lit("domain")), "doc_id", "domain").limit(sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Generations(lambda token: (token, shape(token)), lambda token, found: 300 + 4 * len(token))
        for part, texts in text_chunks(batches):
            once = [set(t.split()) if t else set() for t in texts]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.array(prints), pa.array([sorted({f for token in x for f in made[token]}) for x in once], pa.list_(pa.string()))], ["doc_id", "domain", "fp", "tokens"])

    sample = materialize(rows.mapInArrow(cut, "doc_id long, domain string, fp long, tokens array<string>"), "domain-sample")
    # of near copies one is used, else the words of a document that is there often would stand for its domain
    seen = sample.select("doc_id", "domain", "fp", F.size("tokens").alias("n")).orderBy("doc_id", "domain", "n", "fp").toArrow()
    alone = np.array(first_of_alike(seen.column("fp").to_numpy().view(np.uint64), seen.column("n").to_numpy()), np.int64)
    kept = docs.sparkSession.createDataFrame([tuple(r.values()) for r in seen.take(alone).select(["doc_id", "domain", "fp"]).to_pylist()], "doc_id long, domain string, fp long")
    sample = sample.join(F.broadcast(kept), ["doc_id", "domain", "fp"], "left_semi")
    size = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains, all_ = sorted(size), float(sum(size.values()))
    if not all_:
        return None
    each = sample.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(*(F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"n{k}") for k, d in enumerate(domains)))
    df = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0.0))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    strength = sum((2 * (part(F.col(f"n{k}"), df * size[d] / all_) + part(size[d] - F.col(f"n{k}"), (all_ - df) * size[d] / all_)) for k, d in enumerate(domains)), F.lit(0.0))
    # words that are a little commoner in longer documents would add up; a feature must stand out for a domain against the rest, whatever the domains' sizes
    stands_out = reduce(or_, [F.col(f"n{k}") * (all_ - size[d]) >= lift * (df - F.col(f"n{k}")) * size[d] for k, d in enumerate(domains)])
    chosen = each.withColumn("g", strength).where((F.col("g") >= ratio) & stands_out).orderBy(F.desc("g"), "token").limit(features).collect()
    share = np.array([size[d] for d in domains]) / all_
    weights = {}
    for r in chosen:
        seen = np.array([r[f"n{k}"] for k in range(len(domains))])
        overall = seen.sum() / all_
        weights[r["token"]] = np.log((seen + overall) / (np.array([size[d] for d in domains]) + 1)) - math.log(overall)
    bare = dict(size)
    if weights:
        names = docs.sparkSession.createDataFrame([(f,) for f in weights], "token string")
        having = sample.select("doc_id", "domain", F.explode("tokens").alias("token")).join(F.broadcast(names), "token", "left_semi").select("doc_id", "domain").distinct()
        for r in having.groupBy("domain").count().collect():
            bare[r["domain"]] = max(0, bare[r["domain"]] - r["count"])
    counts = np.array([bare[d] for d in domains], float) + share
    return domains, share, counts / counts.sum(), weights


def posteriors(docs: DataFrame, model: tuple) -> Column:
    """Struct (n: tokens, p: posterior as an array) of column text of docs; only the text goes through Python."""
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n: bigint, p: array<double>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = held("domains", key, lambda: Classifier(*sent.value))
        for column in columns:
            sizes, found = [], [np.zeros((0, len(mine.domains)))]
            for _, texts in chunks(column):
                n, p = mine.posteriors(texts)
                sizes += n
                found.append(p)
            flat = np.concatenate(found)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists], ["n", "p"])

    return run(F.col("text").cast("string"))


class Fit(NamedTuple):
    """Steps that lead to the rates; for each domain its present, wanted and reached tokens; the largest relative miss."""

    steps: list[list[float]]
    tokens: dict[str, tuple[float, float, float]]
    residual: float


def rate(steps: list[list[float]], p: Column, most: float = MOST) -> Column:
    """The rate that follows from a posterior and the history of steps; one plain expression, so Spark compiles it."""
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), r - sum((F.get(p, k) * F.lit(x) for k, x in enumerate(s)), F.lit(0.0))))
    return r


def fit(known: DataFrame, domains: list[str], targets: dict[str, float] | None = None, total: float | None = None, most: float = MOST, close: float = CLOSE) -> Fit:
    """Rates for a table (n, p)."""
    targets, d = targets or TARGETS, range(len(domains))
    p, n = F.col("p"), F.col("n").cast("double")

    def measure(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """(expected tokens at the rates, matrix of the documents that are between the bounds)."""
        rated = known.select("n", "p", rate(steps, p, most).alias("r"))
        free = F.when((F.col("r") > 0) & (F.col("r") < most), n).otherwise(0.0)
        row = rated.agg(*(F.sum(n * F.get(p, i) * F.col("r")) for i in d), *(F.sum(free * F.get(p, i) * F.get(p, j)) for i in d for j in d)).first()
        values = np.array([x or 0.0 for x in row])
        return values[: len(domains)], values[len(domains) :].reshape(len(domains), len(domains))

    now, whole = measure([])
    weight = np.array([targets.get(x, 0.0) for x in domains]) * (now > 0)
    if not weight.sum():
        return Fit([], {x: (float(a),) * 3 for x, a in zip(domains, now, strict=True)}, 0.0)
    weight /= weight.sum()
    anchor = int(weight.argmax())
    aim = weight * (total if total is not None else now[anchor] / weight[anchor])
    scale = np.maximum(aim, 1e-6 * aim.max())  # a domain of target 0 is measured against a millionth of the largest
    inverse = np.linalg.pinv(whole)
    steps: list[list[float]] = []
    reached, free = now, whole
    left = lambda x: float((x - aim) @ inverse @ (x - aim))
    bold = True
    for _ in range(ROUNDS):
        if (np.abs(reached - aim) <= close * scale)[now > 0].all():
            break
        matrix = np.linalg.pinv(free + 1e-9 * whole) if bold else inverse
        tried = [*steps, [round(float(x), 15) for x in matrix @ (reached - aim)]]
        got, free_now = measure(tried)
        gain = left(got) / max(left(reached), 1e-300)
        if bold and gain > 0.5:
            bold = False
            continue
        if gain > 1 - 1e-6:
            break
        steps, reached, free, bold = tried, got, free_now, True
    residual = float((np.abs(reached - aim) / scale)[now > 0].max())
    return Fit(steps, {x: (float(a), float(b), float(c)) for x, a, b, c in zip(domains, now, aim, reached, strict=True)}, residual)


def copies(rate_: Column, doc_id: Column, text_hash: Column) -> Column:
    return (F.floor(rate_) + (spread(doc_id, text_hash, F.lit("mix")) < rate_ - F.floor(rate_)).cast("int")).cast("int")


def mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, copies and residual (of the whole fit) of each row of docs."""
    model = learn(docs, labelled)
    doc_id = F.col("doc_id").cast("long")
    if model is None:
        n = F.coalesce(F.size(F.filter(F.split(F.col("text").cast("string"), "\\s+"), lambda x: x != "")), F.lit(0)).cast("long")
        return docs.select(doc_id.alias("doc_id"), n.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(0.0).alias("residual"))
    found = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("hash"), posteriors(docs, model).alias("found"))
    known = materialize(found.select("doc_id", "hash", "found.n", "found.p"), "posteriors")
    fitted = fit(known, model[0], targets, total, most)
    names = F.array(*(F.lit(d) for d in model[0]))
    likeliest = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    rated = known.withColumn("rate", rate(fitted.steps, F.col("p"), most))
    return rated.select("doc_id", F.col("n").alias("n_tokens"), likeliest.alias("domain"), F.col("p").alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id"), F.col("hash")).alias("copies"), F.lit(fitted.residual).alias("residual"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, most: float = MOST) -> DataFrame:
    """docs with each row as often as its rate says; columns stay as they are."""
    model = learn(docs, labelled)
    if model is None:
        return docs
    # rows are held in one struct, so their names can't meet ours; the fit reads n and p alone
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("hash"), posteriors(docs, model).alias("found"))
    known = materialize(rows.select("row", "hash", "found.n", "found.p"), "posteriors")
    fitted = fit(known.select("n", "p"), model[0], targets, total, most)
    n = copies(rate(fitted.steps, F.col("p"), most), F.col("row.doc_id"), F.col("hash"))
    return known.select("row", F.explode(F.array_repeat(F.lit(1), n))).select("row.*")
