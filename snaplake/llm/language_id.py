"""Language identification by segmentation-marginalised unigrams.

The letters of a text, lower-cased, form words (runs of letters), each led by the space mark.  For each language, pieces of a fixed
public vocabulary have probabilities; the probability of a word is the sum, over all its segmentations into pieces, of the products of
their probabilities (a forward algorithm; words of over LONG characters are read with scaling, so none is cut).  As no piece spans words, a
text's likelihood is the product over its words, and words are computed once per Python worker while its cache holds them.  The
prediction is the language of the largest likelihood; the score is its posterior under a uniform prior.

Learning: expectation-maximisation of piece probabilities on word counts of a bounded sample of labelled documents: `sample_docs` whole
documents per language, drawn by a hash of the id; of their distinct words the `sample_words` times the number of languages most
frequent ones.  For learning alone, words are cut every LEARN_LETTERS letters, so the driver's memory is bounded as well.

Nulls and edge cases: text null or without letters is `und`, score 0.  With no labelled document at all, everything is `und`.  Null ids
stay null and count as not held out.  Ties go to the language that sorts first.  Repeated rows have equal results.  Texts and words may
be of any length.  An empty table gives an empty one.  language_filter passes on all columns, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TokenRows, bounded_batches, chunks, held, held_out, spread, sums_by_row
from .lattice import PieceTrie
from .vocabulary import SPACE, load_pieces

#: Words up to this length are summed many at a time in plain floats: the least probability of a piece to this power is still a number above zero.
LONG, LEARN_LETTERS = 33, 256
_RUN = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def letter_words(text: str) -> list[str]:
    return [SPACE + run for run in _RUN.findall(text.lower())]


def letter_pieces(path: str | None = None) -> list[str]:
    """Pieces that lower-cased words can hold."""
    return [p for p in load_pieces(path) if (s := p.lstrip(SPACE)) and s.isalpha() and s == s.lower() and p.count(SPACE) <= 1]


class LanguageModel:
    """Piece probabilities [pieces, languages] over a fixed trie."""

    def __init__(self, languages: list[str], p: np.ndarray, trie: PieceTrie):
        self.languages, self.p, self.trie = languages, p, trie
        self.tokens = TokenRows(len(languages) + 1, self._token_values)

    def word_logs(self, words: list[str]) -> np.ndarray:
        """log of the summed probability of each word, [words, languages]."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            lattice = self.trie.edges([words[i] for i in short])
            out[short] = np.log(lattice.forward(self.p)[lattice.last])
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > LONG:
                    out[i] = self.trie.long_word(w, self.p)
        return out

    def _token_values(self, tokens: list[str]) -> np.ndarray:
        """For white-space separated tokens: sums of their words' logs, and the number of words."""
        words, counts = [], []
        for t in tokens:
            found = letter_words(t)
            words += found
            counts.append(len(found))
        if not words:
            return np.zeros((len(tokens), len(self.languages) + 1))
        return sums_by_row(np.column_stack([self.word_logs(words), np.ones(len(words))]), counts)

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray]:
        """Prediction, score, and log-likelihoods [texts, languages] of each text."""
        tokens, counts = [], []
        for t in texts:
            found = t.split() if t else []
            tokens += found
            counts.append(len(found))
        sums = sums_by_row(self.tokens.lookup(tokens), counts)
        logs, n = sums[:, :-1], sums[:, -1]
        best = logs.argmax(axis=1)
        posterior = np.exp(logs - logs.max(axis=1, keepdims=True))
        score = posterior.max(axis=1) / posterior.sum(axis=1)
        named = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
        return named, [float(s) if k else 0.0 for s, k in zip(score, n, strict=True)], logs


def fit(counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """Piece probabilities from word counts of each language; each piece keeps a share of the mean over languages, so none is zero."""
    languages, trie = sorted(counts), PieceTrie(pieces)
    prior = np.array([0.02 ** (len(p) - 1) for p in trie.pieces] + [1e-4] * trie.n_blocks)
    p = np.tile(prior[:, None] / prior.sum(), (1, len(languages)))
    words = [list(counts[name]) for name in languages]
    weights = [np.array(list(counts[name].values()), float) for name in languages]
    for _ in range(rounds):
        used = np.zeros_like(p)
        for k in range(len(languages)):
            for at in range(0, len(words[k]), 8192):  # lattices of all words at once would fill the driver
                used[:, k] += trie.edges(words[k][at : at + 8192]).expected(p[:, [k]], weights[k][at : at + 8192])
        share = used / np.maximum(used.sum(axis=0), 1)
        p = 0.998 * share + 0.0019 * share.mean(axis=1, keepdims=True) + 0.0001 / len(p)
    return languages, p


def learn(docs: DataFrame, sample_docs: int = 400, sample_words: int = 60_000, tokenizer: str | None = None) -> tuple[list[str], np.ndarray, list[str]]:
    """(languages, probabilities, pieces) from the rows of docs with a lang that may be learned from."""
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces = letter_pieces(tokenizer)
    if not have:
        return [], np.zeros((0, 0)), pieces
    shares = F.create_map(*(F.lit(x) for lang, n in have.items() for x in (lang, sample_docs / n)))
    picked = labelled.where(spread(F.col("doc_id"), F.lit("language")) < shares[F.col("lang")])
    runs = picked.select("lang", F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where("word <> ''")
    counted = runs.groupBy("lang", "word").count().orderBy(F.desc("count"), "word", "lang").limit(sample_words * len(have)).toArrow()
    counts: dict[str, dict[str, float]] = {}
    for batch in counted.to_batches(8192):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine = counts.setdefault(lang, {})
            for w in letter_words(word):
                for at in range(0, len(w), LEARN_LETTERS):
                    part = w[at : at + LEARN_LETTERS]
                    mine[part] = mine.get(part, 0) + n
    counts = {lang: c for lang, c in counts.items() if c}
    languages, p = fit(counts, pieces) if counts else ([], np.zeros((0, 0)))
    return languages, p, pieces


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray, list[str]]) -> Column:
    """Struct (lang_pred, score) of column text of docs; only the text goes through Python."""
    languages, p, pieces = model
    if not languages:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    key, sent = uuid.uuid4().hex, bounded_batches(docs.sparkSession).sparkContext.broadcast((languages, p, pieces))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = held("language", key, lambda: LanguageModel(sent.value[0], sent.value[1], PieceTrie(sent.value[2])))
        for column in columns:
            named, score = [], []
            for _, texts in chunks(column):
                found = mine.scores(texts)
                named += found[0]
                score += found[1]
            yield pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return run(F.col("text").cast("string"))


def language_id(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text, lang); learned from its own labelled rows."""
    found = docs.select("doc_id", identified(docs, learn(docs, tokenizer=tokenizer)).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def language_filter(docs: DataFrame, least: float = 0.5, tokenizer: str | None = None) -> DataFrame:
    """Rows of docs whose language is determined with a score of at least `least`; columns stay as they are."""
    found = identified(docs, learn(docs, tokenizer=tokenizer))
    return docs.where((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least))
