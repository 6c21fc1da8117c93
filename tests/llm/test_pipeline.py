"""Each stage of the pipeline against brute force on its own whole input."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as plain_lines
from test_models import plain_posterior
from test_near_copies import brute as plain_near_copies

import corpus_pipeline as P
from snaplake.llm import language_id as L
from snaplake.llm import mixing as M
from snaplake.llm import sentencepiece_nbest as S
from snaplake.llm.lattice import PieceTrie

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage, and the last one's output."""
    docs = [P.table(spark, DATA, "documents")]
    for name, stage in P.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs[-1], DATA).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_and_whole_run(spark, stages):
    assert all(d.columns == COLUMNS for d in stages[:-1])
    assert sorted(map(str, P.run(spark, DATA).collect())) == sorted(map(str, stages[-1].collect()))


def plain_word_logs(word, p, trie, number):
    """Forward sums of one word, a character at a time."""
    at = [np.ones(p.shape[1])]
    for j in range(1, len(word) + 1):
        total = at[j - 1] * p[trie.own(word[j - 1])]
        for i in range(max(0, j - trie.longest), j - 1):
            if (k := number.get(word[i:j])) is not None:
                total = total + at[i] * p[k]
        at.append(total)
    return np.log(at[-1])


def test_language_stage(stages):
    languages, p, pieces = L.learn(stages[0])
    trie = PieceTrie(pieces)
    number, known, want = {x: i for i, x in enumerate(trie.pieces) if len(x) > 1}, {}, []
    for d, t in rows(stages[0]):
        logs = np.zeros(len(languages))
        words = L.letter_words(t or "")
        for w in words:
            if w not in known:
                known[w] = plain_word_logs(w, p, trie, number)
            logs = logs + known[w]
        if words and 1 / np.exp(logs - logs.max()).sum() >= 0.5:
            want.append((d, t))
    assert sorted(rows(stages[1]), key=str) == sorted(want, key=str)


def test_line_stage(stages):
    before = rows(stages[1])
    kept = plain_lines(before)
    assert sorted(rows(stages[2]), key=str) == sorted(((d, t if t is None else kept[(d, t)]) for d, t in before), key=str)


def test_near_copy_stage(stages):
    assert sorted(d for d, _ in rows(stages[3])) == plain_near_copies(rows(stages[2]))


def test_mixing_stage(spark, stages):
    labelled = M.domains_of_labels(P.table(spark, DATA, "labels"))
    model = M.learn(stages[3], labelled)
    after = Counter(rows(stages[4]))
    if model is None:
        assert after == Counter(rows(stages[3]))
        return
    known = [(t, *plain_posterior(model, t)) for _, t in rows(stages[3])]
    table = spark.createDataFrame([(n, [round(float(x), 9) for x in p]) for _, n, p in known], "n long, p array<double>")
    fitted = M.fit(table, model[0])
    n, p = np.array([k[1] for k in known], float), np.array([k[2] for k in known])
    r = np.ones(len(known))
    for s in fitted.steps:
        r = np.clip(r - p @ np.array(s), 0, M.MOST)
    for (d, t), rate in zip(rows(stages[3]), r, strict=True):
        assert math.floor(rate - 1e-6) <= after[(d, t)] <= math.ceil(rate + 1e-6)
    reached, aim = (n * r) @ p, np.array([fitted.tokens[d][1] for d in model[0]])
    assert reached == pytest.approx([fitted.tokens[d][2] for d in model[0]], rel=1e-3, abs=1)
    if fitted.residual > M.CLOSE:  # the targets can't all be met: the rates are those of the least squares, where no projected step helps
        inverse = np.linalg.pinv((p * n[:, None]).T @ p)
        left = lambda x: float((x - aim) @ inverse @ (x - aim))
        further = np.clip(r - p @ inverse @ (reached - aim), 0, M.MOST)
        assert left((n * further) @ p) >= left(reached) * (1 - 1e-4)


def test_sentencepiece_stage(spark, stages):
    encoder = S.NBest(4)
    out = {r["doc_id"]: r for r in stages[5].collect()}
    assert stages[5].count() == stages[4].count()
    for d, t in dict(rows(stages[4])).items():
        text, best = " " + t, [0.0]
        for j in range(1, len(text) + 1):  # the best path over the whole text, uncut
            edges = [best[i] + encoder.pieces[text[i:j]][0] for i in range(max(0, j - encoder.longest), j) if text[i:j] in encoder.pieces]
            if text[j - 1] not in encoder.pieces:
                edges.append(best[j - 1] - 16.0 * len(text[j - 1].encode()))
            best.append(max(edges))
        r = out[d]
        if t:
            assert r["nbest_scores"][0] == pytest.approx(best[-1], abs=1e-4) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
        ids = encoder.encode(t)[0].tolist()
        assert r["decoded_equal"] and encoder.decode(ids) == t
        assert (r["n_tokens"], r["ids_sha1"]) == (len(ids), hashlib.sha1(",".join(map(str, ids)).encode()).hexdigest())


CLASHES = ("row", "hash", "found", "n", "p", "th", "id", "done", "exact", "near", "text_hash", "lang_pred", "score", "set", "root", "_id", "_hash_", "_tokens_", "_copies_", "_language_", "_lines_")


@pytest.mark.parametrize("stage", P.STAGES[:-1], ids=lambda s: s[0])
def test_odd_rows_and_clashing_names(spark, documents, stage):
    rng = random.Random(3)
    word = lambda: rng.choice("the and of to in that is was for it with as his on be at by this".split())
    texts = [" ".join(word() for _ in range(30)) for _ in range(12)]
    made = [(i, t, "en", "s") for i, t in enumerate(texts)]
    made += [made[3], made[3], (100, None), (101, ""), (102, "the " * 300_000, "en"), (None, texts[5], None, None), (None, None)]
    df = documents(made).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in CLASHES})
    out = stage[1](spark, df, DATA)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[c] == f"{c}-{-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)
    assert stage[1](spark, df.limit(0), DATA).count() == 0


def test_last_stage_with_odd_rows(spark, documents):
    made = [(1, None), (2, ""), (2, ""), (None, "a  b\n\n   c"), (3, "x" * 10**6)]
    df = documents(made).withColumns({c: F.lit("mine") for c in ("ids", "nbest", "decoded_equal", "n_tokens")})
    out = P.sentencepiece(spark, df, DATA).collect()
    assert len(out) == 5 and all(r["decoded_equal"] for r in out if r["doc_id"] != 1)
    assert P.sentencepiece(spark, df.limit(0), DATA).count() == 0
