"""Language, quality, toxicity and mixing: learned models against definitions and held-out rows; edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplake.llm import crf_quality as Q
from snaplake.llm import language_id as L
from snaplake.llm import mixing as M
from snaplake.llm import toxicity as X
from snaplake.llm.lattice import PieceTrie

ENGLISH = "the and of to in that is was for it with as his on be at by this had not".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def summed(word, p, trie):
    """Probability of a word over all segmentations, by recursion."""
    number = {x: i for i, x in enumerate(trie.pieces) if len(x) > 1}

    def at(i):
        if i == len(word):
            return 1.0
        total = p[trie.own(word[i])] * at(i + 1)
        for j in range(i + 2, len(word) + 1):
            if (k := number.get(word[i:j])) is not None:
                total += p[k] * at(j)
        return total

    return at(0)


def test_forward_sums_all_segmentations():
    trie = PieceTrie(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "漢"])
    rng = np.random.default_rng(0)
    p = rng.random((trie.size, 2))
    words = ["▁" + "".join(x) for n in range(1, 5) for x in itertools.product("abcж漢", repeat=n)][:300]
    lattice = trie.edges(words)
    got = lattice.forward(p)[lattice.last]
    for k in range(2):
        assert np.allclose(got[:, k], [summed(w, p[:, k], trie) for w in words])
    assert np.allclose(np.log(got), [trie.long_word(w, p) for w in words])
    used = lattice.expected(p[:, [0]], np.ones(len(words)))
    step = 1e-6  # expected uses are the derivative of the log of the sum
    for piece in ("a", "漢", "ab", "abc"):
        more = p.copy()
        more[trie.pieces.index(piece), 0] *= 1 + step
        change = np.log(lattice.forward(more)[lattice.last, 0]) - np.log(got[:, 0])
        assert used[trie.pieces.index(piece)] == pytest.approx(change.sum() / step, rel=1e-3, abs=1e-6)


def test_every_letter_piece_is_used_and_long_words_do_not_vanish():
    pieces = L.letter_pieces()
    trie = PieceTrie(pieces)
    p = np.full((trie.size, 2), 1 / trie.size)
    numbers = {int(x) for at in range(0, len(pieces), 4000) for x in trie.edges(pieces[at : at + 4000]).piece}
    assert {trie.pieces.index(x) if len(x) == 1 else i for i, x in enumerate(trie.pieces)} <= numbers
    model = L.LanguageModel(["a", "b"], p, trie)
    word = "▁" + "漢ひж" * 400
    assert np.isfinite(model.word_logs([word, "▁" + "ж" * 32])).all()
    whole, parts = model.word_logs([word])[0], model.word_logs([word[:30]])[0]
    assert (whole < 30 * parts).all()


def language_scores(model, text):
    """Posteriors by the definition, by recursion and for each word alone."""
    logs = np.zeros(len(model.languages))
    words = L.letter_words(text or "")
    for w in words:
        logs += np.log([summed(w, model.p[:, k], model.trie) for k in range(len(model.languages))])
    return (model.languages[logs.argmax()], float(1 / np.exp(logs - logs.max()).sum())) if words else (L.UNDETERMINED, 0.0)


def test_language_id(spark, documents):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        words, lang = (ENGLISH, "en") if i % 2 else (GERMAN, "de")
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)), lang))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 -- 34", "en"), (None, "the and of that", None), (503, "the\x00and", None)]
    out = {r["doc_id"]: r for r in L.language_id(documents(rows)).collect()}
    assert len(out) == len(rows)
    for i, _, lang in rows[:160]:
        assert out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (500, 501, 502))
    assert out[None]["lang_pred"] == "en" and out[None]["held_out"] is False
    learned = L.learn(documents(rows))
    model = L.LanguageModel(learned[0], learned[1], PieceTrie(learned[2]))
    for i, t, _ in rows:
        want = language_scores(model, t)
        assert out[i]["lang_pred"] == want[0] and out[i]["score"] == pytest.approx(want[1], abs=1e-9)
        assert out[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(600, "the " * 300_000, None), (601, "漢" * 100_000, None), rows[3], rows[3]]
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("lang_pred", "score", "found", "_language_", "pythonUDF0")})
    kept = L.language_filter(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows} - {500, 501, 502, 601}
    assert {r["score"] for r in kept.collect()} == {"mine"} and kept.where("doc_id = 3").count() == 3
    assert L.language_id(documents([])).count() == 0
    assert {r["lang_pred"] for r in L.language_id(documents([(1, "text", None)])).collect()} == {"und"}
    # a tie goes to the language that sorts first
    tied = L.LanguageModel(["a", "b"], np.full((model.trie.size, 2), 0.1), model.trie)
    assert tied.scores(["the"])[:2] == (["a"], [0.5])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    per_text = np.array([3, 0, 1, 4])
    emit, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, pairs, total = Q.Chains(per_text).forward_backward(emit, trans)
    want, want_pairs, want_total = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    for start, n in ((0, 3), (3, 1), (4, 4)):
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = math.exp(sum(emit[start + i, y[i]] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
        z = sum(weights.values())
        want_total += math.log(z)
        for y, w in weights.items():
            for i in range(n):
                want[start + i, y[i]] += w / z
                if i:
                    want_pairs[y[i - 1], y[i]] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and total == pytest.approx(want_total)


def plain_quality(text, model):
    """The length-weighted share of good lines, summed over every labelling of the lines."""
    own, length, per_text = Q.line_features([text])
    emit = Q.with_neighbours(own, per_text) @ model[0]
    total, good = 0.0, np.zeros(len(emit))
    for y in itertools.product((0, 1), repeat=len(emit)):
        w = math.exp(sum(emit[i, k] for i, k in enumerate(y)) + sum(model[1][a, b] for a, b in itertools.pairwise(y)))
        total += w
        good += w * np.array(y)
    return float((good / total * length).sum() / length.sum())


def test_quality(spark, documents):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        lines = [" ".join(rng.choice(ENGLISH) for _ in range(12)).capitalize() + "." if good else " ".join(rng.choice(ENGLISH).upper() + "!!" for _ in range(12)) for _ in range(4)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "The and of.")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in Q.quality(documents(rows), labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(out[i]["predicted"] == int(i % 3 > 0) for i in range(200))
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    model = Q.learn(documents(rows), labels)
    rows += [(950, "the\n\nTHE!! and\nof that"), (951, "a\n" * 20_000), (952, "the " * 250_000), rows[0], rows[0]]
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("score", "label", "quality", "found")})
    again = Q.quality(df, labels).collect()
    assert len(again) == len(rows)
    for r in again:
        if r["doc_id"] in (None, 0, 1, 950):
            text = next(t for d, t in rows if d == r["doc_id"])
            assert r["score"] == pytest.approx(plain_quality(text, model), abs=1e-9)
    assert all(out[i]["score"] == 0 for i in (900, 901, 902))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.quality(documents([(1, "a b")]), none).collect()} == {0.5}
    assert Q.quality(documents([]), labels).count() == 0


def test_block_max_index_equals_a_full_scan():
    rng = np.random.default_rng(6)
    n, n_terms, scored = 1500, 120, 0
    counts = [{int(t) + 60 * (i % 2): int(c) for t, c in zip(rng.zipf(1.3, 7) % 60, rng.integers(1, 4, 7), strict=True)} for i in range(n)]
    counts[7] = counts[9] = counts[11]
    example = np.repeat(np.arange(n), [len(c) for c in counts])
    term, value = (np.array([x for c in counts for x in f(c)]) for f in (dict.keys, dict.values))
    value = value / np.sqrt(np.bincount(example, value * value, minlength=n))[example]
    index = X.BlockMaxIndex(example, term, value, n, n_terms)
    assert sorted(index.order.tolist()) == list(range(n))
    dense = np.zeros((n, n_terms))
    dense[example, term] = value
    for i in range(0, n, 23):
        terms = np.flatnonzero(dense[i])
        sums = np.round(dense @ dense[i], 12)
        for skip in (-1, i):
            want = [j for j in np.lexsort((np.arange(n), -sums)).tolist() if sums[j] > 0 and j != skip][:25]
            score, found, blocks = index.top(terms, dense[i][terms], 25, skip)
            assert found.tolist() == want and score.tolist() == sums[want].tolist()
            scored += blocks
    assert scored < 2 * len(range(0, n, 23)) * index.n_blocks  # some blocks are never scored


def plain_toxicity(examples, texts):
    """Scores by the definition, with a full scan: examples are (doc_id, label, text)."""
    bags = [Counter(t[:4] for t in re.findall(r"[^\W_]+", t.lower())) for _, _, t in examples]
    df = Counter(t for b in bags for t in b)

    def unit(bag):
        v = {t: (1 + math.log(n)) * math.log(1 + len(bags) / df[t]) for t, n in bag.items() if t in df}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    vectors, labels = [unit(b) for b in bags], [y for _, y, _ in examples]

    def vote(v, skip=None):
        sims = sorted(((-round(sum(w * u.get(t, 0) for t, w in v.items()), 12), i) for i, u in enumerate(vectors) if i != skip))
        near = [(-s, i) for s, i in sims if s < 0][:X.NEAREST]
        weights = [1 / (0.05 + math.sqrt(max(0, 2 - 2 * s))) for s, _ in near]
        return (sum(w * labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights) if near else None), near

    knots = X.isotonic(*zip(*sorted((v, y) for i, y in enumerate(labels) if (v := vote(vectors[i], i)[0]) is not None), strict=True))
    out = []
    for t in texts:
        bag = Counter(x[:4] for x in re.findall(r"[^\W_]+", (t or "").lower()))
        v, near = vote(unit(bag)) if bag else (None, [])
        out.append((0.0 if not bag else float(np.interp(v, *knots)) if near else sum(labels) / len(labels), [(examples[i][0], labels[i]) for _, i in near[:5]]))
    return out


@pytest.mark.parametrize("share", [2, 6])  # half of the labels toxic, or a sixth
def test_toxicity(spark, documents, share, monkeypatch):
    monkeypatch.setattr(X, "first_of_alike", lambda prints, sizes: list(range(len(prints))))
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(ENGLISH) + str(rng.randrange(40)) for _ in range(12)]
        if i % share == 0:
            words[rng.randrange(4)] = "nasty"
            words[4 + rng.randrange(8)] = rng.choice(["vile", "vilest"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % share == 0)))
    rows += [(900, None), (901, ""), (902, "-- !"), (903, "漢字"), (None, "so VILE!, nasty"), rows[4], (904, "vile " * 200_000)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("score", "found", "evidence", "label", "terms", "fp")})
    got = X.toxicity(df, labels).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    seen = [(i, int(i % share == 0), t) for i, t in sorted(rows[:300]) if zlib.crc32(str(i).encode()) % 4 != 2]
    for (i, t), (score, near) in zip(rows, plain_toxicity(seen, [t for _, t in rows]), strict=True):
        r = out[i]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)
        assert [(e["doc_id"], e["toxic"]) for e in r["evidence"]] == near
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(out[i]["predicted"] == int(i % share == 0) for i in range(300)) >= 255
    assert out[None]["predicted"] == 1 and {e["toxic"] for r in out.values() for e in r["evidence"]} == {0, 1}
    assert all(out[i]["score"] == 0 for i in (900, 901, 902))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in X.toxicity(documents([(1, "a")]), none).collect()} == {0.0}
    assert X.toxicity(documents([]), labels).count() == 0


def test_mixing_reaches_its_targets(spark, documents):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        kind = "clean" if i % 4 else "junk"
        rows.append((i, " ".join((rng.choice(ENGLISH) if kind == "clean" else rng.choice(GERMAN) + "##") for _ in range(30))))
        labels.append((i, kind))
    rows += [(900, None), (None, "")]
    df, labelled = documents(rows), spark.createDataFrame(labels, "doc_id long, domain string")
    out = M.mixing(df, labelled, {"clean": 0.9, "junk": 0.1}).collect()
    reached = {d: sum(r["n_tokens"] * r["rate"] for r in out if r["domain"] == d) for d in ("clean", "junk")}
    assert len(out) == len(rows) and all(r["rate"] >= 0 for r in out)
    assert reached["junk"] / sum(reached.values()) == pytest.approx(0.1, abs=0.01)
    kept = M.mixed(df, labelled, {"clean": 0.9, "junk": 0.1})
    assert kept.columns == df.columns
    n = {r["doc_id"]: r["copies"] for r in out}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, c in n.items() for _ in range(c) if d is not None)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r["rate"] for r in M.mixing(df, none).collect()} == {1.0} and M.mixed(df, none).count() == len(rows)


def test_rate_follows_its_definition(spark):
    steps = [[0.5, -0.2], [-0.1, 0.3], [1.5, 0.0]]
    for p in ([1.0, 0.0], [0.25, 0.75]):
        r = 1.0
        for s in steps:
            r = max(0.0, min(3.0, r - sum(a * b for a, b in zip(p, s, strict=True))))
        got = spark.range(1).select(F.array(*map(F.lit, p)).alias("p")).select(M.rate(steps, F.col("p"), 3.0).alias("r")).first()["r"]
        assert got == pytest.approx(r)


def least_squares(n, p, aim, most):
    """Least misses (in the fit's metric) over rates between the bounds, by coordinate descent to convergence."""
    metric = np.linalg.pinv((p * n[:, None]).T @ p)
    r, reached = np.ones(len(n)), n @ p
    curve = np.einsum("ij,jk,ik->i", p, metric, p) * n
    for _ in range(3000):
        for i in range(len(n)):
            if curve[i] > 0:
                new = min(most, max(0.0, r[i] - float(p[i] @ metric @ (reached - aim)) / curve[i]))
                reached = reached + n[i] * p[i] * (new - r[i])
                r[i] = new
    return float((reached - aim) @ metric @ (reached - aim)), metric


@pytest.mark.parametrize(("targets", "total", "most"), [({"a": 0.8, "b": 0.1, "c": 0.1}, None, 8.0), ({"a": 0.01, "b": 0.01, "c": 0.98}, 40_000.0, 8.0), ({"a": 0.1, "b": 0.1, "c": 0.8}, 9000.0, 1.5), ({"a": 1.0, "b": 0.0, "c": 0.0}, None, 8.0)])
def test_fit_equals_nonnegative_least_squares(spark, targets, total, most):
    rng = np.random.default_rng(5)
    n, p = rng.integers(1, 200, 40), np.round(rng.dirichlet([0.6, 0.3, 0.2], 40), 9)
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    fitted = M.fit(known, ["a", "b", "c"], targets, total, most)
    rates = np.array([r["r"] for r in known.select(M.rate(fitted.steps, F.col("p"), most).alias("r")).collect()])
    assert (rates >= 0).all() and (rates <= most).all()
    aim = np.array([fitted.tokens[d][1] for d in "abc"])
    reached = (n * rates) @ p
    assert reached == pytest.approx([fitted.tokens[d][2] for d in "abc"])
    least, metric = least_squares(n.astype(float), p, aim, most)
    got = float((reached - aim) @ metric @ (reached - aim))
    assert got <= least * 1.02 + 2e-3 * float(aim @ metric @ aim)
    if least < 1e-9:  # the targets can be met
        assert fitted.residual <= M.CLOSE


def test_mixing_of_two_equal_domains_and_odd_rows(spark, documents):
    rng = random.Random(10)
    rows = [(i, " ".join(f"{'x' if i % 2 else 'y'}{rng.randrange(6)} {rng.choice(ENGLISH)}" for _ in range(20))) for i in range(120)]
    labelled = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(120)], "doc_id long, domain string")
    rows += [(500, None), (501, ""), (502, "y1 " * 300_000), rows[3], rows[3]]
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("n", "p", "row", "hash", "found", "col", "_tokens_", "_copies_", "rate")})
    out = M.mixing(df, labelled, {"odd": 0.5, "even": 0.5})
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and all(got[i]["domain"] == ("odd" if i % 2 else "even") for i in range(120))
    assert got[500]["n_tokens"] == got[501]["n_tokens"] == 0 and got[502]["n_tokens"] == 300_000
    kept = M.mixed(df, labelled, {"odd": 0.5, "even": 0.5})
    assert kept.columns == df.columns and kept.schema == df.schema or kept.dtypes == df.dtypes
    assert {r["p"] for r in kept.collect()} == {"mine"}
    assert M.mixing(documents([]), labelled).count() == 0 and M.mixed(documents([]), labelled).count() == 0


def plain_posterior(model, text):
    """Naive Bayes by the definition: (tokens, posterior)."""
    domains, prior, bare, weights = model
    words = (text or "").split()
    found = {f for w in words for f in (w, M.shape(w)) if f in weights}
    if not found:
        return len(words), np.asarray(bare)
    logs = np.log(prior) + sum(weights[f] for f in found)
    p = np.exp(logs - logs.max())
    return len(words), p / p.sum()


def test_posteriors_equal_naive_bayes(spark, documents):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "x#", "the", "of"] if i % 2 else ["gamma", "Delta", "y!", "the", "of"]) for _ in range(9))) for i in range(160)]
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(160)], "doc_id long, domain string")
    df = documents([*rows, (900, None), (901, "the of")])
    model = M.learn(df, labelled)
    assert model[3]
    for r in M.mixing(df, labelled).join(df.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")).collect():
        n, p = plain_posterior(model, r["text"])
        assert r["n_tokens"] == n and r["posterior"] == pytest.approx(p.tolist(), abs=1e-7)
