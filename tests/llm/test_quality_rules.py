import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplake.llm import quality_rules as R


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, documents):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["ab", "c", "é", "#", "漢"]) + rng.choice([" ", " ", "\n", "\t", "\x0b "]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\r"), (503, "\x1c a\x85b c"), (None, "a b c d e a b c d e"), (504, "x " * 3000), (505, "l\nl\n\nl")]
    got = {r["doc_id"]: tuple(r)[3:] for r in R.base_statistics(documents(rows)).collect()}
    assert got == {d: plain(t) for d, t in rows}


def estimate(x):
    """The same estimate in NumPy: location and covariance of the least determinant that C-steps find from the three starts."""
    floor = np.diag(np.array(list(R.FLOOR.values())) ** 2)
    up = lambda v, share, bins: np.array([(np.floor(np.sort(c)[int(np.ceil(share * len(c))) - 1] * bins) + 1) / bins for c in v.T])
    distance = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    middle = up(x, 0.5, R.BINS)
    starts = [(middle, np.diag(np.maximum(1.4826 * up(np.abs(x - middle), 0.5, R.BINS), np.sqrt(np.diag(floor))) ** 2))]
    for w in (np.ones(len(x)), 1 / (distance(*starts[0]) + 1e-6)):
        mean = (w[:, None] * x).sum(axis=0) / w.sum()
        starts.append((mean, (w[:, None] * (x - mean)).T @ (x - mean) / w.sum() + floor))
    found = []
    for k, (mean, cov) in enumerate(starts):
        best = None
        while True:
            v = np.log(distance(mean, cov) + 1e-9)
            inner = x[v < up(v[:, None], R.SHARE, R.FINE)[0]]
            mean, cov = inner.mean(axis=0), R.CONSISTENT * np.cov(inner.T, bias=True) + floor
            det = np.linalg.slogdet(cov)[1]
            if best is not None and det >= best[0] - R.CLOSE:
                break
            best = (det, k, mean, cov)
        found.append(best)
    return min(found, key=lambda b: b[:2])[2:]


def test_the_determinant_is_the_least_of_all_choices(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for g in "abc":
        x = rng.normal(0, [0.5, 0.2, 0.3, 0.6, 0.4], (14, 5))
        x[:3] += rng.normal(0, 6, (3, 5))
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "g string, x1 double, x2 double, x3 double, x4 double, x5 double")
    floor = np.diag(np.array(list(R.FLOOR.values())) ** 2)
    for r in R._estimates(rows).collect():
        got = 2 * sum(np.log(r[f"l_{i}_{i}"]) for i in range(5))
        want = min(np.linalg.slogdet(R.CONSISTENT * np.cov(groups[r["g"]][list(pick)].T, bias=True) + floor)[1] for pick in itertools.combinations(range(14), 11))
        assert got == pytest.approx(want, abs=1e-6)


def test_outliers_equal_numpy(spark, documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(40, 200))), "en", "s" if i % 4 else None) for i in range(240)]
    rows += [(300, " ".join(word() + "###" for _ in range(60)), "en", "s"), (301, " ".join(word() for _ in range(60)), "de", "s"), (302, "a b", "en", "s"), (303, None, None, None)]
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("g", "pool", "judge", "d2", "x1", "m0", "n", "start", "words")})
    out = {r["doc_id"]: r for r in R.quality_rules(df).collect()}
    assert len(out) == len(rows) and R.quality_rules(documents([rows[0], rows[0]])).count() == 2

    def vector(r):
        n = max(r["n_words"], 1)
        return [np.log1p(r["n_words"]), np.log((r["word_chars"] + 50) / (r["n_words"] + 10)), np.sqrt(r["n_symbols"] / n), np.log1p(r["n_dup_lines"]), np.sqrt(r["n_repeat_words"] / n)]

    for source in ("s", None):
        ids = [d for d, _, lang, s in rows if lang == "en" and s == source and not out[d]["base_failed"]]
        x = np.array([vector(out[d]) for d in ids])
        mean, cov = estimate(x)
        want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        assert [out[d]["distance"] for d in ids] == pytest.approx(want.tolist(), rel=1e-6)
    assert not out[300]["kept"] and out[300]["base_failed"] is False
    assert out[301]["kept"] and out[301]["distance"] is None and out[301]["pooled_distance"] is not None
    assert out[302]["base_failed"] and not out[303]["kept"]
    assert sum(out[i]["kept"] for i in range(240)) >= 238
    assert R.quality_rules(documents([])).count() == 0


def test_small_groups_are_judged_by_a_pool(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda end="": " ".join(word() + end for _ in range(rng.randint(40, 200)))
    rows = [(i, text(), "en", f"s{i // 5}") for i in range(100)] + [(200 + i, text(), "de", f"s{i}") for i in range(4)]
    rows += [(300, text("####"), "en", "s3"), (301, text("####"), "de", "s1"), (302, text("####"), None, None)]
    out = {r["doc_id"]: r for r in R.quality_rules(documents(rows)).collect()}
    assert len(out) == len(rows)
    assert all(r["distance"] is None and r["pooled_distance"] is not None for r in out.values())
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in (300, 301, 302))
    assert sum(out[i]["kept"] for i in range(100)) >= 98 and all(out[200 + i]["kept"] for i in range(4))


def test_chi_square():
    assert R.chi_square_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert R.chi_square_quantile(0.99, 5) == pytest.approx(15.0863, abs=1e-3)


def test_no_python_in_the_plan(spark, documents):
    plan = R.quality_rules(documents([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
