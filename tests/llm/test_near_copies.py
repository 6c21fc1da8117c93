import itertools
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from snaplake.llm import near_copies as N


def sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    at, found = list(range(len(rows))), [sets(t) for _, t in rows]

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(found[i] & found[j]) >= 8 * len(found[i] | found[j]):
            at[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted(min(x) for x in least.values())


def test_stage_equals_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 500)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(20, 260))] + (passage if i % 2 else [])
        rows.append((len(rows), " ".join(base)))
        for _ in range(8 if i < 3 else 4):
            other = list(base)  # near copies at about 0.7 to 0.97, also of one another's copies
            for _ in range(rng.randint(1, 1 + len(base) // 45)):
                other[rng.randrange(len(other))] = f"changed{rng.randrange(10**6)}"
            base = other if rng.random() < 0.5 else base
            rows.append((len(rows), "  ".join(other).title()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "x"), (904, "X "), (905, "a b c d"), (906, "a b c d e"), (907, rows[7][1])]
    want = brute(rows)
    pairs = [(a, b) for (_, a), (_, b) in itertools.combinations(rows, 2) if 0.8 <= len(sets(a) & sets(b)) / len(sets(a) | sets(b)) < 0.95]
    assert len(pairs) > 50 and len(want) < len(rows) - 50
    df = documents(rows)
    kept = P.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_second_round_finds_what_the_first_leaves_out(spark, documents):
    # all share common passages, so they meet in one group; only pairs far from each other in its order are alike
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    shared = [rng.choice(words) for _ in range(70)]
    rows = []
    for k in range(12):
        own = [f"own{k % 6}x{j}" for j in range(40)]
        rows.append((k, " ".join(shared + own + [f"end{k}"] * (1 + k // 6))))
    assert len(brute(rows)) == 6
    assert sorted(r["doc_id"] for r in N.near_copy_dedup(documents(rows)).collect()) == brute(rows)


def test_empty_table(spark, documents):
    assert N.near_copy_dedup(documents([])).count() == 0


def flipped(base, bits):
    for b in bits:
        base ^= 1 << int(b)
    return base


def test_tries_below_the_keys_and_the_rest_give_every_pair(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(N, "TRIE_ROWS", 40)
    bases = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    rows = []
    for i in range(200):  # 0 to 16 bits from a base, so also equal fingerprints, and pairs beyond the budget
        fp = flipped(bases[i % 5] | (i % 2) << 63, rng.integers(0, 64, rng.integers(0, 17)))
        rows.append((int(rng.integers(-4, 4)), i, int(rng.integers(80, 101)), fp - (fp >> 63 << 64), int(rng.integers(0, 4))))
    rows.sort(key=lambda r: (r[0], r[3], r[1]))
    h, s, n, fp, root = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    pairs = lambda found: sorted(tuple(sorted((int(s[a]), int(s[b])))) for i, j in found for a, b in zip(i, j, strict=True))
    turned = fp.view(np.uint64) ^ np.uint64(1 << 63)
    trie, rest = pairs(N._joined(h, turned, root)), pairs(N._rest(h, n, turned, root))
    want = [(a, b, (a[3] ^ b[3]) & (1 << 64) - 1) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[4] != b[4]]
    inside = lambda x: 1 <= x.bit_count() <= N.BITS
    fits = lambda a, b: 4 * max(a[2], b[2]) <= 5 * min(a[2], b[2])
    assert trie == sorted(tuple(sorted((a[1], b[1]))) for a, b, x in want if inside(x)) and len(trie) > 100
    assert rest == sorted(tuple(sorted((a[1], b[1]))) for a, b, x in want if not inside(x) and fits(a, b)) and len(rest) > 100
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (h, s, n, np.zeros(200, np.int64), fp, root)], ["h", "set", "n", "at", "fp", "root"])
    found = [tuple(r.values()) for b in N._second_round(iter([batch.slice(0, 90), batch.slice(90)])) for r in b.to_pylist()]
    assert sorted(found) == sorted(tuple(sorted((a[1], b[1]))) for a, b, x in want if (inside(x) or fits(a, b)) and 9 * min(a[2], b[2]) >= 4 * (a[2] + b[2]))


def test_parities_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(1, 700)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(1, 300))]))
        apart = len(np.setxor1d(a, b))
        assert N.unlike(N.parities(a), N.parities(b)) <= apart and N.unlike(N.parities(a), N.parities(a)) == 0


def test_unlike_sets_that_meet_are_not_read_again(spark, documents, monkeypatch):
    # each two share a passage, so they meet, but only the last are alike
    rng = random.Random(8)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(30):
        passage = made(25)
        rows += [(2 * k, " ".join(made(35) + passage)), (2 * k + 1, " ".join(passage + made(35)))]
    rows.append((60, rows[59][1] + " more"))
    written, write = {}, N.materialize

    def spy(df, name):
        out = write(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "materialize", spy)
    monkeypatch.setattr(N, "SAMPLE_DOCS", 0)  # else the passages are known to be common, and none meet
    assert sorted(r["doc_id"] for r in N.near_copy_dedup(documents(rows)).collect()) == brute(rows) == list(range(60))
    assert written["candidates"] > 20 and written["shingles"] <= 4
