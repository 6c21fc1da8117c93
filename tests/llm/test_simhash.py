import itertools
import random

import numpy as np
import xxhash

from snaplake.llm import simhash as S
from snaplake.llm.components import components, local_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    prints = [plain(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            at[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted(((d, f"{prints[i]:016x}", min((x for x in least[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_whole_table_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        rows.append((i * 4, " ".join(base)))
        for k in range(3):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            rows.append((i * 4 + k + 1, ("\n" if k else "  ").join(other)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (5, rows[5][1]), (None, rows[9][1]), (903, "Éa b C"), (904, "x")]
    df = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in S.simhash(df).collect()), key=str)
    assert got == brute(rows)
    kept = S.simhash_dedup(df)
    assert kept.columns == df.columns
    components_ = {r[2] for r in brute(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(components_)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.simhash(df).count() == 0
    assert S.simhash_dedup(df).count() == 0


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 32, (150, 2))} | set(map(int, rng.integers(0, 1 << 62, 50))))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    for hot in (3, 10**6):
        edges = [tuple(r) for r in S.links(df, hot=hot).collect()]
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        nodes, roots = local_roots(a, b)
        wa, wb = np.array([e[0] for e in want]), np.array([e[1] for e in want])
        wn, wr = local_roots(wa, wb)
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == dict(zip(wn.tolist(), wr.tolist(), strict=True))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
