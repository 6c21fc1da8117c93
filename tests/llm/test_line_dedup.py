import random

from pyspark.sql import functions as F

from snaplake.llm import line_dedup as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    """One word apart if the longer line has eight words, else one character if the longer one has eight characters."""
    if max(len(a), len(b)) >= 8:
        return abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1
    x, y = " ".join(a), " ".join(b)
    return max(len(x), len(y)) >= 8 and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1


def brute(rows):
    """Kept texts by the definition: exact copies of earlier lines, and first copies one edit from an earlier first copy, are dropped."""
    docs = sorted({(d is None, d or 0, t) for d, t in rows}, key=lambda x: (x[0], x[1]))
    firsts, keep = [], {}
    for none, d, t in docs:
        kept = []
        for line in (t or "").split("\n"):
            words = D.words_of(line)
            if not words:
                kept.append(line)
                continue
            if words in firsts:
                continue
            dropped = any(near(f, words) for f in firsts)
            firsts.append(words)
            if not dropped:
                kept.append(line)
        keep[(None if none else d, t)] = "\n".join(kept)
    return keep


def test_equals_brute_force(spark, documents):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 7, 8, 8, 9, 12]))) for _ in range(25)]

    def change(line):
        words = line.split()
        at = rng.randrange(len(words))
        kind = rng.randrange(7)
        if kind > 4:  # a character is put in, changed, or taken out, white space too
            text, at = " ".join(words), rng.randrange(len(line))
            return text[:at] + rng.choice(["", "q", " "]) + text[at + rng.randrange(2) :]
        if kind == 0:
            words[at] = "changed" + str(rng.randrange(3))
        elif kind == 1:
            del words[at]
        elif kind == 2:
            words.insert(at, "added" + str(rng.randrange(3)))
        elif kind == 3:
            words[0] = words[0].upper()
        return "  ".join(words) if words else "x"

    rows = []
    for i in range(70):
        rows.append((i, "\n".join(rng.choice([str, change])(rng.choice(lines)) for _ in range(rng.randint(0, 6)))))
    rows += [(50, None), (51, ""), (52, "\n \n\t"), (None, lines[0] + "\nnew line of a null id here it is now")]
    df = documents(rows).withColumns({c: F.lit("clash") for c in ("line", "exact", "row", "th", "id", "text_hash", "done", "near", "_hash_", "_lines_")})
    out = D.line_dedup(df)
    assert out.columns == df.columns
    want = brute(rows)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {d: (t if t is None else want[(d, t)]) for d, t in rows}
    report = {r["doc_id"]: r for r in D.line_report(df).collect()}
    assert sum(r["n_near"] for r in report.values()) > 5 and sum(r["n_exact"] for r in report.values()) > 5


def test_repeated_rows_and_empty_table(spark, documents):
    row = (1, "one two three four five six seven eight nine\nsame same")
    out = D.line_dedup(documents([row, row, (2, row[1])]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, row[1]), (1, row[1]), (2, "")]
    assert D.line_dedup(documents([])).count() == 0


def test_edit_within_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert D.edit_within_one(a, b) == (distance(a, b) <= 1)


def test_lines_one_edit_apart_share_a_half_and_a_variant():
    rng = random.Random(4)
    for k in range(600):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(8, 13))]
        b = list(a)
        at = rng.randrange(len(b))
        kind = rng.randrange(3)
        if kind == 0:
            b[at] = "z"
        elif kind == 1:
            b.insert(at, "z")
        else:
            del b[at]
        if k % 2:
            a, b = "".join(a), "".join(b)
        shared = {h for h, _, _ in D.halves(a)} & {h for h, _, _ in D.halves(b)}
        assert shared
        sets = []
        for w in (a, b):
            v, p = D.variants(w, [(x, y) for h, x, y in D.halves(w) if h in shared])
            sets.append((set(zip(v.tolist(), p.tolist(), strict=True)), set(v.tolist()), int(v[0])))
        same_place = {x for x in sets[0][0] & sets[1][0] if x[1] >= 0}
        assert same_place or sets[0][2] in sets[1][1] or sets[1][2] in sets[0][1]


def test_parameters_and_very_long_lines(spark, documents):
    long = " ".join(f"w{i}" for i in range(160_000))
    rows = [(1, "1.\n2.\n3.\nyes\nyet\nChapter 1\nchapter 2"), (2, long), (3, long + " more"), (4, "x" * 10**6), (5, "x" * 10**6 + "y")]
    got = {r["doc_id"]: r["text"] for r in D.line_dedup(documents(rows)).collect()}
    assert got == {1: "1.\n2.\n3.\nyes\nyet\nChapter 1", 2: long, 3: "", 4: "x" * 10**6, 5: ""}
    exact = {r["doc_id"]: r["text"] for r in D.line_dedup(documents(rows[:1]), near_words=100, near_chars=100).collect()}
    assert exact == {1: rows[0][1]}
