"""Media columns, archives and segmentations: round trips and brute force."""

import base64
import hashlib
import io
import itertools
import random
import uuid
import wave
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from snaplake.llm import media as A
from snaplake.llm import sentencepiece_nbest as P
from snaplake.llm import warc as W

ODD = ["", "a", " a", "a  b\n\n c▁d ▁ ▁x\n▁y", "漢字\x00\tz\n", "é" * 700, "ÿ" * 288, "x" * 576, "the and of"]


def test_media_round_trip(spark, documents):
    rows = [*enumerate(ODD), (50, None), (51, "a"), (None, "a")]
    out = A.media_columns(documents(rows).withColumn("feature", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        media = A.to_wav(payload)
        assert A.from_wav(media) == payload and len(payload) % 576 == 0 and payload
        want[d] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    for r in out:
        assert tuple(r)[1:7] == want[r["doc_id"]] and len(r["pair_times"]) == len(r["pair_codes"])
    by = {r["doc_id"]: r["feature"] for r in out}
    assert by[1] == by[51] == by[None] and by[0] == by[50]


def test_fingerprint_of_a_tone():
    t = np.arange(576 * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / 576) + 40 * np.sin(2 * np.pi * 200 * t / 576)).astype(np.uint8)
    times, codes = A.fingerprint(tone)
    assert len(times) and set(codes // 32 // 512) | set(codes // 32 % 512) == {40, 200}
    assert (np.diff(times) >= 0).all()


def plain_fingerprint(samples):
    """Time codes and pair codes by the definition, bin by bin."""
    frames = [samples[k : k + 576].astype(float) - 128 for k in range(0, len(samples), 576)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
    spectra = [np.abs(turn @ (f * np.hanning(576))) for f in frames]
    tops = [[max(range(1 + 48 * b, 49 + 48 * b), key=lambda k, s=s: (s[k], -k)) for b in range(6)] for s in spectra]
    power = [[s[k] for k in t] for s, t in zip(spectra, tops, strict=True)]
    peaks = []
    for t in range(len(frames)):
        strongest = sorted(range(6), key=lambda b: (-power[t][b], b))[:2]
        for b in range(6):
            beside = [power[u][b] if 0 <= u < len(frames) else 0 for u in (t - 1, t + 1)]
            if b in strongest and power[t][b] > 0 and power[t][b] >= max(beside):
                peaks.append((t, tops[t][b]))
    pairs = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 3]:
            if u - t <= 15:
                pairs.append((t, (f * 512 + g) * 32 + u - t))
    return pairs


def test_fingerprint_equals_its_definition():
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 40):
        samples = rng.integers(0, 256, 576 * n).astype(np.uint8)
        times, codes = A.fingerprint(samples)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(samples)


def test_stored_media_are_wav_files(spark, documents):
    rows = [(1, "sound of a text"), (2, None), (None, "é" * 10**6)]
    stored = A.media_table(documents(rows).withColumn("media", F.lit(1)))
    files = {r["doc_id"]: (r["n_bytes"], bytes(r["media"])) for r in stored.collect()}
    assert dict(stored.dtypes)["media"] == "binary" and {d: n for d, (n, _) in files.items()} == {1: 15, 2: 0, None: 2 * 10**6}
    with wave.open(io.BytesIO(files[1][1])) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 8000) and w.readframes(576) == rows[0][1].encode() + b"\xff" * 561
    assert {r["doc_id"] for r in A.media_features(stored).collect()} == {1, 2, None} and A.media_columns(documents([])).count() == 0


def test_archives(spark):
    pages = [(i, f"http://x/{i}", f"<p>{'same words in each page ' * 5}{i % 30}</p>") for i in range(60)]
    pages += [(100, None, None), (101, "http://x/\r\n", ""), (None, "u", pages[3][2]), (3, "again", pages[3][2]), (200, "é", "é\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = W.warc_round_trip(df).collect()
    assert len(out) == len(pages)
    first = {}
    for d, _, h in pages:
        if d is not None:
            first[h or ""] = min(first.get(h or "", d), d)
    seen = {}
    for r in out:
        seen.setdefault(r["page_id"], []).append(r)
    for d, _, h in pages:
        raw = (h or "").encode()
        for r in seen[d]:
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            if d == first[h or ""]:
                continue
            assert (r["record_type"], r["refers_to"]) == ("revisit", first[h or ""])
    assert sorted((r["record_type"], r["refers_to"]) for r in seen[3]) == [("response", None), ("revisit", 3)]
    assert W.warc_round_trip(df.limit(0)).count() == 0
    alone = W.warc_round_trip(df, least=10**6).collect()
    assert {r["record_type"] for r in alone} == {"response"}


def test_archive_layout():
    write = uuid.uuid4()
    records = [W.page_record(W.Page(i, i, f"u{i}", "text of a page " * 20 + str(i)), write, "2000-01-01T00:00:00Z") for i in range(100)]
    body = W.pack(records)
    assert body[:4] == b"\x5d\x2a\x4d\x18" and [r for _, r in W.unpack(body)] == records
    assert len(body) < sum(map(len, records)) / 4
    for few in (records[:1], records[:2], records[:1] * 50, [b"", b"x"]):  # an archive always has its dictionary
        packed = W.pack(few)
        assert packed[:4] == b"\x5d\x2a\x4d\x18" and [r for _, r in W.unpack(packed)] == few
    with pytest.raises(ValueError):
        W.parse(records[0][:-1])
    with pytest.raises(ValueError):
        list(W.unpack(zstandard.compress(body)))


def test_one_record_of_a_stored_archive_is_read_alone(spark):
    pages = [(i, f"http://x/{i}", f"<p>{'words ' * 9}{i % 7}</p>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("place", "digest", "response", "size")})
    manifest = W.write_archives(df, W.fresh_path(spark, "one-record"))
    rows = W.read_archives(manifest).collect()
    ids, refers = set(), {}
    for r in rows:
        with open(r["path"].removeprefix("file://"), "rb") as f:
            head = f.read(8)
            assert head[:4] == b"\x5d\x2a\x4d\x18"
            dictionary = zstandard.ZstdCompressionDict(f.read(int.from_bytes(head[4:], "little")))
            f.seek(r["offset"])
            raw = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(f.read())
        fields, block = W.parse(raw)
        ids.add(fields["WARC-Record-ID"])
        assert int(fields["Snaplake-Page-ID"]) == r["page_id"]
        if r["record_type"] == "revisit":
            refers[r["page_id"]] = (fields["WARC-Refers-To"], fields["WARC-Refers-To-Target-URI"])
            assert r["refers_to"] == r["page_id"] % 7 and fields["WARC-Refers-To-Target-URI"] == f"http://x/{r['page_id'] % 7}"
        else:
            assert block.endswith(pages[r["page_id"]][2].encode())
    assert len(ids) == 40 and len(refers) == 33 and {x for x, _ in refers.values()} <= ids


@pytest.fixture(scope="module")
def encoder():
    return P.NBest(4)


def test_search_equals_enumeration(encoder):
    def paths(into, j):
        if j == 0:
            yield 0.0, ()
        for _, i, s, ids in into[j] if j else ():
            for score, before in paths(into, i):
                yield score + s, before + ids

    rng = random.Random(1)
    for _ in range(300):
        unit = rng.choice(["", " "]) + "".join(rng.choice("abthe▁éñ漢\x00r") for _ in range(rng.randint(1, 7)))
        want = sorted((s for s, _ in paths(encoder.forward(unit)[0], len(unit))), reverse=True)[:4]
        got = encoder.search(unit)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s in want] and len({i for _, i in got}) == len(got)


def test_whole_texts_equal_enumeration_over_all_pieces(encoder):
    """N best of the uncut text, with every piece of the model, runs of spaces included."""

    def paths(text, i):
        if i == len(text):
            return [(0.0, ())]
        edges = [(encoder.pieces[text[i:j]][0], j) for j in range(i + 1, min(len(text), i + encoder.longest) + 1) if text[i:j] in encoder.pieces]
        if text[i] not in encoder.pieces:
            edges.append((-16.0 * len(text[i].encode()), i + 1))
        return sorted(((s + rest, (j - i, *sizes)) for s, j in edges for rest, sizes in known[j]), key=lambda x: -x[0])[:6]

    rng = random.Random(3)
    for k in range(120):
        text = " " + "".join(rng.choice(["a", "the", " ", "    ", "\n", ".", "7", "▁", "é", "².", "漢", "in"]) for _ in range(rng.randint(1, 9)))
        known = {}
        for i in range(len(text), -1, -1):
            known[i] = paths(text, i)
        ids, best = encoder.encode(text[1:])
        assert [round(s, 6) for s, _ in best] == [round(s, 6) for s, _ in known[0][:4]]
        for _, edits in best:
            assert encoder.decode(P.segmentation(ids.tolist(), edits)) == text[1:]
    assert len(encoder.encode(" " * 15)[0]) == 1


def test_long_units_equal_short_ones(encoder, monkeypatch):
    units = [" thequickbrownfoxjumps", " " * 40, " 漢a².b", "  abc" + "x" * 30]
    want = [encoder.search(u) for u in units]
    monkeypatch.setattr(P, "LONG_UNIT", 2)
    assert [encoder.search(u) for u in units] == want


def test_documents_n_best_equals_all_combinations(encoder):
    text = "the cat sat"
    lists = [encoder.search(u) for u in (" the", " cat", " sat")]
    want = sorted((sum(s for s, _ in pick) for pick in itertools.product(*lists)), reverse=True)[:4]
    ids, best = encoder.encode(text)
    assert [round(s, 6) for s, _ in best] == [round(s, 6) for s in want]
    for _, edits in best:
        assert encoder.decode(P.segmentation(ids.tolist(), edits)) == text


def test_encoding_is_lossless(spark, documents):
    rows = [*enumerate(ODD), (50, None), (51, "ab" * 500_000), (52, " " * 30_000 + "x"), (None, "a b")]
    out = P.encode(documents([*rows, rows[3]]).withColumns({c: F.lit(1) for c in ("ids", "nbest", "decoded_equal")}))
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["decoded_equal"] for d, r in got.items() if d != 50) and got[50]["ids"] is None
    assert {r["doc_id"]: r["text"] for r in P.decode(out).collect()} == dict(rows)
    assert P.digest(out).count() == len(rows) + 1 and P.encode(documents([])).count() == 0
