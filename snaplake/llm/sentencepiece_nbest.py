"""SentencePiece encoding with N-best segmentations, and decoding.

One space is put before a text, as SentencePiece does; then the text is cut into units: runs of letters and runs of other
characters, each with the spaces before it, spaces at the end of a line, and line feeds.  Where a piece of the model goes from one unit to the next,
units are put together again, so no piece spans two of them and nothing is lost by the cuts.  Within a unit, all pieces of a fixed public vocabulary
form a lattice; a character that no piece covers is spelled in byte pieces, and so is a literal space mark, so decoding gives back every
text exactly.  A piece's score is the log of a Zipf probability of its merge rank in the model file.

N-best: a forward Viterbi pass gives each node the best score from the start; these are exact heuristics for an A* search backward from
the end, so segmentations leave the queue in the order of their scores (ties: found first).  As no piece spans units, a document's
N-best list combines its units' lists: only the N-1 units whose second choice costs least can differ from their best.

Nulls and edge cases: a null text has no ids (null) and is skipped by decoding; an empty text has no ids (empty list).  Repeated rows have equal
results.  Units are computed once per Python worker while a cache of bounded size holds them; a long unit costs time in proportion to its
length, and of its lattice only one number for each node is held.  An empty table gives an empty one.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, bounded_batches, held, text_chunks
from .vocabulary import MODEL, SPACE, TOKENIZERS

BYTE_SCORE, RANK_SHIFT = -16.0, 10.0
#: Units of more characters keep no edges of their lattice.
LONG_UNIT = 1024

_UNITS = re.compile(r" *[^\W\d_]+| *(?:[^\w \n]|[\d_])+|\n| +")


class NBest:
    """Encoder and decoder over one model file; n segmentations for each unit.  A unit's space mark is held as a plain space."""

    def __init__(self, n: int = 4, path: str | None = None, cache_bytes: int = 128 << 20):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path or f"{TOKENIZERS}/{MODEL}")
        size = model.get_piece_size()
        self.n = n
        self.raw: list[bytes] = [b""] * size
        self.byte: list[int] = [0] * 256
        #: Piece -> (score, ids); and the same as nested dicts by character, with the pair under "".
        self.pieces: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.trie: dict = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                piece = piece.replace(SPACE, " ")
                self.raw[i] = piece.encode()
                self.pieces[piece] = (-math.log(RANK_SHIFT - model.get_score(i)), (i,))
                node = self.trie
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[""] = self.pieces[piece]
        self.longest = max(map(len, self.pieces))
        #: Neighbouring characters where _UNITS cuts and a piece goes on.
        self.crossing = sorted({a[-1] + b[0] for p in self.pieces for a, b in itertools.pairwise(_UNITS.findall(p))})
        # a unit's score and what its second choice costs, as two doubles, and its ids, as int32, in one run of bytes
        self.units = Generations(self._unit, lambda unit, made: 200 + 2 * len(unit) + len(made), cache_bytes)
        #: Ranks that the n best combinations of n-1 lists can have: one that has more than n combinations at or before it isn't among them.
        self.ranks = [r for r in itertools.product(range(n), repeat=n - 1) if math.prod(x + 1 for x in r) <= n]

    def split(self, text: str) -> list[str]:
        """The units of a text, with its leading space."""
        units = _UNITS.findall(" " + text)
        if any(x in text for x in self.crossing):
            joined = units[:1]
            for u in units[1:]:
                if joined[-1][-1] + u[0] in self.crossing:
                    joined[-1] += u
                else:
                    joined.append(u)
            return joined
        return units

    def _spelled(self, ch: str) -> tuple[float, tuple[int, ...]]:
        ids = tuple([self.byte[b] for b in ch.encode("utf-8", "surrogatepass")])
        return BYTE_SCORE * len(ids), ids

    def forward(self, unit: str) -> tuple[list[list[tuple]], float]:
        """Edges that end at each node, as (best score through it, from, score, ids), and the best score of the last node."""
        n, root = len(unit), self.trie
        into: list[list[tuple]] = [[] for _ in range(n + 1)]
        base = 0.0
        for i in range(n):
            if i:
                base = max(into[i])[0]
            node = root.get(unit[i])
            if node is None or "" not in node:
                s, ids = self._spelled(unit[i])
                into[i + 1].append((base + s, i, s, ids))
            j = i
            while node is not None:
                j += 1
                if "" in node:
                    hit = node[""]
                    into[j].append((base + hit[0], i, hit[0], hit[1]))
                if j == n:
                    break
                node = node.get(unit[j])
        return into, max(into[n])[0]

    def forward_long(self, unit: str) -> tuple[Callable[[int], list[tuple]], float]:
        """As forward, but holding the best score of each node alone; edges are made when they are asked for, best first."""
        best = array("d", [0.0])

        def edges(j: int) -> list[tuple]:
            out = []
            for i in range(max(0, j - self.longest), j):
                if (hit := self.pieces.get(unit[i:j])) is not None:
                    out.append((best[i] + hit[0], i, *hit))
            if unit[j - 1] not in self.pieces:
                s, ids = self._spelled(unit[j - 1])
                out.append((best[j - 1] + s, j - 1, s, ids))
            out.sort(reverse=True)
            return out

        for j in range(1, len(unit) + 1):
            best.append(edges(j)[0][0])
        return edges, best[-1]

    def search(self, unit: str, most: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The `most` (n) best segmentations of a unit, best first, as (score, ids).

        An entry of the queue is an edge into a node with what comes after it; its cost is exact, as the forward pass has the
        best score of all before.  Edges of a node are taken in their order, so an entry queues only its next sibling, and no more
        entries than there are segmentations left to find need be kept.
        """
        most = most or self.n
        if len(unit) > LONG_UNIT:
            edges_into, best = self.forward_long(unit)
        else:
            into, best = self.forward(unit)
            ordered = set()

            def edges_into(j: int) -> list[tuple]:
                if j not in ordered:
                    ordered.add(j)
                    into[j].sort(reverse=True)
                return into[j]

        found: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple] = [(-best, 0, len(unit), 0, 0.0, None)]
        made = 0
        while queue and len(found) < most:
            cost, _, j, r, after, path = heapq.heappop(queue)
            while j:
                edges = edges_into(j)
                if r + 1 < len(edges):
                    made += 1
                    heapq.heappush(queue, (-(edges[r + 1][0] + after), made, j, r + 1, after, path))
                    if len(queue) > 1024 + 4 * most:
                        queue = heapq.nsmallest(most, queue)
                _, j, s, ids = edges[r]
                after += s
                path = (ids, path)
                r = 0
            ids_: list[int] = []
            while path is not None:
                ids_ += path[0]
                path = path[1]
            found.append((-cost, tuple(ids_)))
        return found

    def _unit(self, unit: str) -> bytes:
        two = self.search(unit, 2 if self.n > 1 else 1)
        ids = two[0][1]
        return struct.pack(f"=dd{len(ids)}i", two[0][0], two[0][0] - two[1][0] if len(two) > 1 else math.inf, *ids)

    def encode(self, text: str) -> tuple[np.ndarray, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Ids of the best segmentation, and the n best ones as (score, [(place in the best ids, ids dropped there, ids put there)])."""
        if not text:
            return np.zeros(0, np.int32), []
        units = self.split(text)
        packed = list(map(self.units.__getitem__, units))
        words = np.frombuffer(b"".join(packed), np.int32)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        head = (np.cumsum(size) - size)[:, None] + np.arange(4)
        scores, gap = words[head].view(np.float64).T
        is_id = np.ones(len(words), bool)
        is_id[head] = False
        ids, total = words[is_id], math.fsum(scores.tolist())
        most = self.n - 1
        near = np.flatnonzero(gap <= (np.partition(gap, most - 1)[most - 1] if 0 < most < len(gap) else np.inf)) if most else np.zeros(0, np.int64)
        places = sorted(sorted((k for k in near.tolist() if gap[k] < math.inf), key=gap.__getitem__)[:most])
        if not places:
            return ids, [(total, [])]
        ends = np.cumsum(size[: places[-1] + 1] - 4)
        choices = [self.search(units[k]) for k in places]
        ranks = [r[: len(places)] for r in self.ranks if not any(r[len(places) :])]
        combined = sorted((math.fsum(c[0][0] - c[x][0] for c, x in zip(choices, r, strict=True)), r) for r in ranks if all(x < len(c) for c, x in zip(choices, r, strict=True)))
        out = []
        for cost, r in combined[: self.n]:
            out.append((total - cost, [(int(ends[k] - size[k]) + 4, int(size[k]) - 4, c[x][1]) for k, c, x in zip(places, choices, r, strict=True) if x]))
        return ids, out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def segmentation(ids: list[int], edits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The ids of one of the n best segmentations, from the best one's ids and the edits that lead to it."""
    out, at = [], 0
    for start, drop, put in edits:
        out += ids[at:start]
        out += put
        at = start + drop
    return out + list(ids[at:])


_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))]))
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", _EDITS)]))
ENCODED = "ids array<int>, nbest array<struct<score double, edits array<struct<at int, drop int, put array<int>>>>>, decoded_equal boolean"


def encode(docs: DataFrame, n: int = 4, tokenizer: str | None = None) -> DataFrame:
    """doc_id with ids (best segmentation), nbest (scores of the n best, each with its edits of ids) and decoded_equal: every one of them decodes to the text."""
    bounded_batches(docs.sparkSession)
    key = f"{tokenizer}-{n}-{uuid.uuid4().hex}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held("pieces", key, lambda: NBest(n, tokenizer))
        for rows, texts in text_chunks(batches):
            ids, best, equal = [], [], []
            for t in texts:
                if t is None:
                    ids.append(None), best.append(None), equal.append(None)
                    continue
                found, options = mine.encode(t)
                ids.append(found)
                best.append([{"score": s, "edits": [{"at": a, "drop": d, "put": list(p)} for a, d, p in edits]} for s, edits in options])
                plain = found.tolist()
                same = mine.decode(plain) == t
                for _, edits in options[1:]:
                    same &= all(b"".join(map(mine.raw.__getitem__, put)) == b"".join(map(mine.raw.__getitem__, plain[a : a + d])) for a, d, put in edits)
                equal.append(same)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(best, _NBEST), pa.array(equal, pa.bool_())], ["doc_id", "ids", "nbest", "decoded_equal"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, {ENCODED}")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""
    bounded_batches(encoded.sparkSession)
    key = f"{tokenizer}-decode-{uuid.uuid4().hex}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held("pieces", key, lambda: NBest(1, tokenizer))
        for rows in batches:
            texts = [None if x is None else mine.decode(x) for x in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """Per document: number of ids, their SHA-1 (as comma-separated decimals), the n best scores, and whether decoding gives the text back."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha1(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha1"),
        F.transform("nbest", lambda x: F.round(x["score"], 6)).alias("nbest_scores"),
        "decoded_equal",
    )
