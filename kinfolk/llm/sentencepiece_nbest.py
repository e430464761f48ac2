"""SentencePiece encoding and decoding with N-best segmentations.

The lattice of a text has an edge for every vocabulary piece at every place, and byte pieces for characters that no piece
holds. Forward Viterbi gives the best score of every prefix; these are exact heuristics for an A* search backwards from
the end, which so yields segmentations in order of score.

Pieces never cross from a non-space to a space mark, and a character that is in no longer piece stands alone; so a text
falls apart into units whose lattices are independent. Forward and backward Viterbi run over all new units of a batch at
once and give each unit's best segmentation and its loss to the second best. The N best segmentations of a text can only
differ from the best in the N - 1 units of least loss, so A* searches the lattice of those.

The vocabulary is a SentencePiece model file, read on the driver and sent to tasks; it is never trained. A model of byte
pair merges has merge ranks in place of log probabilities, so by default a piece of rank r has the log probability of
Zipf's law, -ln((r + 1) H), in whole thousandths: sums are exact and the same on every machine. scores="model" takes the
stored scores instead.

Defined results: a null or empty text has no pieces and one segmentation of score 0; a U+2581 in a text goes by its bytes,
so that decoding gives back every text; among segmentations of equal score units that come first in the text change first
and longer pieces win; repeated rows are encoded alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.words import give_back
from kinfolk.llm.words import pieces as batch_pieces

N_BEST = 4
#: Units, and units with their edges, that a task remembers at most before it starts over; these bound memory only.
REMEMBER = 300_000
REMEMBER_EDGES = 4_000
PIECE = 1 << 20
MARK = "▁"
#: Stands for a U+2581 of the text itself; it is in no valid text.
OWN_MARK = "\ud800"
NEVER = -(1 << 60)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str, scores: str = "zipf") -> dict:
    """The pieces of a model file: by piece its id and score, the byte pieces' ids and score, and the bytes of each id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    harmonic = sum(1 / (k + 1) for k in range(len(normal)))
    zipf = lambda r: -round(1000 * (math.log(r + 1) + math.log(harmonic)))
    pieces, score_of = {}, {}
    for r, i in enumerate(normal):
        pieces[sp.id_to_piece(i)] = i
        score_of[i] = zipf(r) if scores == "zipf" else round(sp.get_score(i))
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    worst = zipf(len(normal)) if scores == "zipf" else min(s for s in score_of.values() if s > -(10**8)) - 1
    out = [b""] * n
    for p, i in pieces.items():
        out[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    return {"pieces": pieces, "scores": score_of, "byte_ids": byte_ids, "byte_score": worst, "bytes": out}


class _Units(dict):
    """Numbers of units; a unit not seen before gets the next number and waits to be solved."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.waiting.append(unit)
        return n


class Lattice:
    """Best segmentations of units, many at a time, over a vocabulary."""

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.pieces, self.score_of = vocab["pieces"], vocab["scores"]
        self.longest = max(map(len, self.pieces), default=1)
        inner = {c for p in self.pieces if len(p) > 1 for c in p if c != MARK}
        shared = "".join(re.escape(c) for c in sorted(inner))
        self.unit = re.compile(rf"{MARK}*[{shared}]+|{MARK}+|.", re.S) if inner else re.compile(".", re.S)
        self._table()
        self.forget()

    def _table(self) -> None:
        """Pieces by a rolling hash of their code points, in cells of as many ways as they need."""
        ids = np.array(list(self.pieces.values()), np.int32)
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces collide")
        self.shift = np.uint64(46)
        cells = (keys * _MULTIPLIER) >> self.shift
        order = np.argsort(cells, kind="stable")
        way = np.arange(len(keys)) - np.searchsorted(cells[order], cells[order])
        shape = (int(way.max(initial=0)) + 1, 1 << 18)
        self.keys, self.ids = np.zeros(shape, np.uint64), np.full(shape, -1, np.int32)
        self.keys[way, cells[order]], self.ids[way, cells[order]] = keys[order], ids[order]
        self.score = np.full(max(self.score_of, default=0) + 2, NEVER, np.int64)  # the last is for "no piece"
        for i, s in self.score_of.items():
            self.score[i] = s

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def forget(self) -> None:
        self.known = _Units()
        self.edges_of: dict[str, tuple] = {}
        self.best = self.loss = self.starts = self.sizes = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece id of each hash (-1: none); most cells are empty, and only the others compare keys."""
        flat = h.ravel()
        cell = (flat * _MULTIPLIER) >> self.shift
        out = self.ids[0][cell]
        full = np.flatnonzero(out >= 0)
        at, wanted = cell[full], flat[full]
        found = np.where(self.keys[0][at] == wanted, out[full], -1)
        for keys, ids in zip(self.keys[1:], self.ids[1:], strict=True):
            found = np.where((found < 0) & (keys[at] == wanted), ids[at], found)
        out[full] = found
        return out.reshape(h.shape)

    def bytes_of(self, c: str) -> bytes:
        return MARK.encode() if c == OWN_MARK else c.encode("utf-8", "surrogatepass")

    def edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece id of every substring (-1: none) of units with equally many characters."""
        out, h = [], np.zeros(chars.shape, np.uint64)
        for length in range(1, min(self.longest, chars.shape[1]) + 1):
            h = h[:, : chars.shape[1] - length + 1] * np.uint64(0x100000001B3) + chars[:, length - 1 :] + np.uint64(1)
            out.append(self.lookup(h))
        return out

    def _solve(self, units: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss to the second best, flat ids and numbers of ids of units of m characters."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, m).astype(np.uint64)
        w = len(units)
        ids = self.edges(chars)
        scores = [self.score[x] for x in ids]
        unknown = ids[0] < 0
        if unknown.any():  # byte pieces
            lengths = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            scores[0] = np.where(unknown, lengths * self.vocab["byte_score"], scores[0])
        f = np.full((m + 1, w), NEVER, np.int64)
        back = np.zeros((m + 1, w), np.int16)
        f[0] = 0
        for j in range(1, m + 1):
            for length in range(min(j, len(ids)), 0, -1):
                s = f[j - length] + scores[length - 1][:, j - length]
                back[j][s > f[j]] = length
                np.maximum(f[j], s, out=f[j])
        b = np.full((m + 1, w), NEVER, np.int64)
        b[m] = 0
        for i in range(m - 1, -1, -1):
            for length in range(1, min(m - i, len(ids)) + 1):
                np.maximum(b[i], scores[length - 1][:, i] + b[i + length], out=b[i])
        on_best = np.zeros((m + 1, w), np.int16)
        chosen = np.full((m, w), -1, np.int32)
        at = np.full(w, m)
        rows = np.arange(w)
        while len(rows):
            length = back[at[rows], rows]
            start = at[rows] - length
            on_best[at[rows], rows] = length
            for k in np.unique(length):
                here = length == k
                chosen[start[here], rows[here]] = ids[k - 1][rows[here], start[here]]
            at[rows] = start
            rows = rows[start > 0]
        second = np.full(w, NEVER, np.int64)
        for length in range(1, len(ids) + 1):
            for j in range(length, m + 1):
                via = f[j - length] + scores[length - 1][:, j - length] + b[j]
                np.maximum(second, np.where(on_best[j] == length, NEVER, via), out=second)
        loss = np.where(second > NEVER // 2, f[m] - second, -NEVER)
        # ids in order; an unknown character on the path becomes its bytes
        taken = np.zeros((m + 1, w), bool)
        taken |= on_best > 0
        starts = np.zeros((m, w), bool)
        js, ws = np.nonzero(taken)
        starts[js - on_best[js, ws], ws] = True
        ws, i = np.nonzero(starts.T)
        flat = chosen[i, ws]
        sizes = np.bincount(ws, minlength=w)
        gaps = np.flatnonzero(flat < 0)
        if len(gaps):
            coded = [[self.vocab["byte_ids"][x] for x in self.bytes_of(units[ws[g]][i[g]])] for g in gaps]
            times = np.ones(len(flat), np.int64)
            times[gaps] = [len(x) for x in coded]
            sizes = np.bincount(ws, weights=times, minlength=w).astype(np.int64)
            spread = np.repeat(flat, times)
            spread[spread < 0] = [x for c in coded for x in c]
            flat = spread
        return f[m], loss, flat, sizes

    def solve_waiting(self) -> None:
        """Solve the units that wait, all of one length at a time."""
        new, base = self.known.waiting, len(self.known) - len(self.known.waiting)
        if not new:
            return
        order = sorted(range(len(new)), key=lambda k: len(new[k]))
        best, loss, starts, sizes = (np.empty(len(new), np.int64) for _ in range(4))
        flats, filled, at = [self.flat], len(self.flat), 0
        while at < len(order):
            m = len(new[order[at]])
            to, most = at, max(1, (1 << 20) // (m * 16))
            while to < len(order) and len(new[order[to]]) == m and to - at < most:
                to += 1
            group = order[at:to]
            best[group], loss[group], flat, size = self._solve([new[k] for k in group], m)
            starts[group], sizes[group] = filled + np.cumsum(size) - size, size
            flats.append(flat.astype(np.int32))
            filled += len(flat)
            at = to
        self.best, self.loss = np.concatenate((self.best[:base], best)), np.concatenate((self.loss[:base], loss))
        self.starts, self.sizes = np.concatenate((self.starts[:base], starts)), np.concatenate((self.sizes[:base], sizes))
        self.flat = np.concatenate(flats)
        self.known.waiting = []

    def unit_edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """Edges into each position of a unit: start, ids, score; longer pieces first."""
        out: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(len(unit) + 1)]
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.pieces.get(unit[i:j])
                if k is not None:
                    out[j].append((i, (k,), self.score_of[k]))
                elif j - i == 1:
                    coded = tuple(self.vocab["byte_ids"][x] for x in self.bytes_of(unit[i]))
                    out[j].append((i, coded, len(coded) * self.vocab["byte_score"]))
        return out

    def forward(self, unit: str) -> tuple[list, list[int]]:
        """Edges and forward Viterbi scores of a unit."""
        if unit not in self.edges_of:
            if len(self.edges_of) >= REMEMBER_EDGES:
                self.edges_of.clear()
            edges = self.unit_edges(unit)
            f = [0]
            for into in edges[1:]:
                f.append(max(f[i] + s for i, _, s in into))
            self.edges_of[unit] = edges, f
        return self.edges_of[unit]

    def n_best(self, units: list[str], n: int) -> list[tuple[int, list[tuple[int, ...]]]]:
        """The n best segmentations of a row of units, best first: score and the ids of each unit.

        Forward Viterbi over the row, then A* backwards from its end with the forward scores as heuristics.
        """
        edges, scores = zip(*map(self.forward, units), strict=True) if units else ((), ())
        before, total = [], 0
        for f in scores:
            before.append(total)
            total += f[-1]
        tick = count()
        last = len(units) - 1
        heap = [(-total, next(tick), last, len(edges[last]) - 1, 0, None)] if units else []
        found: list[tuple[int, list[tuple[int, ...]]]] = [] if units else [(0, [])]
        while heap and len(found) < n:
            minus, _, u, j, behind, path = heapq.heappop(heap)
            while j == 0 and u > 0:
                u -= 1
                j = len(edges[u]) - 1
            if j == 0:
                out: list[list[int]] = [[] for _ in units]
                while path is not None:
                    k, ids, path = path
                    out[k] += ids
                found.append((-minus, [tuple(x) for x in out]))
                continue
            for i, ids, s in edges[u][j]:
                heapq.heappush(heap, (-(before[u] + scores[u][i] + s + behind), next(tick), u, i, behind + s, (u, ids, path)))
        return found

    def marked(self, text: str) -> str:
        return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""

    def encode(self, texts: list[str], n: int) -> list[tuple[np.ndarray, list[int], list[list[tuple[int, int, tuple[int, ...]]]]]]:
        """For each text the best ids, the scores of its n best segmentations, and for each of these but the first the
        changes to the best ids: at, how many go, the ids in their place."""
        split = [self.unit.findall(self.marked(t)) for t in texts]
        if len(self.known) > REMEMBER:
            self.forget()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.solve_waiting()
        sizes, lost = self.sizes[index], self.loss[index]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[index] - (ends - sizes), sizes)]
        total = np.concatenate(([0], np.cumsum(self.best[index])))
        ends = np.concatenate(([0], ends))
        out, a = [], 0
        for units, b in zip(split, np.cumsum(counts).tolist(), strict=True):
            scores, changes = [int(total[b] - total[a])], []
            if n > 1 and b > a:
                least = self._least(lost[a:b], n - 1)
                least = np.sort(least[lost[a + least] < -NEVER]).tolist()
                if least:
                    (top, first), *rest = self.n_best([units[k] for k in least], n)
                    for score, ways in rest:
                        scores.append(scores[0] + score - top)
                        changes.append([(int(ends[a + k] - ends[a]), int(sizes[a + k]), way) for k, way, old in zip(least, ways, first, strict=True) if way != old])
            out.append((ids[ends[a] : ends[b]], scores, changes))
            a = b
        return out

    @staticmethod
    def _least(lost: np.ndarray, k: int) -> np.ndarray:
        """Places of the k smallest values, earlier places first among equals."""
        if len(lost) <= k:
            return np.arange(len(lost))
        edge = np.partition(lost, k - 1)[k - 1]
        below = np.flatnonzero(lost < edge)
        return np.concatenate((below, np.flatnonzero(lost == edge)[: k - len(below)]))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocab["bytes"].__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _column(n: int, offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


_CHANGES = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, n_best: int = N_BEST, path: str | None = None, scores: str = "zipf", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (best segmentation), score, others (score and changes to ids of the next best) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path or vocabulary_path(), scores))

    def run(batches):
        lattice = Lattice(shared.value)  # a tenth of a second; none is kept in the worker
        for b in batch_pieces(batches, limit=PIECE):
            rows = lattice.encode([t or "" for t in b.column("text").to_pylist()], n_best)
            offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
            ids = _column(len(rows), offsets, pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
            others = [[{"score": s, "changes": [{"at": a, "n": k, "ids": list(x)} for a, k, x in c]} for s, c in zip(r[1][1:], r[2], strict=True)] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array([r[1][0] for r in rows], pa.int64()), pa.array(others, _CHANGES)], ["doc_id", "ids", "score", "others"])
        lattice.forget()
        give_back()

    ddl = "doc_id long, ids array<int>, score long, others array<struct<score:long,changes:array<struct<at:int,n:int,ids:array<int>>>>>"
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path or vocabulary_path()))

    def run(batches):
        lattice = Lattice(shared.value)  # a tenth of a second; none is kept in the worker
        for b in batches:
            texts = [lattice.decode(np.asarray(x if x is not None else [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, n_best: int = N_BEST, path: str | None = None, scores: str = "zipf") -> DataFrame:
    """What encoding and decoding give for every document, without moving the ids out of the tasks.

    doc_id, n_pieces, scores (of the n best), ids_sha256 (of the ids as 32-bit little-endian integers), n_changed (pieces of the best
    that some other of the n best replaces), decoded_sha256, round_trip (decoding the ids gives the text).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path or vocabulary_path(), scores))

    def run(batches):
        lattice = Lattice(shared.value)  # a tenth of a second; none is kept in the worker
        for b in batch_pieces(batches, limit=PIECE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            columns: list[list] = [[], [], [], [], [], []]
            for t, (ids, found, changes) in zip(texts, lattice.encode(texts, n_best), strict=True):
                back = lattice.decode(ids)
                row = (len(ids), found, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), len({(a, n) for c in changes for a, n, _ in c}), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_pieces", "scores", "ids_sha256", "n_changed", "decoded_sha256", "round_trip"])
        lattice.forget()
        give_back()

    ddl = "doc_id long, n_pieces long, scores array<long>, ids_sha256 string, n_changed long, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
