"""SentencePiece models, read from their files, and batched segmentation in numpy.

A text is normalised (a leading space, spaces as U+2581) and cut into units that no piece
crosses: a run of spaces with what follows it, and line breaks. Distinct units are encoded
once; units of equal length advance together, as rows of a matrix of code points. A
substring's hash comes from two prefix sums and is looked up among the sorted piece keys.

  unigram models  Viterbi: at each end position the maximum over piece lengths, with the
                  winning length stored as backpointer. The vocabulary of a BPE model can be
                  read as one too (`read` with as_unigram).
  BPE models      the same rows, hashes and keys, but merges instead of path sums, as the
                  best path over BPE scores isn't what BPE encodes: every round, each row
                  joins its best-scored neighbouring pair, leftmost on ties

A unit of more than LONG characters is looked up whole, all positions of a piece length at
once, and then takes the recurrence over the pieces found. Characters outside the vocabulary
become byte pieces, or the unknown piece without those.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordcols import joined, mix, powers, span_hashes

SPACE = "▁"
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_LEAD = 18  # leading bits of a hash that index the sorted keys
LONG = 128  # units of more characters go one by one
LEAST_SCORE = -40000.0  # of a BPE model's pieces read as unigrams: some are stored with -1e9, which single precision can't add up

_BASE = np.uint64(0xC6A4A7935BD1E995 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UP, _DOWN = powers(_BASE, LONG + 1), powers(_INVERSE, LONG + 1)
_NONE = np.iinfo(np.int32).max


def _fields(data: bytes):
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield key >> 3, data[at - size : at]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    kind: int  # UNIGRAM or BPE
    dummy_prefix: bool
    unk: int
    byte_ids: np.ndarray | None
    keys: np.ndarray = field(init=False)  # sorted hashes of the pieces that text can match
    key_ids: np.ndarray = field(init=False)
    key_ranks: np.ndarray = field(init=False)  # by score, best first; equal scores, equal ranks
    longest: int = field(init=False)
    line_breaks: bool = field(init=False)

    def __post_init__(self):
        usable = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        texts = [self.pieces[i] for i in usable]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("pieces that go on over a space are not supported")
        self.longest = max(map(len, texts), default=1)
        keys = np.array([self._key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], usable[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("piece hashes collide")
        heads = (self.keys >> np.uint64(64 - _LEAD)).astype(np.int64)
        self.starts = np.minimum(np.searchsorted(heads, np.arange(1 << _LEAD)), max(0, len(heads) - 1)).astype(np.int32)
        self.crowd = max(2, int(np.bincount(heads).max(initial=0)))
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))  # so that one past the last can be read
        ranks = np.unique(-self.scores[usable], return_inverse=True)[1].astype(np.int32)
        self.key_ranks = np.append(ranks[order], _NONE).astype(np.int32)
        self.key_ids = np.append(self.key_ids, self.unk)
        self.line_breaks = not any("\n" in t and len(t) > 1 for t in texts)  # a line break is a unit of its own
        self.unk_score = float(self.scores[usable].min()) - 10.0 if len(usable) else -10.0
        self.piece_bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNK else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds.tolist(), strict=True)
        ]

    @staticmethod
    def _key(text: str) -> int:
        codes = _codes([text]).astype(np.uint64)
        return int(mix(np.atleast_1d((codes * powers(_BASE, len(codes))).sum(dtype=np.uint64) + np.uint64(len(codes))))[0])

    @classmethod
    def read(cls, data: bytes, *, as_unigram: bool = False) -> PieceModel:
        """The model of a file. as_unigram: a BPE model's vocabulary and scores, no score below LEAST_SCORE, as a unigram model."""
        pieces, scores, kinds, kind, dummy, charsmap, trim = [], [], [], UNIGRAM, True, b"", True
        for number, value in _fields(data):
            if number == 1:
                text, score, k = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        k = v
                pieces.append(text)
                scores.append(score)
                kinds.append(k)
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, dummy, trim = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or trim:
            raise ValueError("only models with the identity normaliser that keep all white space are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if as_unigram and kind == BPE:
            kind, scores = UNIGRAM, [max(v, LEAST_SCORE) for v in scores]
        kinds_ = np.array(kinds)
        byte = {int(pieces[i][3:5], 16): i for i in np.flatnonzero(kinds_ == BYTE)}
        return cls(pieces, np.array(scores), kinds_, kind, dummy, int(np.flatnonzero(kinds_ == UNK)[0]), np.array([byte[b] for b in range(256)]) if len(byte) == 256 else None)

    # -- lookups ---------------------------------------------------------------

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the sorted keys, or -1."""
        # the leading bits give the place in the sorted keys, or a few before it
        at = self.starts[hashes >> np.uint64(64 - _LEAD)]
        for _ in range(self.crowd - 1):
            at = at + (self.keys[at] < hashes)
        return np.where(self.keys[at] == hashes, at, -1)

    def outside(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode("utf-8", "replace"))].tolist() if self.byte_ids is not None else [self.unk]

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(raw, start, end, first): units as byte spans of raw; those of text i are first[i]:first[i + 1].

        The blank before each text stands for the leading space that the model adds.
        """
        texts = pc.replace_substring(texts, SPACE, " ")
        raw, blanks = joined(texts)
        if not len(raw):
            return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(blanks), np.int64)
        space, line = raw == 0x20, (raw == 0x0A) if self.line_breaks else np.zeros(len(raw), bool)
        begins = line.copy()
        begins[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        begins[blanks[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        at_head = np.zeros(len(raw), bool)
        at_head[blanks[:-1]] = True
        head = at_head[start]
        if not self.dummy_prefix:
            start = start + head
        empty = np.zeros(len(raw), bool)
        empty[blanks[:-1][np.diff(blanks) == 1]] = True  # texts without characters have no units
        keep = (end > start) & ~(head & empty[np.minimum(start, len(raw) - 1)])
        start, end = start[keep], end[keep]
        return raw, start, end, np.searchsorted(start, blanks)

    @staticmethod
    def unit(raw: np.ndarray, start: int, end: int) -> str:
        return raw[start:end].tobytes().decode("utf-8", "replace").replace(" ", SPACE)

    # -- encoding --------------------------------------------------------------

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Piece ids of each of the distinct units."""
        out: list[list[int]] = [[]] * len(units)
        if not units:
            return out
        lengths = np.array([len(u) for u in units])
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(units)], strict=True):
            n = int(lengths[order[lo]])
            if n > LONG:
                for i in order[lo:hi]:
                    out[i] = self._one(units[i])
                continue
            rows = max(1, 400_000 // (n * (self.longest if self.kind == UNIGRAM else 1)))
            for at in range(lo, hi, rows):
                which = order[at : min(at + rows, hi)].tolist()
                texts = [units[i] for i in which]
                codes = _codes(texts).reshape(len(texts), n)
                ends, ids = self._viterbi(codes) if self.kind == UNIGRAM else self._merged(codes)
                # ids are -1 for single characters outside the vocabulary
                for i, text, e, p in zip(which, texts, ends, ids, strict=True):
                    if min(p) >= 0:
                        out[i] = p
                    else:
                        out[i] = [q for end, x in zip(e, p, strict=True) for q in ([x] if x >= 0 else self.outside(text[end - 1]))]
        return out

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(codes.astype(np.uint64) * _UP[: codes.shape[1]], axis=1, out=total[:, 1:])
        return total

    @staticmethod
    def _hash(total: np.ndarray, rows, begin, end) -> np.ndarray:
        return mix((total[rows, end] - total[rows, begin]) * _DOWN[begin] + (end - begin).astype(np.uint64))

    def _viterbi(self, codes: np.ndarray) -> tuple[list, list]:
        rows, n = codes.shape
        total, every = self._sums(codes), np.arange(rows)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, ids = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
        for end in range(1, n + 1):
            sizes = np.arange(min(self.longest, end), 0, -1)  # of equal paths the one with the longest last piece
            begin = np.broadcast_to(end - sizes, (rows, len(sizes)))
            at = self.probe(self._hash(total, every[:, None], begin, np.full_like(begin, end)))
            score = np.where(at >= 0, self.scores[self.key_ids[at]], -np.inf)
            score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], self.unk_score)
            path = best[:, end - sizes] + score
            top = path.argmax(1)
            best[:, end], back[:, end] = path[every, top], sizes[top]
            found = at[every, top]
            ids[:, end] = np.where(found >= 0, self.key_ids[found], -1)
        ends_out: list[list[int]] = []
        ids_out: list[list[int]] = []
        for b, p in zip(back.tolist(), ids.tolist(), strict=True):
            e, x, at = [], [], n
            while at:
                e.append(at)
                x.append(p[at])
                at -= b[at]
            ends_out.append(e[::-1])
            ids_out.append(x[::-1])
        return ends_out, ids_out

    def _merged(self, codes: np.ndarray) -> tuple[list, list]:
        rows, n = codes.shape
        total, every = self._sums(codes), np.arange(rows)
        position = np.broadcast_to(np.arange(n), (rows, n))
        at = self.probe(self._hash(total, every[:, None], position, position + 1))
        ids = np.where(at >= 0, self.key_ids[at], -1).astype(np.int32)  # of the symbol that starts here
        end = np.ascontiguousarray(position + 1)  # where it ends
        before = np.ascontiguousarray(position - 1)  # where the one before it starts
        start = np.ones((rows, n), bool)
        if n > 1:
            # of each symbol with its next: rank and id of the joined piece
            rank, joined = np.full((rows, n), _NONE, np.int32), np.zeros((rows, n), np.int32)
            at = self.probe(self._hash(total, every[:, None], position[:, :-1], position[:, :-1] + 2))
            rank[:, :-1] = np.where(at >= 0, self.key_ranks[at], _NONE)
            joined[:, :-1] = self.key_ids[at]
            live = every
            while True:
                low = rank[live].argmin(1)
                ok = rank[live, low] < _NONE
                live, low = live[ok], low[ok]
                if not len(live):
                    break
                gone = end[live, low]
                ids[live, low] = joined[live, low]
                stop = end[live, gone]
                end[live, low] = stop
                start[live, gone] = False
                rank[live, gone] = _NONE
                rank[live, low] = _NONE
                more = stop < n
                r, b, nxt = live[more], low[more], stop[more]
                before[r, nxt] = b
                self._pair(total, rank, joined, r, b, end[r, nxt])
                more = low > 0
                r, b = live[more], before[live[more], low[more]]
                self._pair(total, rank, joined, r, b, stop[more])
        per_row = start.sum(1)
        ends_flat, ids_flat = end[start].tolist(), ids[start].tolist()
        cuts = np.concatenate([[0], np.cumsum(per_row)]).tolist()
        return [ends_flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [ids_flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _pair(self, total, rank, joined, rows, begin, end) -> None:
        at = self.probe(self._hash(total, rows, begin, end))
        rank[rows, begin] = np.where(at >= 0, self.key_ranks[at], _NONE)
        joined[rows, begin] = self.key_ids[at]

    # -- one long unit -----------------------------------------------------------

    def _vocabulary(self) -> dict[str, tuple[int, int]]:
        if not hasattr(self, "_by_text"):
            self._by_text = {self.pieces[i]: (int(r), int(i)) for i, r in zip(self.key_ids[:-1], self.key_ranks[:-1], strict=True)}
        return self._by_text

    def best_path(self, text: str) -> list[int]:
        """Viterbi over one unit of any length: pieces are looked up a length at a time, then taken by their ends."""
        codes, n = _codes([text]), len(text)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * powers(_BASE, n), out=total[1:])
        down = powers(_INVERSE, n)
        ends, sizes, ids = [], [], []
        for size in range(1, min(self.longest, n) + 1):
            at = self.probe(mix((total[size:] - total[:-size]) * down[: n - size + 1] + np.uint64(size)))
            # a single character outside the vocabulary has a score too
            here = np.flatnonzero(at >= 0) if size > 1 else np.arange(n)
            ends.append(here + size)
            sizes.append(np.full(len(here), size, np.int32))
            ids.append(np.where(at[here] >= 0, self.key_ids[at[here]], -1))
        ends, sizes, ids = (np.concatenate(x) for x in (ends, sizes, ids))
        order = np.lexsort((-sizes, ends))  # of equal paths the one with the longest last piece
        ends, sizes, ids = ends[order], sizes[order], ids[order]
        scores = np.where(ids >= 0, self.scores[ids], self.unk_score)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        top, last, won = -np.inf, 1, 0
        for k, (end, size, score) in enumerate(zip(ends.tolist(), sizes.tolist(), scores.tolist(), strict=True)):
            if end != last:
                best[last], back[last] = top, won
                top, last = -np.inf, end
            if (path := best[end - size] + score) > top:
                top, won = path, k
        best[last], back[last] = top, won
        out, at, sizes, ids = [], n, sizes.tolist(), ids.tolist()
        while at:
            out.append((ids[back[at]], at))
            at -= sizes[back[at]]
        return [q for x, end in reversed(out) for q in ([x] if x >= 0 else self.outside(text[end - 1]))]

    def _one(self, text: str) -> list[int]:
        """A unit of any length: the recurrence, or a heap of pairs (BPE)."""
        if self.kind == UNIGRAM:
            return self.best_path(text)
        known, n = self._vocabulary(), len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n and (got := known.get(text[a : end[end[a]]])):
                heapq.heappush(heap, (got[0], a, end[end[a]]))

        for a in range(n - 1):
            offer(a)
        dead = [False] * n
        while heap:
            _, a, stop = heapq.heappop(heap)
            if dead[a] or end[a] >= n or end[end[a]] != stop:
                continue
            dead[end[a]] = True
            end[a] = stop
            if stop < n:
                before[stop] = a
            offer(a)
            offer(before[a])
        parts, at = [], 0
        while at < n:
            parts.append(text[at : end[at]])
            at = end[at]
        return [q for p in parts for q in ([known[p][1]] if p in known else self.outside(p))]

    # -- decoding ----------------------------------------------------------------

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of the id runs first[i]:first[i + 1]. Bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "_flat"):
            self._flat = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
            self._ends = np.concatenate([[0], np.cumsum([len(b) for b in self.piece_bytes])])
        size = (self._ends[1:] - self._ends[:-1])[ids]
        begin = np.concatenate([[0], np.cumsum(size)])
        data = self._flat[np.repeat(self._ends[ids] - begin[:-1], size) + np.arange(begin[-1])].tobytes()
        cut = begin[first].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in out]


class UnitCache:
    """What is known of units met so far, by their 64-bit hash: a flat run of int32 values each.

    learn gives the values of new units. Above `limit` units all are forgotten.
    """

    def __init__(self, model: PieceModel, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.model, self.learn, self.limit = model, learn, limit
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(slots of all units in order, first): values of slot s are flat[ends[s]:ends[s + 1]]."""
        raw, start, end, first = self.model.spans(texts)
        unique, place, inverse = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            known = self.keys[at] == unique
        if not known.all():
            if len(self.keys) + (~known).sum() > self.limit:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            values, sizes = self.learn([self.model.unit(raw, a, b) for a, b in zip(start[place[new]].tolist(), end[place[new]].tolist(), strict=True)])
            slots = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            self.flat = np.concatenate([self.flat, values])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])
            keys, slot = np.concatenate([self.keys, unique[new]]), np.concatenate([self.slot, slots])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
        return self.slot[np.searchsorted(self.keys, unique)][inverse], first
