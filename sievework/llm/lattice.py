"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k.

All segmentations of a text into pieces of the vocabulary form a lattice. Its paths, weighted by
their probability, are sampled without replacement: every path carries a Gumbel-perturbed log
probability, and the k largest are found by best-first (A-star) search over sets of paths. A set is
"the paths that agree with a found one up to a step and leave it there"; the lattice's exact
backward sums give the set's log mass, and the largest perturbed value in it follows from that mass
and its parent's value alone, so the bound by which the search is ordered is exact and each pop
yields the next sample. Within the popped set the path is drawn forward, edge by edge.

Texts are cut before runs of spaces and around newlines, which no piece of the vocabulary crosses
(checked when it is loaded; a vocabulary with such a piece is refused), so the lattice is a chain of
small ones, one per word with its punctuation; the lattice of each distinct word is built once for a
batch, by array operations over all words.

The files' scores are merge ranks; the model takes a piece of rank r to have probability
proportional to 1 / (r + 2), raised to alpha. Characters outside the vocabulary go by byte pieces.
All random numbers are hashes of the row's key, the sample, and the place in the text: reruns,
other batches and other machines agree.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import documents, release

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3, 0xC2B2AE3D27D4EB4F)]


_64, _NONE = (1 << 64) - 1, np.empty(0, dtype=np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from hashes."""
    return ((_mix(h) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class Vocabulary:
    """Pieces, ids and log weights of a SentencePiece file, and a hash table of all pieces' prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.weight, self.ids = [], {}, [], []
        self.text: list[bytes] = []
        for i in range(s.get_piece_size()):
            piece = s.id_to_piece(i)
            if s.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif s.is_control(i) or s.is_unknown(i) or s.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(SPACE, " ").encode())
                self.pieces.append(piece)
                self.ids.append(i)
                self.weight.append(-math.log(min(40_000, max(0, -s.get_score(i))) + 2))
        if crossing := [p for p in self.pieces if len(_WORDS.findall(p)) > 1]:
            raise ValueError(f"pieces that cross the cut between two units: {crossing[:5]}")
        self.size = np.array([*map(len, self.text)])
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.byte_weight = float(-np.log(40_002))
        self.longest = max(map(len, self.pieces))
        self.ids, self.weight = np.array(self.ids, dtype=np.int32), np.array(self.weight)
        found: dict[int, tuple[str, int]] = {}
        for k, piece in enumerate(self.pieces):
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(_M[3]) + ord(c) * int(_M[0])) & _64
                prefix, at = found.get(h, (piece[:n], -1))
                if prefix != piece[:n]:
                    raise ValueError("two prefixes of pieces share a hash")
                found[h] = (prefix, k if n == len(piece) else at)
        keys = _mix(np.array([*found], dtype=np.uint64))
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift, self.table, self.piece_at = np.uint64(64 - bits), np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        if (keys == 0).any():
            raise ValueError("a prefix hashes to the mark of an empty place")
        for key, (_, k) in zip(keys.tolist(), found.values(), strict=True):  # open addressing
            at = key >> int(self.shift)
            while self.table[at]:
                at = (at + 1) % (1 << bits)
            self.table[at], self.piece_at[at] = key, k

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, piece): the hashes that are a prefix of some piece, and the piece that each is, -1 if it is none."""
        at = (keys >> self.shift).astype(np.int32)
        there = self.table[at]
        hit = there == keys
        which = np.flatnonzero(hit)
        piece = self.piece_at[at[which]]
        on = np.flatnonzero(~hit & (there != 0))
        if not on.size:
            return which, piece
        at, late, places = at[on], [which], [piece]
        while on.size:
            at = (at + 1) % len(self.table)
            there = self.table[at]
            hit = there == keys[on]
            late.append(on[hit])
            places.append(self.piece_at[at[hit]])
            more = ~hit & (there != 0)
            on, at = on[more], at[more]
        which = np.concatenate(late)
        order = np.argsort(which, kind="stable")
        return which[order], np.concatenate(places)[order]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Bits of a drawing key: the state above, the share of its edges' probability below.
_SHARE = 36


class Lattices:
    """Lattices of distinct words. A state is a place in a word; edges of a state lie together.

    States lie by level, the characters left to the word's end; within a level the longest words come
    first, so level d holds the words of d characters or more and a state's number is its level's
    offset plus its word's rank. first[w]: the state of word w's start. key: per edge, its state and
    the share of that state's probability up to it, so that one search draws an edge; shares come
    from the state's own edges alone, so a word's draws do not depend on the batch. back: log mass
    from a state to the word's end. others: log probability of a state's other edges, -inf if none.
    """

    def __init__(self, v: Vocabulary, words: list[str], alpha: float):
        """The whole of the words alone."""
        n = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        by_length = np.argsort(-n, kind="stable")
        rank_of = np.empty(len(words), dtype=np.int32)
        rank_of[by_length] = np.arange(len(words), dtype=np.int32)
        longest = int(n.max()) if len(n) else 0
        held = np.cumsum(np.bincount(n, minlength=longest + 1)[::-1])[::-1]  # words of so many characters or more
        offset = np.concatenate([[0], np.cumsum(held)])
        self.words, self.offset, states = len(words), offset, int(offset[-1])
        if states >= 1 << 27:
            raise ValueError("words of too many characters for one batch")
        offset = offset.astype(np.int32)
        self.first = offset[n] + rank_of
        level = np.repeat(np.arange(longest + 1, dtype=np.int32), held)
        rank = np.arange(states, dtype=np.int32) - offset[level]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * _M[0]
        stop = np.cumsum(n)[by_length]  # end of each word in points, by rank
        char = np.concatenate([np.zeros(len(words), dtype=np.uint64), points[stop[rank[len(words):]] - level[len(words):]]])
        froms, tos, pieces = [], [], []
        at = np.arange(len(words), states, dtype=np.int32)
        here, left, row, h = at, level[at], rank[at], np.zeros(len(at), dtype=np.uint64)
        single = np.zeros(states, dtype=bool)
        for length in range(1, v.longest + 1):
            if not len(at):
                break
            h = h * _M[3] + char[here]
            ok, piece = v.find(_mix(h))
            at, left, row, h = at[ok], left[ok] - 1, row[ok], h[ok]
            here = offset[left] + row  # the state after these characters
            edge = piece >= 0
            froms.append(at[edge])
            tos.append(here[edge])
            pieces.append(piece[edge])
            if length == 1:
                single[at[edge]] = True
            more = left > 0
            at, left, row, h, here = at[more], left[more], row[more], h[more], here[more]
        lone = np.flatnonzero(~single[self.words :]) + self.words
        self.spelled: list[list[int]] = []
        weights = [alpha * v.weight[p] for p in pieces]
        pieces = [v.ids[p] for p in pieces]
        if lone.size:
            text = "".join(words)
            where = stop[rank[lone]] - level[lone]
            spelled = [[v.bytes[b] for b in text[i].encode("utf-8", "surrogatepass")] for i in where.tolist()]
            froms.append(lone)
            tos.append(offset[level[lone] - 1] + rank[lone])
            self.spelled = [s for s in spelled if len(s) > 1]  # piece -1 - i stands for the bytes self.spelled[i]
            names = iter(range(-1, -1 - len(self.spelled), -1))
            pieces.append(np.array([s[0] if len(s) == 1 else next(names) for s in spelled], dtype=np.int32))
            weights.append(alpha * v.byte_weight * np.array([*map(len, spelled)], dtype=np.float64))
        count = np.zeros(states, dtype=np.int64)
        for part in froms:  # a state stands at most once in a part
            count[part] += 1
        self.start = np.concatenate([[0], np.cumsum(count)])
        edges = int(self.start[-1])
        self.frm, self.to = np.empty(edges, dtype=np.int32), np.empty(edges, dtype=np.int32)
        self.piece, self.weight = np.empty(edges, dtype=np.int32), np.empty(edges)
        filled = self.start[:-1].copy()
        for f, t, p, w in zip(froms, tos, pieces, weights, strict=True):
            spot = filled[f]
            self.frm[spot], self.to[spot], self.piece[spot], self.weight[spot] = f, t, p, w
            filled[f] += 1
        self.back = np.zeros(states)
        for d in range(1, longest + 1):
            a, b = int(offset[d]), int(offset[d + 1])
            s, e = int(self.start[a]), int(self.start[b])
            value = self.weight[s:e] + self.back[self.to[s:e]]
            new = self.start[a:b] - s
            top = np.maximum.reduceat(value, new)
            self.back[a:b] = top + np.log(np.add.reduceat(np.exp(value - top[self.frm[s:e] - a]), new))
        self.logp = np.minimum(self.weight + self.back[self.to] - self.back[self.frm], 0.0)
        prob = np.exp(self.logp)
        if edges:
            inner = np.flatnonzero(count)
            begin = self.start[inner]
            likely = prob >= 0.5
            rest = np.zeros(states)
            rest[inner] = np.add.reduceat(np.where(likely, 0.0, prob), begin)
            with np.errstate(divide="ignore"):
                self.others = np.log(np.where(likely, rest[self.frm], 1.0 - prob))
            share, most = prob.copy(), int(count.max())
            for r in range(1, most):
                inner = inner[count[inner] > r]
                spot = self.start[inner] + r
                share[spot] += share[spot - 1]
            self.key = (self.frm.astype(np.uint64) << np.uint64(_SHARE)) + np.minimum(share * (1 << _SHARE), (1 << _SHARE) - 1).astype(np.uint64)
            self.key[self.start[1:][count > 0] - 1] = (np.flatnonzero(count).astype(np.uint64) + np.uint64(1)) << np.uint64(_SHARE)
        else:
            self.others, self.key = np.empty(0), np.empty(0, dtype=np.uint64)

        self.inner = np.ones(states, dtype=bool)
        self.inner[: self.words] = False

    def after(self, base: "Lattices", known: np.ndarray, at: np.ndarray) -> "Lattices":
        """One lattice of base and these words. Of the words to be looked up, known says which are base's,
        and at gives each one's number there, or among these."""
        both, states, edges = object.__new__(Lattices), np.int32(len(base.back)), len(base.logp)
        own = self.piece
        if self.spelled and base.spelled:
            own = np.where(own < 0, own - np.int32(len(base.spelled)), own)
        both.spelled, both.piece = base.spelled + self.spelled, np.concatenate([base.piece, own])
        both.frm, both.to = np.concatenate([base.frm, self.frm + states]), np.concatenate([base.to, self.to + states])
        both.key = np.concatenate([base.key, self.key + (np.uint64(states) << np.uint64(_SHARE))])
        both.start = np.concatenate([base.start[:-1], self.start + edges])
        for name in ("logp", "others", "inner"):
            setattr(both, name, np.concatenate([getattr(base, name), getattr(self, name)]))
        both.first = np.empty(len(at), dtype=np.int64)
        both.first[known], both.first[~known] = base.first[at[known]], self.first[at[~known]] + states
        return both

    def draw(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, edges): a path from each state to its word's end; edges of one follow each other."""
        who, which, edges = np.flatnonzero(self.inner[states]), [], []
        who = who[np.argsort(states[who])]  # near states are near in memory
        at, step, seed = states[who], 0, seeds[who]
        steps = np.zeros(len(states), dtype=np.int64)
        while who.size:
            u = _mix(seed + np.uint64(step * int(_M[0]) & _64)) >> np.uint64(64 - _SHARE)
            e = np.searchsorted(self.key, (at.astype(np.uint64) << np.uint64(_SHARE)) + u, side="right")
            which.append(who)
            edges.append(e)
            steps[who] += 1
            at, step = self.to[e], step + 1
            more = self.inner[at]
            who, at, seed = who[more], at[more], seed[more]
        if not which:
            return steps, np.empty(0, dtype=np.int64)
        begin = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), dtype=np.int64)
        for i, (w, e) in enumerate(zip(which, edges, strict=True)):
            out[begin[w] + i] = e
        return steps, out

    def best(self) -> np.ndarray:
        """Per state, the first edge of its likeliest path to the word's end; -1 for an end."""
        value, edge = np.zeros(len(self.back)), np.full(len(self.back), -1, dtype=np.int64)
        for a, b in zip(self.offset[1:-1].tolist(), self.offset[2:].tolist(), strict=True):
            s, e = int(self.start[a]), int(self.start[b])
            v = self.weight[s:e] + value[self.to[s:e]]
            value[a:b] = np.maximum.reduceat(v, self.start[a:b] - s)
            hit = np.flatnonzero(v == value[self.frm[s:e]])[::-1]
            edge[self.frm[s:e][hit]] = s + hit  # of equal ones the shortest first piece
        return edge

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """Ids of a path's pieces."""
        ids = self.piece[edges]
        if not self.spelled or not len(ids) or ids.min() >= 0:
            return ids
        at = np.flatnonzero(ids < 0)
        parts = [self.spelled[-1 - x] for x in ids[at].tolist()]
        n = np.ones(len(ids), dtype=np.int64)
        n[at] = [*map(len, parts)]
        out, begin = np.repeat(ids, n), np.cumsum(n) - n
        for x, part in zip(begin[at].tolist(), parts, strict=True):
            out[x : x + len(part)] = part
        return out


#: Parts units while they are numbered; where a text holds it, units are listed instead.
_CUT = "\x1f"


def _simple(text: str) -> bool:
    """Whether each space begins a unit."""
    return text[0] != " " and "  " not in text and SPACE not in text


def units(text: str) -> list[str]:
    """The text's words, each with the white space before it; a space stands before the first."""
    return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, number of each unit of all texts, units before each text and in all)."""
    if any(_CUT in t for t in texts):
        listed = [units(t) for t in texts]
        coded = pa.array([*chain.from_iterable(listed)], type=pa.string()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum([*map(len, listed)])]).astype(np.int64)
    marked = [_CUT + SPACE + t.replace(" ", _CUT + SPACE).replace("\n", f"{_CUT}\n{_CUT}") if t and _simple(t) else _CUT.join(["", *units(t)]) for t in texts]
    cut = pc.split_pattern(pa.array(marked, type=pa.string()), _CUT)
    coded = cut.values.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    bounds = cut.offsets.to_numpy().astype(np.int64)
    if "" in words:  # each row's first, and between a line feed and a space
        empty = words.index("")
        keep = number != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        number = number[keep]
        number -= number > empty
        del words[empty]
    return words, number, bounds


def row_seed(key: object) -> np.uint64:
    raw = str(key).encode("utf-8", "surrogatepass")
    return np.uint64(zlib.crc32(raw) | zlib.crc32(b"lattice:" + raw) << 32)


def _below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value of sets of that much log mass, given that it is under bound; u is uniform."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = mass - bound
        near = mass - np.log(np.exp(np.minimum(gap, 700.0)) - np.log(u))
        return np.where(mass == -np.inf, -np.inf, np.where(gap > 700.0, bound, near))


#: Words whose lattices a worker keeps, and the least times that a batch holds them.
KEPT, OFTEN = 60_000, 2


class _Kept:
    """Lattices of the words that a worker's first batches hold often; they change no result."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.base: Lattices | None = None

    def lattices(self, v: Vocabulary, words: list[str], coded: np.ndarray, alpha: float) -> Lattices:
        if self.base is None:
            lat, times = Lattices(v, words, alpha), np.bincount(coded, minlength=len(words))
            often = [words[i] for i in np.argsort(-times, kind="stable")[:KEPT].tolist() if times[i] >= OFTEN]
            if len(coded) >= KEPT and often:
                self.number, self.base = {w: i for i, w in enumerate(often)}, Lattices(v, often, alpha)
            return lat
        at = np.array([self.number.get(w, -1) for w in words], dtype=np.int64)
        known = at >= 0
        new = np.flatnonzero(~known)
        at[new] = np.arange(len(new))
        return Lattices(v, [words[i] for i in new.tolist()], alpha).after(self.base, known, at)


@functools.cache
def _kept(v: Vocabulary, alpha: float) -> _Kept:
    return _Kept()


class _Path:
    """One sample and the set of paths that leave it after its own steps begin.

    head: the edges up to and including the one it left its parent by; tail: the edges after; unit:
    each tail edge's unit; before: log probability up to each of the tail's steps; mass: log
    probability of leaving the path there; after: the largest perturbed value in that set.
    """

    __slots__ = ("head", "tail", "unit", "before", "mass", "barred", "logp", "value", "after")


def sample(v: Vocabulary, keys: list, texts: list[str], k: int, alpha: float) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """Per text: up to k distinct segmentations, best perturbed value first, and the value of the next.

    A segmentation is (ids, log probability, value). Fewer than k where the lattice has fewer paths,
    and then the next value is -inf; the empty text has one, without pieces.

    The agenda of a text holds one set per found path. Popping the best draws the step at which the
    new path leaves (by mass, since the argmax of Gumbel values falls so), the edge it leaves by, and
    the rest forward; what remains of the popped set goes back, bounded by the popped value.
    """
    words, coded, bounds = _coded(texts)
    lat = _kept(v, alpha).lattices(v, words, coded, alpha)
    first = lat.first[coded] if len(coded) else coded
    seeds = _mix(np.array([row_seed(x) for x in keys], dtype=np.uint64)) if keys else np.empty(0, dtype=np.uint64)
    uniform = lambda who, j, what: _uniform(seeds[who] ^ np.uint64(((j + 1) * int(_M[4]) + what * int(_M[1])) & _64))
    paths: list[list[_Path]] = [[] for _ in texts]
    live = np.flatnonzero(np.diff(bounds))  # texts whose agenda is not empty
    heads: list = [None] * len(live)
    into = [(int(bounds[i]), None) for i in live]  # first unit drawn afresh, and the state that the one before goes on from
    head_lp, values = np.zeros(len(live)), -np.log(-np.log(uniform(live, 0, 1)))
    for j in range(k):
        if j:
            pops = [(i, max(paths[i], key=lambda p: p.after)) for i in live.tolist()]
            pops = [(i, p) for i, p in pops if p.after > -np.inf]
            live = np.array([i for i, _ in pops], dtype=np.int64)
            step_u, edge_u, rest_u = uniform(live, j, 2), uniform(live, j, 3), uniform(live, j, 4)
            heads, into, head_lp, values, left = [], [], np.zeros(len(live)), np.array([p.after for _, p in pops]), np.full(len(live), -np.inf)
            for q, (i, best) in enumerate(pops):
                weight = np.exp(best.mass - best.mass.max())
                line = np.cumsum(weight)
                t = min(int(np.searchsorted(line, step_u[q] * line[-1], side="right")), len(line) - 1)
                while weight[t] <= 0:
                    t -= 1
                edge = int(best.tail[t])
                state = int(lat.frm[edge])
                barred = best.barred.setdefault(t, [edge])
                open_ = np.array([e for e in range(int(lat.start[state]), int(lat.start[state + 1])) if e not in barred])
                p = np.exp(lat.logp[open_] - lat.logp[open_].max())
                c = np.cumsum(p)
                at = min(int(np.searchsorted(c, edge_u[q] * c[-1], side="right")), len(open_) - 1)
                new = int(open_[at])
                barred.append(new)
                p[at] = 0.0
                best.mass[t] = best.before[t] + lat.logp[open_].max() + math.log(p.sum()) if len(open_) > 1 and p.sum() > 0 else -np.inf
                top = best.mass.max()
                if top > -np.inf:
                    left[q] = top + math.log(np.exp(best.mass - top).sum())
                heads.append(np.concatenate([best.head, best.tail[:t], [new]]))
                into.append((int(best.unit[t]) + 1, int(lat.to[new])))
                head_lp[q] = best.before[t] + lat.logp[new]
            for (_, best), after in zip(pops, _below(left, values, rest_u).tolist(), strict=True):
                best.after = after
        if not len(live):
            break
        if j == 0:
            unit, states, lengths = np.arange(len(coded)), first, np.diff(bounds)[live]
        else:
            spans = [np.arange(w - 1, bounds[i + 1]) for i, (w, _) in zip(live.tolist(), into, strict=True)]
            lengths = np.array([*map(len, spans)])
            unit = np.concatenate(spans)
            states = first[unit]
            states[np.cumsum(lengths) - lengths] = [s for _, s in into]
        own = unit - np.repeat(bounds[live], lengths)  # a unit's place in its text
        draws = np.repeat(seeds[live], lengths) ^ (np.uint64((j + 1) * int(_M[4]) & _64) + (own.astype(np.uint64) + np.uint64(1)) * _M[2])
        steps, edges = lat.draw(states, draws)
        unit_of = np.repeat(unit, steps)
        stops = np.concatenate([[0], np.cumsum(np.add.reduceat(steps, np.cumsum(lengths) - lengths))])
        lp, before = lat.logp[edges], np.empty(len(edges))
        for q, (s, e) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
            if e > s:
                before[s] = head_lp[q]
                np.cumsum(lp[s : e - 1], out=before[s + 1 : e])
                before[s + 1 : e] += head_lp[q]
        mass = before + lat.others[edges]
        total = np.full(len(live), -np.inf)
        some = np.flatnonzero(stops[1:] > stops[:-1])
        if some.size:
            top = np.maximum.reduceat(mass, stops[some])
            safe = np.where(top > -np.inf, top, 0.0)
            with np.errstate(divide="ignore"):
                total[some] = safe + np.log(np.add.reduceat(np.exp(mass - np.repeat(safe, np.diff(stops)[some])), stops[some]))
        after = _below(total, values, uniform(live, j, 5)).tolist()
        for q, i in enumerate(live.tolist()):
            s, e = int(stops[q]), int(stops[q + 1])
            path = _Path()
            path.head, path.tail, path.unit, path.before, path.mass = heads[q] if heads[q] is not None else _NONE, edges[s:e], unit_of[s:e], before[s:e], mass[s:e]
            path.barred, path.value, path.after = {}, float(values[q]), after[q]
            path.logp = float(before[e - 1] + lp[e - 1]) if e > s else float(head_lp[q])
            paths[i].append(path)
    out = []
    for i in range(len(texts)):
        found = [(lat.spell(np.concatenate([p.head, p.tail]) if len(p.head) else p.tail), p.logp, p.value) for p in paths[i]]
        after = max((p.after for p in paths[i]), default=-np.inf)
        out.append((found, after) if found else ([(np.empty(0, dtype=np.int32), 0.0, 0.0)], -np.inf))
    return out


def encode_best(v: Vocabulary, texts: list[str]) -> list[tuple[np.ndarray, float]]:
    """Per text: the ids of its likeliest segmentation and their summed log weights.

    Of equally likely ones the first place at which they differ takes the shorter piece. The empty
    text has no pieces.
    """
    words, coded, bounds = _coded(texts)
    lat = Lattices(v, words, 1.0)
    edge = lat.best()
    ids, weight = [], []
    for state in lat.first.tolist():
        taken, w = [], 0.0
        while state >= lat.words:
            e = int(edge[state])
            taken.append(e)
            w += float(lat.weight[e])
            state = int(lat.to[e])
        ids.append(lat.spell(np.array(taken, dtype=np.int64)))
        weight.append(w)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = coded[s:e].tolist()
        out.append((np.concatenate([ids[u] for u in mine]) if mine else np.empty(0, dtype=np.int32), math.fsum(weight[u] for u in mine)))
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of pieces: the space before the first word goes. Bytes that are no text become U+FFFD."""
    raw = b"".join(map(v.text.__getitem__, ids))[1:]
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


_SCHEMA = "sample int, n_pieces long, logprob double, inclusion double, ids_crc32 long, exact boolean"


def _decodes(v: Vocabulary, ids: list[np.ndarray], raw: list[bytes]) -> list[bool]:
    """Whether the pieces of each row spell the row's bytes, compared at once for all rows."""
    sizes = np.array([*map(len, ids)])
    flat = np.concatenate([_NONE, *ids]).astype(np.int64)
    n = v.size[flat]
    ends = np.cumsum(n)
    spelled = v.flat[np.arange(int(n.sum())) + np.repeat(v.begin[flat] - ends + n, n)].tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [spelled[s + 1 : e] == x for s, e, x in zip(cuts[:-1], cuts[1:], raw, strict=True)]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with at most so many characters; a longer text is a run of its own."""
    line, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(line, (int(line[at - 1]) if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def _inclusion(logp: float, threshold: float) -> float:
    """log(1 - exp(-exp(logp - threshold)))."""
    if threshold == -np.inf:
        return 0.0
    gap = min(700.0, logp - threshold)
    return math.log(-math.expm1(-math.exp(gap))) if gap > -30 else gap


_IDS = pa.list_(pa.field("element", pa.int32()))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([*map(len, ids)])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NONE, *ids]).astype(np.int32))).cast(_IDS)


def sample_segmentations(df: DataFrame, path: str, k: int = 2, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chars: int = 800_000) -> DataFrame:
    """Up to k rows per row: id, sample (0 first), n_pieces, logprob, inclusion, ids_crc32, exact, and ids if asked.

    inclusion: the log probability that the segmentation is among the top k, given the value of the
    one after (the threshold of Gumbel top-k): log(1 - exp(-exp(logprob - threshold))); 0 where no
    other is left. exact: the pieces decode to the text. A null text counts as empty and has the one
    segmentation without pieces. The row's key is its id, so rows that share id and text share samples.
    An empty table gives no rows. Columns other than the two named play no part. chars bounds a batch,
    not a text, and changes no result.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        names = ["id", "sample", "n_pieces", "logprob", "inclusion", "ids_crc32", "exact", *["ids"] * with_ids]
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for at, stop in _slices([*map(len, texts)], chars):
                rows, ids, raws = [], [], []
                for key, text, (found, threshold) in zip(keys[at:stop], texts[at:stop], sample(v, keys[at:stop], texts[at:stop], k, alpha), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for j, (x, lp, _) in enumerate(found):
                        rows.append((key, j, len(x), lp, _inclusion(lp, threshold), zlib.crc32(x.astype("<u4", copy=False))))
                        ids.append(x)
                        raws.append(raw)
                types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                arrays = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                arrays.append(pa.array(_decodes(v, ids, raws), type=pa.bool_()))
                yield pa.RecordBatch.from_arrays([*arrays, *([_lists(ids)] if with_ids else [])], names=names)
            release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {_SCHEMA}" + (", ids array<int>" if with_ids else ""))


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chars: int = 800_000) -> DataFrame:
    """(id, ids, weight): each row's likeliest segmentation; a null text counts as empty and has no pieces."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at, stop in _slices([*map(len, texts)], chars):
                found = encode_best(v, texts[at:stop])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), _lists([x for x, _ in found]), pa.array([w for _, w in found], type=pa.float64())], names=["id", "ids", "weight"])
            release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, weight double")


def decode_ids(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null for null ids, or where an id is null or none of the vocabulary's."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        known = lambda ids: ids is not None and all(i is not None and 0 <= i < len(v.text) for i in ids)
        for b in batches:
            texts = [decode(v, ids) if known(ids) else None for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op4_lattice_samples(spark, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document's whole text; null and empty texts have one, without pieces."""
    import public_tokenizers

    return sample_segmentations(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
