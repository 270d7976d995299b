"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

The CGK random walk reads a string with a pointer: at step j it writes down the character
under the pointer and moves on if a random bit of (j, character) says so. Strings at a
small edit distance get walks at a small Hamming distance. A repetition draws ``SAMPLED`` of
the ``STEPS`` places of a walk; the characters there make a hash. Three repetitions share a walk.

A window is as long as its item. Its embedding is the row of walks that begin at its words:
one walk over the whole window can't serve, as a walk that lost its step at one of many edits
seldom finds it again, so each word starts afresh. A document's window is a candidate if those of
the item's words that share a hash with it, at shifts that differ by ``DRIFT`` at most, weigh
``need`` together, at least as much as two words that no other shares; a hash weighs less the more words of the block have it. Repetitions and ``need`` come from measuring, for each class of items by their number of
words: items with edits of ``MOST_EDITS`` of their length, at random places and evenly spread,
must be found with ``RECALL``, those of each class with ``CLASS_RECALL``; a block that stays below gives a warning.

Each candidate is followed by exact verification: the least edit distance between the item
and any stretch of the document around the hits, by a bit-parallel search over many candidates at
once.

Texts are compared in lower case (A-Z) with white space collapsed. Items go to the
executors in blocks of at most ``BLOCK``; each block is one pass over the documents. A long
text is searched in overlapping segments, so memory has a bound.

Edge cases: null and empty texts and items never match; items too short for the
hashes go through an exact edit search between word borders, where punctuation counts as a
space; a null doc_id or item_id is reported as null; equal rows are reported each; empty
tables give an empty result; other columns are not read. What is found in a document depends on
that document and the block alone, not on the rows around it.
"""

from __future__ import annotations

import random
import uuid
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edit distance that still is a leak, as a share of the item's length.
MOST_EDITS = 0.2
#: Share of the items with MOST_EDITS that must be found, of all and of each class, and repetitions after which a block below it is reported.
RECALL, CLASS_RECALL, MOST_REPETITIONS = 0.95, 0.9, 48
#: Repetitions that are tried, and the share of measured copies that ``need`` keeps.
TRIED, CALIBRATED = (1, 6, 12, 18, 24, 30, 36, 48), 0.97
STEPS, SAMPLED = 30, 12
#: Bytes by which the shifts of a window's words may differ; half of it, a power of two, is always within.
DRIFT = 16
BLOCK = 4_000
#: Items of fewer characters, or with fewer windows that hold a walk, go through the exact search.
SHORT, FEW = 80, 8
#: Least numbers of words of the classes for which ``need`` is measured, and copies of items measured in each.
CLASSES, MEASURED = (0, 16, 22, 30, 40, 56), 80
#: Bytes and texts that are looked at together, bytes of a segment of a long text, and candidates verified together.
CHUNK, TEXTS, SEGMENT, VERIFIED = 1 << 20, 1 << 11, 1 << 20, 2048
#: A key of a hit is (text, item, shift, word, weight), in 11, 15, 24, 11 and 2 bits.
_ITEM_BITS, _SHIFT_BITS, _WORD_BITS = 15, 24, 11
#: Characters of a step of the walk's tables, bits of a hash and of its filter.
_STRIDE, _HASH_BITS, _FILTER_BITS = 3, 21, 18
#: Least need: two words at their full weight.
LEAST = 8
#: Weight, less 1, of a hash that so many words of the block share; the last for more.
_WEIGHTS = np.array([3, 3, 2, 2, *[1] * 12, 0])
#: Walks in each pass over the words.
_LOT = 1 << 13


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def _classes() -> np.ndarray:
    """5-bit classes of bytes: letters apart, other characters folded together."""
    b = np.arange(256)
    return np.select([(b >= 97) & (b <= 122), b <= 32, b < 128], [b - 96, 0, 27 + b % 5], 1 + b % 31).astype(np.int32)


_CLASS = _classes()


class Walk:
    """A walk with three samples of its steps, as tables over three characters at a time."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (STEPS, 32))
        sampled = np.zeros((3, STEPS), bool)
        for s in sampled:
            s[rng.choice(STEPS, SAMPLED, replace=False)] = True
        marks = rng.integers(0, 1 << _HASH_BITS, (3, STEPS, 32), dtype=np.uint64)
        codes = np.arange(1 << 15)
        chars = np.stack([codes >> 10, codes >> 5 & 31, codes & 31])
        self.tables = []
        for j in range(0, STEPS, _STRIDE):
            move, mark = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64)
            for k in range(j, j + _STRIDE):
                c = chars[move, codes]
                for q in np.flatnonzero(sampled[:, k]):
                    mark ^= marks[q, k, c] << np.uint64(_HASH_BITS * q)
                move += bits[k, c]
            self.tables.append((move.astype(np.int32), mark))

    def hashes(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three hashes of the walk from each start, packed, and where it ended."""
        h, end = np.zeros(len(starts), np.uint64), starts.astype(np.int32)
        c, mark, move = np.empty(_LOT, np.int32), np.empty(_LOT, np.uint64), np.empty(_LOT, np.int32)
        for a in range(0, len(starts), _LOT):
            hh, pos = h[a : a + _LOT], end[a : a + _LOT]
            n = len(pos)
            for moves, marks in self.tables:
                # every index is in range; "clip" is numpy's fast way
                np.take(code, pos, out=c[:n], mode="clip")
                np.take(marks, c[:n], out=mark[:n], mode="clip")
                np.take(moves, c[:n], out=move[:n], mode="clip")
                hh ^= mark[:n]
                pos += move[:n]
        return h, end


def _hash(packed: np.ndarray, q: int) -> np.ndarray:
    return (packed >> np.uint64(_HASH_BITS * q) & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int32)


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of three characters at each byte, where each part begins, word starts, their parts).

    No walk gets from one part into the next.
    """
    gap = b"\0" * (STEPS + _STRIDE)
    buf = np.frombuffer(gap.join([*parts, b""]) or gap, np.uint8)
    c = _CLASS[buf]
    code = c[:-2] << 10 | c[1:-1] << 5 | c[2:]
    begin = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
    blank = buf <= 32
    starts = np.flatnonzero(np.concatenate(([True], blank[:-1])) & ~blank)
    return code, begin, starts, np.searchsorted(begin, starts, "right") - 1


def least_edits(item: str, region: str) -> int:
    """Least edit distance between item and any substring of region (Myers, bit-parallel)."""
    m = len(item)
    if not m:
        return 0
    if item in region:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best = m
    for c in region:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best = score
    return best


def bare(text: str) -> str:
    """A text with a space at either end and for each ASCII character that is neither letter nor digit."""
    return f" {text.translate(_BARE)} "


_BARE = {c: " " for c in range(128) if not chr(c).isalnum()}


class Exact:
    """An item that is looked for at any place, between word borders.

    Of allowed + 1 pieces of the item one at least is in every stretch within the allowed edits.
    """

    def __init__(self, item: str):
        self.item, self.allowed = bare(item), int(MOST_EDITS * len(item))
        n = self.allowed + 1
        edges = [len(self.item) * i // n for i in range(n + 1)]
        self.pieces = [(a, self.item[a:b]) for a, b in zip(edges, edges[1:])]

    def edits(self, text: str) -> int | None:
        """Least edits of a stretch of a bare text, or None if more than allowed."""
        if self.item in text:
            return 0
        if not self.allowed:
            return None
        at = set()
        for a, piece in self.pieces:
            k = text.find(piece)
            while k >= 0:
                at.add(max(0, k - a))
                k = text.find(piece, k + 1)
        best, end = None, 0
        at = sorted(at)
        for i, lo in enumerate(at):
            # stretches that overlap are searched as one
            end = max(end, lo + len(self.item) + self.allowed)
            if i == 0 or lo - self.allowed > last:
                first = max(0, lo - self.allowed)
            last = end
            if i + 1 == len(at) or at[i + 1] - self.allowed > last:
                e = least_edits(self.item, text[first:last])
                best = e if best is None else min(best, e)
        return best if best is not None and best <= self.allowed else None


def edits_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    """least_edits of each (item, region)."""
    out = np.zeros(len(pairs), np.int64)
    n_words = [-(-len(item) // 64) for item, _ in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (n_words[i], len(pairs[i][1])))
    while order:
        w = n_words[order[0]]
        lot = [i for i in order[:VERIFIED] if n_words[i] == w]
        order = order[len(lot) :]
        if w > 32 or len(lot) < 24:
            out[lot] = [least_edits(*pairs[i]) for i in lot]
        else:
            out[lot] = _edits_together([pairs[i] for i in lot], w)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _edits_together(pairs: list[tuple[str, str]], n_words: int) -> np.ndarray:
    """least_edits by Myers' blocks of 64, all pairs a character of their regions at a time."""
    items = list(dict.fromkeys(item for item, _ in pairs))
    letters = np.unique(_points("".join(items)))
    letter = {chr(c): i for i, c in enumerate(letters.tolist())}
    width = len(letter) + 1  # the last for letters of no item, which match nothing, and for what follows a region's end
    eq_of = np.zeros((n_words, len(items) * width), np.uint64)
    for k, item in enumerate(items):
        for i, c in enumerate(item):
            eq_of[i >> 6, k * width + letter[c]] |= np.uint64(1 << (i & 63))
    number = {item: k * width for k, item in enumerate(items)}
    base = np.array([number[item] for item, _ in pairs])
    lengths = np.array([len(r) for _, r in pairs])
    points = _points("".join(r for _, r in pairs))
    place = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    seen = np.full((len(pairs), lengths.max()), len(letters))
    seen[np.arange(lengths.max()) < lengths[:, None]] = np.where(letters[place] == points, place, len(letters))
    seen = np.ascontiguousarray(seen.T) + base
    one, high = np.uint64(1), np.uint64(63)
    size = np.array([len(item) for item, _ in pairs])
    top = ((size - 1) & 63).astype(np.uint64)
    pv, mv = np.full((n_words, len(pairs)), ~np.uint64(0)), np.zeros((n_words, len(pairs)), np.uint64)
    score, best = size.astype(np.int64), size.astype(np.int64)
    zero = np.zeros(len(pairs), np.uint64)
    for at in seen:
        up = down = zero
        for w in range(n_words):
            eq, p, m = eq_of[w].take(at), pv[w], mv[w]
            xv = eq | m
            eq |= down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            if w == n_words - 1:
                score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
            new_up, new_down = ph >> high, mh >> high
            ph, mh = ph << one | up, mh << one | down
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            up, down = new_up, new_down
        np.minimum(best, score, out=best)
    return best


def _heaviest(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in their order, each with its greatest weight; the weight less 1 is in the lowest two bits."""
    keys = np.sort(keys)
    last = np.concatenate((keys[1:] >> 2 != keys[:-1] >> 2, [True]))[: len(keys)]
    return keys[last] >> 2, (keys[last] & 3) + 1


class Index:
    """The windows of a block of items, for each repetition."""

    def __init__(self, items: list[tuple[int, str]], repetitions: int, needs: dict[int, int] | None = None):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.plain = [t.decode() for _, t in self.items]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.allowed = (MOST_EDITS * self.size).astype(np.int64)
        code, begin, starts, owner = _laid_out([t for _, t in self.items])
        self.owner, self.at = owner, starts - begin[owner] if len(starts) else starts
        self.word = np.minimum(np.arange(len(starts)) - np.searchsorted(owner, owner), (1 << _WORD_BITS) - 1)
        self.walks = [Walk(seed) for seed in range(-(-repetitions // 3))]
        self.tables, fits = [], np.full(len(self.items), len(starts))
        for r in range(repetitions):
            if r % 3 == 0:
                packed, end = self.walks[r // 3].hashes(code, starts)
                inside = np.flatnonzero(end <= begin[owner] + self.size[owner]) if len(starts) else starts
                fits = np.minimum(fits, np.bincount(owner[inside], minlength=len(self.items)))
            h = _hash(packed[inside], r % 3)
            order = np.argsort(h, kind="stable")
            filter_ = np.zeros(1 << _FILTER_BITS, bool)
            filter_[h >> (_HASH_BITS - _FILTER_BITS)] = True
            slot = np.searchsorted(h[order] >> (_HASH_BITS - _FILTER_BITS), np.arange((1 << _FILTER_BITS) + 1)).astype(np.int32)
            _, inverse, n_same = np.unique(h[order], return_inverse=True, return_counts=True)
            rare = _WEIGHTS[np.minimum(n_same, len(_WEIGHTS) - 1)][inverse] if len(order) else order
            self.tables.append((filter_, slot, h[order], inside[order].astype(np.int32), rare))
        self.short = {k: Exact(t) for k, t in enumerate(self.plain) if len(t) < SHORT or fits[k] < FEW}
        self.class_ = np.searchsorted(CLASSES, fits, "right") - 1
        self.need = np.array([(needs or {}).get(int(c), LEAST) for c in self.class_], np.int64)
        self.need[list(self.short)] = 1 << 40
        # a stretch with a leak is whole in one of two neighbouring segments
        self.overlap = int(self.size.max(initial=0) * (1 + 2 * MOST_EDITS)) + 2 * DRIFT
        self.segment = max(SEGMENT, 4 * self.overlap)

    def _segments(self, text: bytes) -> Iterator[bytes]:
        a = 0
        while len(text) - a > self.segment:
            b = max(text.rfind(b" ", a + self.segment // 2, a + self.segment), a + self.segment // 2)
            yield text[a:b]
            a = max(text.rfind(b" ", a + self.segment // 8, b - self.overlap) + 1, a + self.segment // 8)
        yield text[a:] if a else text

    def places(self, parts: list[bytes], need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, item, slot, weight of the item's words that share a hash at the slot's shifts) where that is the item's need or more.

        A slot is DRIFT wide and begins at a multiple of half of that.
        """
        code, begin, starts, part = _laid_out(parts)
        rel, keys = starts - begin[part] if len(starts) else starts, [np.empty(0, np.int64)]
        for r, (filter_, slot, hs, window, rare) in enumerate(self.tables):
            if r % 3 == 0:
                packed, _ = self.walks[r // 3].hashes(code, starts)
            h = _hash(packed, r % 3)
            s = h >> (_HASH_BITS - _FILTER_BITS)
            hit = np.flatnonzero(filter_.take(s, mode="clip"))
            s = s[hit]
            lo = slot.take(s, mode="clip")
            n = slot.take(s + 1, mode="clip") - lo
            q = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = np.repeat(hit, n)
            same = hs.take(q, mode="clip") == h.take(p, mode="clip")
            q, p = q[same], p[same]
            q, weight = window[q], rare[q]
            shift = rel[p] - self.at[q] + (1 << _SHIFT_BITS - 1)
            key = ((part[p] << _ITEM_BITS | self.owner[q]) << _SHIFT_BITS | shift) << _WORD_BITS | self.word[q]
            keys.append(key << 2 | weight)
        key, weight = _heaviest(np.concatenate(keys))
        item = key >> (_SHIFT_BITS + _WORD_BITS) & ((1 << _ITEM_BITS) - 1)
        # the weight from each hit on, a bound on that of its words; shifts keep a margin at both ends, so the sum stays in the pair
        end = np.searchsorted(key, key + ((DRIFT + 1) << _WORD_BITS), "left")
        total = np.concatenate(([0], np.cumsum(weight)))
        hot = np.flatnonzero(total[end] - total[:-1] >= need[item])
        mark = np.bincount(hot, minlength=len(key) + 1) - np.bincount(end[hot], minlength=len(key) + 1)
        hot = np.cumsum(mark)[:-1] > 0
        key, weight = key[hot], weight[hot] - 1
        slot, word = key // (DRIFT // 2 << _WORD_BITS), key & ((1 << _WORD_BITS) - 1)  # part, item and half slot
        both, weight = _heaviest(np.concatenate([(s << _WORD_BITS | word) << 2 | weight for s in (slot, slot - 1)]))
        slot, first = np.unique(both >> _WORD_BITS, return_index=True)
        count = np.add.reduceat(weight, first) if len(first) else first
        pair = slot // ((1 << _SHIFT_BITS) // (DRIFT // 2))
        item = pair & ((1 << _ITEM_BITS) - 1)
        hot = count >= need[item]
        # of neighbouring slots the best stands for all; its region has room for the others
        same = (slot[1:] == slot[:-1] + 1) & (pair[1:] == pair[:-1])
        hot[1:] &= ~same | (count[1:] > count[:-1])
        hot[:-1] &= ~same | (count[:-1] >= count[1:])
        slot, pair, item = slot[hot], pair[hot], item[hot]
        return pair >> _ITEM_BITS, item, slot * (DRIFT // 2) - (pair << _SHIFT_BITS) - (1 << _SHIFT_BITS - 1), count[hot]

    def _tries(self, parts: list[tuple[int, bytes]]) -> list[tuple[int, int, str]]:
        """(number of the text, item, region) of the candidates."""
        out = []
        for p, k, a, _ in zip(*(x.tolist() for x in self.places([t for _, t in parts], self.need))):
            number, text = parts[p]
            room = int(self.allowed[k]) + DRIFT // 2
            out.append((number, k, text[max(0, a - room) : max(0, a + DRIFT + int(self.size[k]) + room)].decode(errors="ignore")))
        return out

    def search(self, texts: Iterable[bytes]) -> list[tuple[int, int, int]]:
        """(number of the text, item id, edits) of each leak."""
        found: dict[tuple[int, int], int] = {}
        parts, size, tries = [], 0, []

        def note(number: int, k: int, edits: int) -> None:
            found[number, k] = min(edits, found.get((number, k), edits))

        def verify() -> None:
            for (number, k, _), e in zip(tries, edits_of([(self.plain[k], region) for _, k, region in tries]).tolist()):
                if e <= int(MOST_EDITS * len(self.plain[k])):
                    note(number, k, e)
            tries.clear()

        for i, text in enumerate(texts):
            for t in self._segments(text):
                parts.append((i, t))
                size += len(t) + STEPS
                if size >= CHUNK or len(parts) >= TEXTS:
                    tries += self._tries(parts)
                    parts, size = [], 0
                    if len(tries) >= VERIFIED:
                        verify()
                if self.short:
                    shown = bare(t.decode(errors="ignore"))
                    for k, x in self.short.items():
                        if (e := x.edits(shown)) is not None:
                            note(i, k, e)
        if parts:
            tries += self._tries(parts)
        verify()
        return [(i, self.items[k][0], e) for (i, k), e in sorted(found.items())]


def edited(text: str, edits: float, rng: random.Random, even: bool) -> bytes:
    """The text with edits of that share of its length: random ones at random places, or if even substitutions at equal distances."""
    chars, letters = list(normal(text).decode()), "abcdefghijklmnopqrstuvwxyz "
    n, size = int(edits * len(chars)), len(chars)
    for e in range(n):
        k, c = rng.randrange(len(chars)), rng.choice(letters)
        kind = 0 if even else rng.randrange(3)
        if even:
            k = (2 * e + 1) * size // (2 * n)
        if kind == 0:
            chars[k] = c
        elif kind == 1:
            chars.insert(k, c)
        elif len(chars) > 1:
            del chars[k]
    return b"x " * rng.randrange(9) + normal("".join(chars)) + b" tail"


def measured_recall(
    items: list[str], repetitions: int, edits: float = MOST_EDITS, seed: int = 5, even: bool = False, needs: dict[int, int] | None = None
) -> float:
    """Share of items that are found in copies with edits of that share of their length."""
    rng, index = random.Random(seed), Index(list(enumerate(items)), repetitions, needs)
    tried = [i for i, t in enumerate(items) if normal(t)]
    found = {(n, item) for n, item, _ in index.search([edited(items[i], edits, rng, even) for i in tried])}
    return sum((n, i) in found for n, i in enumerate(tried)) / len(tried) if tried else 1.0


def settings_for(items: list[str], recall: float = RECALL) -> tuple[int, dict[int, int]]:
    """(repetitions, need of each class): the first number of repetitions with the recall under random and under even edits.

    Measured on MEASURED copies of items of each class that the hashes serve, the fewer items the more copies of each;
    the exact search needs no repetitions.
    """
    probe = Index(list(enumerate(items)), 1)
    some: list[str] = []
    for c in range(len(CLASSES)):
        served = sorted((t for k, t in enumerate(probe.plain) if k not in probe.short and probe.class_[k] == c), key=lambda t: (len(t), t))
        some += [served[i * len(served) // MEASURED] for i in range(MEASURED) if served]
    if not some:
        return 1, {}
    rng, copies_of = random.Random(5), some
    some = list(dict.fromkeys(some))
    of = [some.index(t) for t in copies_of]
    copies = [[edited(t, MOST_EDITS, rng, even) for t in copies_of] for even in (False, True)]
    needs: dict[int, int] = {}
    for r in (t for t in TRIED if t <= MOST_REPETITIONS):
        index, least, enough, needs = Index(list(enumerate(some)), r), 1.0, True, {}
        for texts in copies:
            most = np.zeros(len(texts), np.int64)
            for a in range(0, len(texts), TEXTS):
                part, item, _, count = index.places(texts[a : a + TEXTS], np.ones(len(some), np.int64))
                own = item == np.array(of)[a + part]
                np.maximum.at(most, a + part[own], count[own])
            least = min(least, float((most >= LEAST).mean()))
            for c in np.unique(index.class_[of]).tolist():
                got = np.sort(most[index.class_[of] == c])
                enough &= float((got >= LEAST).mean()) >= min(recall, CLASS_RECALL)
                needs[c] = min(needs.get(c, 1 << 30), max(LEAST, int(got[int((1 - CALIBRATED) * len(got))])))
        if least >= recall and enough:
            return r, needs
    warnings.warn(f"{r} repetitions find {least:.0%} of the leaks with {MOST_EDITS:.0%} edits, not {recall:.0%}", stacklevel=2)
    return r, needs


def repetitions_for(items: list[str], recall: float = RECALL) -> int:
    return settings_for(items, recall)[0]


_Block = tuple[str, list[tuple[int, str]], int, dict[int, int]]


def _blocks(benchmark: DataFrame) -> Iterator[_Block]:
    """(name, items, repetitions, needs) of each block; an item's block is the hash of its id and text."""
    texts = benchmark.where("text is not null").select("item_id", "text").dropDuplicates()
    n_blocks = -(-texts.count() // BLOCK)
    for block in range(n_blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        # about BLOCK rows: the block's size is the bound
        items = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, *x))
        yield uuid.uuid4().hex, items, *settings_for([t for _, t in items])


_built: dict[str, Index] = {}


def _index(block: _Block) -> Index:
    """The block's index; a worker that runs several tasks builds it once."""
    name, *rest = block
    if name not in _built:
        _built.clear()
        _built[name] = Index(*rest)
    return _built[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits), one row for each document and item that leaked into it."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, edits int"
    arrow = (to_arrow_type(kind), to_arrow_type(item_kind), pa.int32())
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for b in batches:
                found = index.search(normal(t.as_py()) for t in b.column(1))
                cols = [[b.column(0)[r].as_py() for r, _, _ in found], [k for _, k, _ in found], [e for _, _, e in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, arrow)], ["doc_id", "item_id", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.limit(0).selectExpr("doc_id", f"cast(null as {item_kind.simpleString()}) as item_id", "0 as edits") if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that an item leaked into."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, _, _ in index.search(normal(t.as_py()) for t in b.column(at))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
