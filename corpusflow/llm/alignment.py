"""Sentence alignment in documents of two languages (problem 3).

Numbers, names and cognates that both sides share are anchors; a longest increasing subsequence of them, by weight, is the chain on
which both sides keep their order, and local dynamic programming aligns the sentences in the gaps, with omissions and merges. What
stands off the chain is paired afterwards, so that moved sentences find each other. The first round knows anchors and lengths only;
its pairs give counts of words that go together in each pair of languages, over all units, and the second round adds those words to
the evidence. A unit is aligned by one task; between the rounds everything is joins and counts.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.language import ROMAN
from corpusflow.llm.lookalike import Canonical, fit_bigrams, own_script
from corpusflow.session import cut_lineage, table

#: A pair of sentences scores by how far its agreement lies above this; merged sentences pay MERGE each; leftovers need LOOSE,
#: and each sentence of several in a bead must be covered as far as PART.
FLOOR, MERGE, LOOSE, PART = 0.3, 0.06, 0.5, 0.5
#: Words that go together: at least so often, with at least this Dice coefficient, and at least this share of the best one of either
#: word. Words in more than COMMON of the sentences of their language are hardly evidence.
OFTEN, DICE, NEAR, COMMON = 2, 0.2, 0.5, 0.2
#: The weight of a number, which says more than a word; that of a word that the other language is not known to have a word for; and the
#: share of such words from which the lengths of two sentences count as well.
NUMBER, UNKNOWN, STRANGE = 2.0, 0.4, 0.3
#: Sentences of a unit that one task aligns; longer units are cut into sections, with MARGIN of a section more of the target.
LONG, MARGIN = 2000, 0.15
#: Anchors that place the sections' borders stand in so many sentences of either side at most.
RARE = 4
#: A sentence of which a counterpart is still wanted joins a pair that stands so near, where the words left cover it so far.
NEXT, REST = 2, 0.55
#: About so many sentences of either side that no section paired meet in one task.
BLOCK = 5000
#: Sentences a side that make a bead, and pairs of sentences whose gains are worked out at a time.
BEADS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
CELLS = 1 << 16
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_ALIKE = str.maketrans({"y": "i", "j": "i", "w": "v", "q": "k", "c": "k", "z": "s", "x": "s"})


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


@lru_cache(maxsize=200_000)
def roman(word: str) -> str:
    """A word in plain Latin letters, spellings of one sound as one letter: equal for a name in any of the languages."""
    w = "".join(ROMAN.get(c, c) for c in word)
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).translate(_ALIKE).replace("'", "")
    return re.sub(r"(.)\1", r"\1", w)


def anchor(word: str, names: set[str]) -> str:
    """A number, or a word that may be a name or cognate, in a form that does not depend on the language; empty for a short word."""
    if word[0].isdigit():
        return re.sub(r"\D", "", word)
    if len(word) < 3:
        return ""
    r = roman(word)
    return r if word in names else r[:5] + "*"


def anchors(words: list[str], names: set[str]) -> set[str]:
    return {anchor(w, names) for w in words} - {""}


def names_of(texts: list[str]) -> set[str]:
    """Words that are capital wherever they do not begin a sentence."""
    inside, small = set(), set()
    for t in texts:
        found = _TOKEN.findall(unicodedata.normalize("NFKC", t))
        small |= {w for w in found if w[0].islower()}
        inside |= {w for w in found if w[0].isupper()}
    return {w.lower() for w in inside} - small


class Unit:
    """The sentences of one unit and the agreement of every part of it."""

    def __init__(self, source: list[str], target: list[str], lexicon: dict[str, dict[str, float]] | None = None, common: tuple[set[str], set[str]] = (frozenset(), frozenset())):
        self.words = [[tokens(t) for t in side] for side in (source, target)]
        names = names_of(source) | names_of(target)
        self.keys = {w: anchor(w, names) for side in self.words for words in side for w in words}
        forms = [[{self.keys[w] for w in words} - {""} for words in side] for side in self.words]
        seen = [Counter(a for s in side for a in s) for side in forms]
        shared = set(seen[0]) & set(seen[1])
        self.anchored = [[s & shared for s in side] for side in forms]
        self.rarity = {a: 1.0 / math.sqrt(seen[0][a] * seen[1][a]) for a in shared}
        self.size = [[max(1, sum(map(len, w))) for w in side] for side in self.words]
        total = [max(1, sum(s)) for s in self.size]
        self.ratio = total[1] / total[0]
        self.lexicon = lexicon
        self.cells: dict[tuple[int, int], tuple[dict[str, float], dict[str, float]]] = {}
        self.common = common
        shown = {w for words in self.words[0] for w in words if w in names or w[0].isdigit()}
        self.strange = {w for words in self.words[0] for w in words if w not in lexicon} - shown if lexicon is not None else frozenset()
        self._link(names)
        self._measure()

    def _link(self, names: set[str]) -> None:
        """For every pair of sentences with anything in common: the best score of each word on either side."""
        by_word: dict[str, list[int]] = defaultdict(list)
        by_anchor: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for j, words in enumerate(self.words[1]):
            for w in set(words):
                by_word[w].append(j)
                if k := self.keys[w]:
                    by_anchor[k].append((j, w))
        for i, words in enumerate(self.words[0]):
            for w in set(words):
                for j, v in by_anchor.get(self.keys[w], ()):
                    score = 1.0 if (w[0].isdigit() or w in names) else 0.6
                    self._cell(i, j, w, v, score)
                for v, score in (self.lexicon or {}).get(w, {}).items():
                    for j in by_word.get(v, ()):
                        self._cell(i, j, w, v, score)

    def _cell(self, i: int, j: int, w: str, v: str, score: float) -> None:
        a, b = self.cells.setdefault((i, j), ({}, {}))
        a[w] = max(a.get(w, 0.0), score)
        b[v] = max(b.get(v, 0.0), score)

    def _weight(self, side: int, w: str) -> float:
        if w in self.common[side] or (len(w) < 3 and not w[0].isdigit()):
            return 0.15
        if w[0].isdigit():
            return NUMBER
        return UNKNOWN if side == 0 and w in self.strange else 1.0

    def _measure(self) -> None:
        """For every cell: how far either sentence is covered by the other; and of what share of a sentence nothing is known."""
        self.unknown = []
        for words in self.words[0]:
            own = [w for w in set(words) if self._weight(0, w) != 0.15]
            self.unknown.append(sum(w in self.strange for w in own) / len(own) if own else 0.0)
        self.total = [[sum(self._weight(side, w) for w in set(words)) for words in self.words[side]] for side in (0, 1)]
        self.cover = {}
        for (i, j), cell in self.cells.items():
            a, b = (sum(self._weight(side, w) * math.sqrt(s) for w, s in cell[side].items()) for side in (0, 1))
            self.cover[i, j] = (a / self.total[0][i] if self.total[0][i] else 0.0, b / self.total[1][j] if self.total[1][j] else 0.0)

    def one(self, i: int, j: int) -> float:
        """Agreement of two sentences: the share of the words of both that have a counterpart."""
        c = self.cover.get((i, j))
        if not c:
            return 0.0
        a, b = self.total[0][i], self.total[1][j]
        return (c[0] * a + c[1] * b) / (a + b)

    def agreement(self, rows: range, cols: range) -> float:
        """Share of the words of both sides that have a counterpart on the other."""
        if len(rows) == len(cols) == 1:
            return self.one(rows[0], cols[0])
        got = sum(self.covered(0, i, cols) * self.total[0][i] for i in rows) + sum(self.covered(1, j, rows) * self.total[1][j] for j in cols)
        full = sum(self.total[0][i] for i in rows) + sum(self.total[1][j] for j in cols)
        return got / full if full else 0.0

    def parts_covered(self, rows: range, cols: range) -> bool:
        """Whether every sentence of a side with several is covered far enough."""
        for side, own, other in ((0, rows, cols), (1, cols, rows)):
            if len(own) > 1:
                for x in own:
                    ceiling = sum(self.cover.get((x, y) if side == 0 else (y, x), (0.0, 0.0))[side] for y in other)
                    if ceiling < PART or len(other) > 1 and self.covered(side, x, other) < PART:
                        return False
        return True

    def covered(self, side: int, x: int, others: range, without: dict[int, tuple[int, ...]] | None = None) -> float:
        """Share of one sentence's words with a counterpart in ``others``; words of those that ``without`` holds already don't count."""
        if len(others) == 1 and not without:
            return self.cover.get((x, others[0]) if side == 0 else (others[0], x), (0.0, 0.0))[side]
        best: dict[str, float] = {}
        for y in others:
            cell = self.cells.get((x, y) if side == 0 else (y, x))
            if cell:
                taken = [c[1 - side] for z in (without or {}).get(y, ()) if (c := self.cells.get((z, y) if side == 0 else (y, z)))]
                if taken and sum(1 for v in cell[1 - side] if not any(v in t for t in taken)) * 2 < len(cell[1 - side]):
                    continue
                for w, s in cell[side].items():
                    best[w] = max(best.get(w, 0.0), s)
        got = sum(self._weight(side, w) * math.sqrt(s) for w, s in best.items())
        return got / self.total[side][x] if self.total[side][x] else 0.0

    def length_fit(self, rows: range, cols: range) -> float:
        """1 for sides of the expected lengths, falling to 0 as one grows against the other."""
        a, b = sum(self.size[0][i] for i in rows) * self.ratio, sum(self.size[1][j] for j in cols)
        return math.exp(-abs(math.log(b / a)) * 1.5)

    def score(self, rows: range, cols: range) -> float:
        s = self.agreement(rows, cols)
        share = sum(self.unknown[i] for i in rows) / len(rows) if self.lexicon is not None else 1.0
        return s if share < STRANGE else s * (1 - share / 2) + self.length_fit(rows, cols) * share / 2


def longest_chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The heaviest chain of points that increases on both sides."""
    points = sorted(points, key=lambda p: (p[0], -p[1]))
    cols = sorted({p[1] for p in points})
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(cols) + 1)
    best, back = [], []
    for k, (_, j, w) in enumerate(points):
        c = bisect.bisect_left(cols, j)
        top, x = (0.0, -1), c
        while x > 0:
            top = max(top, tree[x])
            x -= x & -x
        best.append(top[0] + w)
        back.append(top[1])
        x = c + 1
        while x <= len(cols):
            tree[x] = max(tree[x], (best[k], k))
            x += x & -x
    k = max(range(len(points)), key=lambda q: best[q]) if points else -1
    out = []
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def anchor_points(unit: Unit) -> list[tuple[int, int, float]]:
    """Pairs of sentences that are each other's best by shared anchors and words, and clearly so."""
    weight: dict[tuple[int, int], float] = {}
    for i, j in unit.cells:
        s = unit.one(i, j)
        rare = sum(unit.rarity[a] for a in unit.anchored[0][i] & unit.anchored[1][j])
        weight[i, j] = s + 0.5 * min(1.0, rare)
    best_row, best_col = {}, {}
    for (i, j), w in sorted(weight.items()):
        if w > best_row.get(i, (0.0, -1))[0]:
            best_row[i] = (w, j)
        if w > best_col.get(j, (0.0, -1))[0]:
            best_col[j] = (w, i)
    need = 0.6 if unit.lexicon is not None else 0.5
    return [(i, j, w) for i, (w, j) in best_row.items() if best_col[j][1] == i and w >= need]


def _lengths(size: list[int], width: int, ratio: float = 1.0) -> np.ndarray:
    """Logarithms of the lengths of ``width`` neighbours, by the last of them; the first ones have no such neighbours."""
    total = np.convolve(np.array(size, float), np.ones(width))[: len(size)] * ratio
    return np.log(np.maximum(total, 1e-9))


class _Gains:
    """What every bead that ends at a pair of sentences of a gap is worth, if anything: for some rows at a time, as the gap may be long."""

    def __init__(self, unit: Unit, i0: int, i1: int, j0: int, j1: int):
        self.unit, self.i0, self.j0, self.n, self.m = unit, i0, j0, i1 - i0, j1 - j0
        self.total = [np.array(unit.total[0][i0:i1]), np.array(unit.total[1][j0:j1])]
        self.sizes = [unit.size[0][i0:i1], unit.size[1][j0:j1]]
        self.unknown = np.array(unit.unknown[i0:i1])
        self.by_row: dict[int, list[tuple[int, float, float]]] = defaultdict(list)
        for (i, j), (a, b) in unit.cover.items():
            if i0 <= i < i1 and j0 <= j < j1:
                self.by_row[i - i0].append((j - j0, a, b))

    def _fit(self, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.exp(-1.5 * np.abs(_lengths(self.sizes[1], b)[None, :] - _lengths(self.sizes[0], a, self.unit.ratio)[rows][:, None]))

    def block(self, lo: int, hi: int) -> tuple[list[list[float]], dict[tuple[int, int], list[tuple[int, int, float]]]]:
        """Of rows [lo, hi): the gain of each plain pair, and the other beads by their last pair, in the order of BEADS."""
        unit, above = self.unit, min(lo, 2)
        covers = np.zeros((2, hi - lo + above, self.m))
        known = np.zeros((hi - lo, self.m), bool)
        for i in range(lo - above, hi):
            for j, a, b in self.by_row.get(i, ()):
                covers[:, i - lo + above, j] = a, b
                if i >= lo:
                    known[i - lo, j] = True
        t0, t1, rows = self.total[0][lo:hi, None], self.total[1][None, :], np.arange(lo, hi)
        c0, c1 = covers[:, above:]
        agree = (c0 * t0 + c1 * t1) / np.maximum(t0 + t1, 1e-12)
        share = self.unknown[lo:hi, None] if unit.lexicon is not None else np.ones((hi - lo, 1))
        score = np.where(share < STRANGE, agree, agree * (1 - share / 2) + self._fit(rows, 1, 1) * share / 2)
        plain = score - FLOOR
        if unit.lexicon is not None:
            plain[~(known | (share >= STRANGE))] = 0.0
        return plain.tolist(), self._merged(covers, lo, hi, above) if unit.lexicon is not None else self._first(covers, lo, hi, above)

    def _first(self, covers: np.ndarray, lo: int, hi: int, above: int) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
        """The first round knows anchors and lengths only, and needs the plain beads: one to two and two to one."""
        t0, t1, rows = self.total[0], self.total[1], np.arange(lo, hi)
        out: dict[tuple[int, int], list[tuple[int, int, float]]] = defaultdict(list)
        c0, c1 = covers[:, above:]
        if self.m > 1:
            both = (c0[:, 1:] > 0) & (c0[:, :-1] > 0)
            one = c0[:, 1:] + c0[:, :-1]
            for r, j in np.argwhere(both).tolist():
                one[r, j] = self.unit.covered(0, self.i0 + lo + r, range(self.j0 + j, self.j0 + j + 2))
            full = t0[lo:hi, None] + t1[None, 1:] + t1[None, :-1]
            agree = (one * t0[lo:hi, None] + c1[:, 1:] * t1[None, 1:] + c1[:, :-1] * t1[None, :-1]) / np.maximum(full, 1e-12)
            gain = ((agree + self._fit(rows, 1, 2)[:, 1:]) / 2 - FLOOR) * 1.5 - MERGE
            for r, j in np.argwhere(gain > 0).tolist():
                out[lo + r, j + 1].append((1, 2, float(gain[r, j])))
        if hi > 1:
            first = 1 if lo == 0 else 0  # the first row of all has none before it
            here, up = covers[:, above + first :], covers[:, above + first - 1 : above + hi - lo - 1]
            both = (here[1] > 0) & (up[1] > 0)
            one = here[1] + up[1]
            for r, j in np.argwhere(both).tolist():
                i = self.i0 + lo + first + r
                one[r, j] = self.unit.covered(1, self.j0 + j, range(i - 1, i + 1))
            ta, tb = t0[lo + first : hi, None], t0[lo + first - 1 : hi - 1, None]
            agree = (here[0] * ta + up[0] * tb + one * t1[None, :]) / np.maximum(ta + tb + t1[None, :], 1e-12)
            gain = ((agree + self._fit(rows[first:], 2, 1)) / 2 - FLOOR) * 1.5 - MERGE
            for r, j in np.argwhere(gain > 0).tolist():
                out[lo + first + r, j].append((2, 1, float(gain[r, j])))
        return out

    def _merged(self, covers: np.ndarray, lo: int, hi: int, above: int) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
        """Beads of several sentences of which each is covered far enough: few, so each is scored by itself."""
        out: dict[tuple[int, int], list[tuple[int, int, float]]] = defaultdict(list)
        strong = covers >= PART
        for a, b in BEADS[1:]:
            for r in range(max(0, a - 1 - lo), hi - lo):
                top = r + above
                if a == 1:
                    ok = np.logical_and.reduce([strong[1, top, b - 1 - k : self.m - k] for k in range(b)]) if self.m >= b else np.zeros(0, bool)
                elif b == 1:
                    ok = np.logical_and.reduce([strong[0, top - k] for k in range(a)])
                else:
                    own = [covers[0, top - k, 1:] + covers[0, top - k, :-1] >= PART for k in range(2)]
                    other = covers[1, top] + covers[1, top - 1] >= PART
                    ok = own[0] & own[1] & other[1:] & other[:-1]
                for j in (np.flatnonzero(ok) + b - 1).tolist():
                    i = self.i0 + lo + r
                    rows, cols = range(i - a + 1, i + 1), range(self.j0 + j - b + 1, self.j0 + j + 1)
                    if self.unit.parts_covered(rows, cols):
                        gain = (self.unit.score(rows, cols) - FLOOR) * (a + b) / 2 - MERGE * (a + b - 2)
                        if gain > 0:
                            out[lo + r, j].append((a, b, gain))
        return out


def _gap(unit: Unit, i0: int, i1: int, j0: int, j1: int) -> list[tuple[range, range, float]]:
    """Best beads of the sentences [i0, i1) and [j0, j1); sentences left out cost nothing. Of the scores the last rows are held only, and
    of every place one byte that tells the way back."""
    n, m = i1 - i0, j1 - j0
    if not n or not m:
        return []
    gains, height = _Gains(unit, i0, i1, j0, j1), max(1, CELLS // max(m, 1))
    codes = [(1, 0), (0, 1), *BEADS]
    back = [bytearray([0, *[1] * m])]
    last = [[0.0] * (m + 1)]  # the scores of the row before, and of those before it
    for lo in range(0, n, height):
        plain, others = gains.block(lo, min(n, lo + height))
        for r, row in enumerate(plain):
            i, before = lo + r, last[0]
            here, way = [before[0]], bytearray(m + 1)
            for j in range(m):
                top, code = before[j + 1], 0
                if here[j] > top:
                    top, code = here[j], 1
                g = row[j]
                if g > 0 and before[j] + g > top:
                    top, code = before[j] + g, 2
                if (i, j) in others:
                    for a, b, g in others[i, j]:
                        x = last[a - 1][j + 1 - b] + g
                        if x > top:
                            top, code = x, codes.index((a, b), 2)
                here.append(top)
                way[j + 1] = code
            back.append(way)
            last = [here, *last[:2]]
    out, i, j = [], n, m
    while i or j:
        code = back[i][j]
        a, b = codes[code]
        if code >= 2:
            rows, cols = range(i0 + i - a, i0 + i), range(j0 + j - b, j0 + j)
            out.append((rows, cols, unit.score(rows, cols)))
        i, j = i - a, j - b
    return out[::-1]


def align(unit: Unit) -> list[tuple[int, int, float]]:
    """Pairs of sentences with their agreement."""
    n, m = len(unit.words[0]), len(unit.words[1])
    if not n or not m:
        return []
    points = anchor_points(unit)
    chain = longest_chain(points)
    beads: list[tuple[range, range, float]] = []
    # The points split the unit; around each, its neighbours may join it, so a gap reaches over the points at its ends.
    pi, pj = 0, 0
    for i, j, _ in [*chain[8::8], (n, m, 0.0)]:
        beads += _gap(unit, pi, i, pj, j)
        pi, pj = i, j
    pairs: dict[tuple[int, int], float] = {}
    used = (set(), set())
    for rows, cols, s in beads:
        used[0].update(rows), used[1].update(cols)
        one = {(x, y): unit.one(x, y) for x in rows for y in cols}
        for (x, y), v in one.items():
            # In a bead of several to several, a pair with nothing in common is none.
            if len(rows) == 1 or len(cols) == 1 or v >= max(w for (p, q), w in one.items() if p == x or q == y) - 1e-9:
                pairs[x, y] = s if len(one) == 1 else v
    _leftovers(unit, pairs, used)
    return [(i, j, s) for (i, j), s in sorted(pairs.items())]


def _leftovers(unit: Unit, pairs: dict[tuple[int, int], float], used: tuple[set[int], set[int]]) -> None:
    """Pair what the gaps left: moved sentences with each other, then parts of sentences that are paired already."""
    one = lambda x: range(x, x + 1)
    free = [(i, j) for i, j in unit.cells if i not in used[0] and j not in used[1]]
    scored = sorted(((max(unit.one(i, j), 0.75 * max(unit.covered(0, i, one(j)), unit.covered(1, j, one(i)))), i, j) for i, j in free), reverse=True)
    for s, i, j in scored:
        if s >= LOOSE and i not in used[0] and j not in used[1]:
            pairs[i, j] = s
            used[0].add(i), used[1].add(j)
    if unit.lexicon is None:
        return
    held: tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]] = ({}, {})
    for i, j in pairs:
        held[0][i] = (*held[0].get(i, ()), j)
        held[1][j] = (*held[1].get(j, ()), i)
    for side in (1, 0):
        rest = sorted({c[side] for c in unit.cells} - used[side])
        for x in rest:
            options = []
            for y in sorted({c[1 - side] for c in unit.cells if c[side] == x}):
                near = min((abs(x - z) for z in held[1 - side].get(y, ())), default=99)
                s = unit.covered(side, x, one(y), {y: held[1 - side].get(y, ())})
                if near <= NEXT and s >= REST:
                    options.append((s, -near, y))
            if options:
                s, _, y = max(options)
                pairs[(y, x) if side == 1 else (x, y)] = s
                used[side].add(x)


_SIDE = "array<struct<id: bigint, text: string>>"
_PAIRS = "array<struct<a: bigint, b: bigint, score: double>>"
_UNIT = f"b string, u string, sec int, ls string, lt string, src {_SIDE}, tgt {_SIDE}"


def section_borders(n: int, m: int, points: list[tuple[int, int, float]], most: int) -> list[tuple[int, int, int, int]]:
    """Sections of a unit with ``n`` source and ``m`` target sentences, counted from 1: half-open ranges of either side.

    Borders are points of the heaviest chain, so a section begins and ends at the same place on both sides however far they drift. Only
    a stretch of more than ``most`` sentences of both sides without any point is divided evenly.
    """
    out, at, last = [], (1, 1), (1, 1)
    for p in [*((i, j) for i, j, _ in longest_chain(points)), (n + 1, m + 1)]:
        if max(p[0] - at[0], p[1] - at[1]) > most and last[0] > at[0]:
            out.append((at[0], last[0], at[1], last[1]))
            at = last
        if (g := p[0] - at[0]) > most:
            k, h = math.ceil(g / most), p[1] - at[1]
            for x in range(k):
                low, high = (at[1] + h * x // k, at[1] + h * (x + 1) // k) if h > most else (at[1], p[1])
                out.append((at[0] + g * x // k, at[0] + g * (x + 1) // k, low, high))
            at = p
        last = p
    return out if at[0] > n else [*out, (at[0], n + 1, at[1], m + 1)]


def _unit_key(b: str = "b", u: str = "u") -> Column:
    """Book and unit, nulls told from texts, as one value that joins."""
    return F.to_json(F.struct(F.col(b).alias("b"), F.col(u).alias("u")))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = [(r.g, r.side, r.pos, k) for r in frame.itertuples() for k in anchors(tokens(r.text), set())]
        yield pd.DataFrame(rows, columns=["g", "side", "pos", "k"])


def _sections(long: DataFrame) -> DataFrame:
    """``g, cuts``: the sections of long units, from ``g, side, pos, text, n, m``. What meets in one task are places of rare anchors."""
    keys = long.select("g", "side", "pos", "text").mapInPandas(_keys, "g string, side string, pos long, k string").distinct()
    count = [F.count(F.when(F.col("side") == x, 1)).alias(f"n_{x}") for x in ("source", "target")]
    rare = keys.groupBy("g", "k").agg(*count).where(f"n_source BETWEEN 1 AND {RARE} AND n_target BETWEEN 1 AND {RARE}")
    here = keys.join(rare, ["g", "k"])
    left = here.where("side = 'source'").select("g", "k", F.col("pos").alias("i"), (1 / F.sqrt(F.col("n_source") * F.col("n_target"))).alias("w"))
    right = here.where("side = 'target'").select("g", "k", F.col("pos").alias("j"))
    points = left.join(right, ["g", "k"]).groupBy("g", "i", "j").agg(F.sum("w").alias("w"))
    most = LONG
    ends = long.groupBy("g").agg(F.max("n").alias("n"), F.max("m").alias("m"))

    def cut(key: tuple, ends: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = section_borders(int(ends["n"][0]), int(ends["m"][0]), [(int(i), int(j), float(w)) for i, j, w in zip(points["i"], points["j"], points["w"])], most)
        return pd.DataFrame({"g": [key[0]], "cuts": [[{"sec": k, "i0": a, "i1": b, "j0": c, "j1": d} for k, (a, b, c, d) in enumerate(found)]]})

    return ends.groupBy("g").cogroup(points.groupBy("g")).applyInPandas(cut, "g string, cuts array<struct<sec: int, i0: long, i1: long, j0: long, j1: long>>")


def bilingual_units(sentences: DataFrame, group: str, unit: str, sent_id: str, side: str, pos: str, lang: str, text: str) -> DataFrame:
    """One row for each unit, or section of a long one: both sides in order, with the language of most sentences of each."""
    rows = sentences.where(F.col(side).isin("source", "target") & F.col(text).isNotNull() & F.col(sent_id).isNotNull()).select(
        F.col(group).alias("b"), F.col(unit).alias("u"), F.col(side).alias("side"), F.struct(F.col(pos).alias("pos"), F.col(sent_id).cast("long").alias("id"), F.col(lang).alias("lang"), F.trim(F.col(text)).alias("text")).alias("s")
    )
    of = lambda x: F.transform(F.array_sort(F.transform(F.filter("all", lambda r: r["side"] == x), lambda r: r["s"])), lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text")))
    langs = lambda x: F.mode(F.when(F.col("side") == x, F.col("s.lang")), True)
    ends = [F.max(F.when(F.col("side") == x, F.col("s.pos"))).alias(x) for x in ("source", "target")]
    spoken = [langs("source").alias("ls"), langs("target").alias("lt")]
    both = "source IS NOT NULL AND target IS NOT NULL"
    everything = F.collect_set(F.struct("side", "s")).alias("all")
    last = rows.groupBy("b", "u").agg(*ends).where(both)
    if last.where(F.col("source") > LONG).isEmpty():  # whole units are small: they come together once
        units = rows.groupBy("b", "u").agg(everything, *spoken, *ends).where(both)
        return units.select("b", "u", F.lit(0).alias("sec"), "ls", "lt", of("source").alias("src"), of("target").alias("tgt"))
    known = rows.groupBy(F.col("b").alias("b2"), F.col("u").alias("u2")).agg(*ends, *spoken).where(both)
    at = rows.join(known, F.col("b").eqNullSafe(F.col("b2")) & F.col("u").eqNullSafe(F.col("u2"))).drop("b2", "u2")
    place = F.greatest(F.coalesce(F.col("s.pos"), F.lit(1)), F.lit(1)).cast("long")
    long = at.where(F.col("source") > LONG).withColumn("g", _unit_key())
    cuts = _sections(long.select("g", "side", place.alias("pos"), F.col("s.text").alias("text"), F.col("source").alias("n"), F.col("target").alias("m")))
    over = math.ceil(MARGIN * LONG)
    inside = lambda c: F.when(F.col("side") == "source", (place >= c["i0"]) & (place < c["i1"])).otherwise((place >= c["j0"] - over) & (place < c["j1"] + over))
    own = long.join(cuts, "g").select("b", "u", "side", "s", "ls", "lt", F.explode(F.transform(F.filter("cuts", inside), lambda c: c["sec"])).alias("sec"))
    placed = at.where(F.col("source") <= LONG).select("b", "u", "side", "s", "ls", "lt", F.lit(0).alias("sec")).unionByName(own)
    units = placed.groupBy("b", "u", "sec").agg(everything, F.first("ls").alias("ls"), F.first("lt").alias("lt"))
    return units.select("b", "u", "sec", "ls", "lt", of("source").alias("src"), of("target").alias("tgt"))


def _fields(column: pa.ListArray, *names: str) -> Iterator[list[list]]:
    """Of every list of structs: the values of each field, as one list."""
    offsets = column.offsets.to_pylist()
    columns = [column.values.field(n).to_pylist() for n in names]
    return ([c[a:b] for c in columns] for a, b in zip(offsets, offsets[1:]))


def _units(batch: pa.RecordBatch, common: dict[str, frozenset[str]] | None) -> Iterator[tuple[Unit, list[int], list[int], str, str]]:
    """Every unit, with the ids of its sentences and its languages; ``common`` is None where no lexicon is known yet."""
    lexica = _fields(batch.column("lex"), "w", "v", "d") if common is not None else itertools.repeat(((), (), ()))
    sides = [_fields(batch.column(n), "id", "text") for n in ("src", "tgt")]
    for src, tgt, ls, lt, lex in zip(*sides, batch.column("ls").to_pylist(), batch.column("lt").to_pylist(), lexica):
        lexicon = None
        if common is not None:
            lexicon = defaultdict(dict)
            for w, v, d in zip(*lex):
                lexicon[w][v] = d
        yield Unit(src[1], tgt[1], lexicon, tuple((common or {}).get(x, frozenset()) for x in (ls, lt))), src[0], tgt[0], ls, lt


def _aligner(common: dict[str, frozenset[str]] | None):
    """The units as they are, with their pairs; ``common`` is None where no lexicon is known yet."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())]))
    kept = ["b", "u", "sec", "ls", "lt", "src", "tgt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[{"a": src[i], "b": tgt[j], "score": float(s)} for i, j, s in align(unit)] for unit, src, tgt, _, _ in _units(batch, common)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(pairs, kind)], names=[*kept, "pairs"])

    return run


_COUNTS = "ls string, lt string, w string, v string, n long"
#: Pairs of words that a task counts before they leave it.
COUNTED = 8_000_000


def _learner(common: dict[str, frozenset[str]], first: bool):
    """Aligns units, and counts words, and words in pairs of sentences: (languages, source word or null, target word or null). Words
    that stand almost everywhere are left out, as they tell nothing. Words are numbers until their counts leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        words = [""]
        held: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        size = 0

        def ids(said: list[str], lang: str) -> np.ndarray:
            found = set(said) - common.get(lang, frozenset())
            for w in found:
                if w not in number:
                    number[w] = len(words)
                    words.append(w)
            return np.array([number[w] for w in found], np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names = pa.array([None, *words[1:]], pa.string())
            for (ls, lt), parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                side = [names.take(pa.array(x)) for x in (keys >> 32, keys & 0xFFFFFFFF)]
                langs = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(keys), np.int64))) for x in (ls, lt)]
                yield pa.RecordBatch.from_arrays([*langs, *side, pa.array(n.astype(np.int64))], names=["ls", "lt", "w", "v", "n"])
            held.clear()

        for batch in batches:
            for unit, src, tgt, ls, lt in _units(batch, None if first else common):
                said = [{k: ids(unit.words[side][k], lang) for k in range(len(own))} for side, own, lang in ((0, src, ls), (1, tgt, lt))]
                for i, j, _ in align(unit):
                    x, y = said[0][i] << 32, said[1][j]
                    held[ls, lt] += [x, y, (x[:, None] | y[None, :]).ravel()]
                    size += len(x) * len(y)
            if size > COUNTED:
                yield from out()
                size = 0
        yield from out()

    return run


def lexicon_of(counts: DataFrame) -> DataFrame:
    """``ls, lt, w, v, d``: words that go together in the paired sentences of two languages, with their Dice coefficient.

    All counts of a source word come together once, and of them only pairs whose coefficient can still reach DICE, if the target word
    stands nowhere else, go on: few, as a word has at most as many of those as fit its own count.
    """
    counts = counts.withColumn("k", F.coalesce("w", F.concat(F.lit("\0"), "v"))).repartition("ls", "lt", "k").groupBy("ls", "lt", "k", "w", "v").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("nw", F.max(F.when(F.col("v").isNull(), F.col("n"))).over(Window.partitionBy("ls", "lt", "k")))
    hopeful = (F.col("n") >= OFTEN) & (2 * F.col("n") >= DICE * (F.col("nw") + F.col("n")))
    counts = cut_lineage(counts.where(F.col("w").isNull() | F.col("v").isNotNull() & hopeful))
    right = counts.where("w IS NULL").select("ls", "lt", "v", F.col("n").alias("nv"))
    both = counts.where("w IS NOT NULL").join(right, ["ls", "lt", "v"])
    dice = both.select("ls", "lt", "w", "v", (2 * F.col("n") / (F.col("nw") + F.col("nv"))).alias("d")).where(F.col("d") >= DICE)
    best = [F.max("d").over(Window.partitionBy("ls", "lt", x)) for x in ("w", "v")]
    return dice.withColumn("top", F.greatest(*best)).where(F.col("d") >= NEAR * F.col("top")).drop("top")


def common_words(units: DataFrame) -> dict[str, frozenset[str]]:
    """Words in more than COMMON of a language's sentences: of each language at most a sentence's length over COMMON."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for frame in batches:
            for r in frame.itertuples():
                for lang, side in ((r.ls, r.src), (r.lt, r.tgt)):
                    for s in side:
                        n[lang, ""] += 1
                        n.update((lang, w) for w in set(tokens(s["text"])))
            if len(n) > 300_000:
                yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["lang", "w", "n"])
                n.clear()
        yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["lang", "w", "n"])

    words = units.select("ls", "lt", "src", "tgt").mapInPandas(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    total = words.where("w = ''").select(F.col("lang").alias("l"), F.col("n").alias("all"))
    out: dict[str, set[str]] = defaultdict(set)
    for r in words.where("w <> ''").join(total, F.col("lang").eqNullSafe(F.col("l"))).where(F.col("n") > COMMON * F.col("all")).collect():
        out[r.lang].add(r.w)
    return {k: frozenset(v) for k, v in out.items()}


class Meeting:
    """Many source sentences of two languages, and how far each can agree with a target sentence at most: what the pair of them scores by
    itself never lies above. Words are kinds: a word, and whether it is a name in its own sentence."""

    def __init__(self, texts: list[str], lexicon: dict[str, dict[str, float]], common: tuple[set[str], set[str]]):
        found: dict[tuple[str, bool], list[int]] = defaultdict(list)
        for x, t in enumerate(texts):
            names = names_of([t])
            for w in set(tokens(t)):
                found[w, w in names].append(x)
        self.common = common
        self.at = {k: np.array(v) for k, v in found.items()}
        self.total = np.zeros(len(texts))
        self.weight: dict[tuple[str, bool], float] = {}
        self.by_anchor: dict[str, list[tuple[str, bool]]] = defaultdict(list)
        self.by_word: dict[str, list[tuple[tuple[str, bool], float]]] = defaultdict(list)
        for k, at in self.at.items():
            w, named = k
            weight = self._weight(0, w)
            self.weight[k] = UNKNOWN if weight == 1.0 and not named and w not in lexicon else weight
            self.total[at] += self.weight[k]
            if a := anchor(w, set()):
                self.by_anchor[a].append(k)
            for v, d in lexicon.get(w, {}).items():
                self.by_word[v].append((k, math.sqrt(d)))
        self.known: dict[tuple[str, bool], tuple[dict[tuple[str, bool], float], np.ndarray, np.ndarray]] = {}

    def _weight(self, side: int, w: str) -> float:
        if w in self.common[side] or (len(w) < 3 and not w[0].isdigit()):
            return 0.15
        return NUMBER if w[0].isdigit() else 1.0

    def _of(self, v: str, named: bool) -> tuple[dict[tuple[str, bool], float], np.ndarray, np.ndarray]:
        """The kinds that a target word goes with, how well, and the sentences that have them."""
        if (v, named) not in self.known:
            best: dict[tuple[str, bool], float] = dict(self.by_word.get(v, ()))
            for k in self.by_anchor.get(anchor(v, set()), ()):
                if v[0].isdigit() or roman(k[0]) == roman(v):
                    best[k] = 1.0
                elif not named and not k[1]:
                    best[k] = max(best.get(k, 0.0), math.sqrt(0.6))
            cover = np.zeros(len(self.total))
            for k in sorted(best, key=best.get):
                cover[self.at[k]] = best[k]
            at = np.flatnonzero(cover)
            self.known[v, named] = best, at, cover[at]
        return self.known[v, named]

    def bounds(self, text: str) -> np.ndarray:
        words, names = set(tokens(text)), names_of([text])
        own, other, total, full = np.zeros(len(self.total)), np.zeros(len(self.total)), self.total, 0.0
        best: dict[tuple[str, bool], float] = {}
        for v in words:
            weight = self._weight(1, v)
            full += weight
            kinds, at, cover = self._of(v, v in names)
            other[at] += weight * cover
            for k, s in kinds.items():
                best[k] = max(best.get(k, 0.0), s)
        for k, s in best.items():
            own[self.at[k]] += self.weight[k] * s
        for v in words & names:  # a word that the target shows to be a name counts whole
            if self.weight.get((v, False)) == UNKNOWN:
                total = total.copy() if total is self.total else total
                total[self.at[v, False]] += 1.0 - UNKNOWN
                own[self.at[v, False]] += 1.0 - UNKNOWN
        a, b = np.maximum(total, 1e-12), max(full, 1e-12)
        return np.maximum((own + other) / (a + b), 0.75 * np.maximum(own / a, other / b))


def _lexicon(entries) -> dict[str, dict[str, float]]:
    lexicon: dict[str, dict[str, float]] = defaultdict(dict)
    for e in entries if entries is not None else ():
        lexicon[e["w"]][e["v"]] = e["d"]
    return lexicon


def _meet(common: dict[str, frozenset[str]]):
    """Scores every pair of the source and the target sentences of a group that can reach LOOSE."""

    def run(source: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(source) and len(target):
            known, one = tuple(common.get(source[x][0], frozenset()) for x in ("ls", "lt")), range(1)
            lexica = [_lexicon(e) for e in source["lex"]]
            meeting = Meeting(list(source["text"]), {w: v for e in lexica for w, v in e.items()}, known)
            for y, t in zip(target["id"], target["text"]):
                for k in np.flatnonzero(meeting.bounds(t) >= LOOSE - 1e-9).tolist():
                    unit = Unit([source["text"][k]], [t], lexica[k], known)
                    s = max(unit.one(0, 0), 0.75 * max(unit.covered(0, 0, one), unit.covered(1, 0, one)))
                    if s >= LOOSE:
                        rows.append((source["g"][0], source["id"][k], y, s))
        return pd.DataFrame(rows, columns=["g", "x", "y", "score"])

    return run


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """The best pairs of a unit, each sentence once."""
    used, kept = (set(), set()), []
    for r in frame.sort_values(["score", "x", "y"], ascending=[False, True, True]).itertuples():
        if r.x not in used[0] and r.y not in used[1]:
            used[0].add(r.x), used[1].add(r.y)
            kept.append((r.g, r.x, r.y, r.score))
    return pd.DataFrame(kept, columns=["g", "x", "y", "score"])


def _rest(side: int, common: dict[str, frozenset[str]]):
    """How far each free sentence of a side is covered by a sentence that others hold already: by the words that they don't take."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            scores = []
            for r in frame.itertuples():
                own, other = [r.text, *r.holders], [r.other]
                unit = Unit(*((other, own) if side else (own, other)), _lexicon(r.lex), (common.get(r.ls, frozenset()), common.get(r.lt, frozenset())))
                scores.append(unit.covered(side, 0, range(1), {0: tuple(range(1, len(own)))}))
            yield frame[["g", "f", "p", "near"]].assign(score=scores)

    return run


def _across(pairs: DataFrame, lexicon: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """Rows like those of ``pairs``, one for each pair of sentences that no section paired, wherever they stand in the unit.

    As inside a section: all that is left of one side meets all that is left of the other, the best pairs first and each sentence once;
    then what is still left joins pairs near it of which it renders a part. Tasks compare blocks of both sides.
    """
    cut = pairs.withColumn("g", _unit_key())
    cut = cut.join(cut.where("sec > 0").select("g").distinct(), "g", "left_semi")
    held = cut.select("g", F.explode("pairs").alias("p")).select("g", F.col("p.a").alias("x"), F.col("p.b").alias("y"))
    unit = ["g", "b", "u", "ls", "lt"]
    said = [cut.select(*unit, F.explode(side).alias("s")).select(*unit, "s.id", "s.text").distinct() for side in ("src", "tgt")]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(r.g, r.ls, r.lt, r.id, w) for r in frame.itertuples() for w in set(tokens(r.text))]
            yield pd.DataFrame(rows, columns=["g", "ls", "lt", "id", "w"])

    known = said[0].select("g", "ls", "lt", "id", "text").mapInPandas(words, "g string, ls string, lt string, id long, w string").distinct().join(lexicon, ["ls", "lt", "w"])
    lex = known.groupBy("g", "id").agg(F.collect_list(F.struct("w", "v", "d")).alias("lex"))
    said = [said[0].join(lex, ["g", "id"], "left"), said[1].withColumn("lex", F.lit(None).cast("array<struct<w: string, v: string, d: double>>"))]
    left = lambda side, held: said[side].join(held.select("g", F.col("xy"[side]).alias("id")), ["g", "id"], "left_anti")

    free = [left(side, held) for side in (0, 1)]
    blocks = [f.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for f, n in zip(free, ("nx", "ny"))]
    blocks = blocks[0].join(blocks[1], "g")
    own, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    source = free[0].join(blocks, "g").select("g", own("nx").alias("kx"), every("ny").alias("ky"), "ls", "lt", "id", "text", "lex")
    target = free[1].join(blocks, "g").select(F.col("g").alias("g"), every("nx").alias("kx"), own("ny").alias("ky"), "id", "text")
    met = source.groupBy("g", "kx", "ky").cogroup(target.groupBy("g", "kx", "ky")).applyInPandas(_meet(common), "g string, x long, y long, score double")
    found = cut_lineage(met.groupBy("g").applyInPandas(_greedy, "g string, x long, y long, score double"))
    held = held.unionByName(found.drop("score"))

    for side, array in ((1, "tgt"), (0, "src")):
        f, p = "xy"[side], "xy"[1 - side]
        places = cut.select("g", "sec", F.posexplode(array).alias("k", "s")).groupBy("g", F.col("s.id").alias("f")).agg(F.min(F.struct("sec", "k")).alias("at"))
        places = places.select("g", "f", F.row_number().over(Window.partitionBy("g").orderBy("at", "f")).alias("at"))
        near = held.join(places.withColumnRenamed("f", f), ["g", f]).select("g", F.col(p).alias("p"), "at", F.explode(F.array(*[F.lit(d) for d in range(-NEXT, NEXT + 1) if d])).alias("d"))
        near = near.select("g", "p", (F.col("at") + F.col("d")).alias("at"), F.abs("d").alias("near")).join(places, ["g", "at"]).groupBy("g", "f", "p").agg(F.min("near").alias("near"))
        near = near.join(left(side, held).select("g", F.col("id").alias("f"), "ls", "lt", "text", F.col("lex").alias("lex_f")), ["g", "f"])
        near = near.join(said[1 - side].select("g", F.col("id").alias("p"), F.col("text").alias("other"), F.col("lex").alias("lex_p")), ["g", "p"])
        holders = held.join(said[side].withColumnRenamed("id", f), ["g", f]).groupBy("g", F.col(p).alias("p")).agg(F.collect_list("text").alias("holders"), F.flatten(F.collect_list("lex")).alias("lex_h"))
        entries = F.concat(*[F.coalesce(f"lex_{x}", F.array()) for x in "fph"])
        rest = near.join(holders, ["g", "p"]).select("g", "f", "p", "near", "ls", "lt", "text", "other", "holders", entries.alias("lex"))
        rest = rest.mapInPandas(_rest(side, common), "g string, f long, p long, near int, score double").where(f"score >= {REST}")
        best = rest.groupBy("g", "f").agg(F.max(F.struct("score", (-F.col("near")).alias("near"), "p")).alias("best"))
        found = found.unionByName(best.select("g", F.col("f").alias(f), F.col("best.p").alias(p), "best.score"))

    one = lambda i, t: F.array(F.struct(F.col(i).alias("id"), F.col(t).alias("text")))
    pair = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "score"))
    found = found.join(said[0].select(*unit, F.col("id").alias("x"), F.col("text").alias("s")), ["g", "x"]).join(said[1].select("g", F.col("id").alias("y"), F.col("text").alias("t")), ["g", "y"])
    return found.select("b", "u", F.lit(-1).alias("sec"), "ls", "lt", one("x", "s").alias("src"), one("y", "t").alias("tgt"), pair.alias("pairs"))


def _settled(pairs: DataFrame) -> DataFrame:
    """``pairs`` where a target sentence that several sections paired keeps the pairs of the section that fits it best, and those with the
    neighbours of its source sentence there, as merges reach over borders."""
    before = F.sum(F.size("src")).over(Window.partitionBy("g").orderBy("sec")) - F.size("src")
    cut = pairs.withColumn("g", _unit_key()).withColumn("n0", before)
    placed = F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["score"].alias("score"), (F.col("n0") + F.array_position("src.id", p["a"])).alias("place")))
    each = cut.select("g", "sec", F.explode(placed).alias("p")).select("g", "sec", "p.*")
    best = each.groupBy("g", "b").agg(F.max_by(F.struct("sec", "place"), F.struct("score", F.col("a"))).alias("best"))
    kept = each.join(best, ["g", "b"]).where("sec = best.sec OR abs(place - best.place) <= 2").groupBy("g", "sec").agg(F.collect_list(F.struct("a", "b", "score")).alias("pairs"))
    return cut.drop("pairs", "n0").join(kept, ["g", "sec"], "left").select("b", "u", "sec", "ls", "lt", "src", "tgt", F.coalesce("pairs", F.array().cast(_PAIRS)).alias("pairs"))


def align_units(units: DataFrame, rounds: int = 2) -> DataFrame:
    """``units`` with ``pairs``: ids of a source and a target sentence of which one renders the other or a part of it, and a score.

    ``rounds`` of learning words follow the first one. A unit with one side only has no pairs; empty tables give none. Sides without
    any language are treated as one language of its own. Pairs found across the sections of a long unit are rows of section -1.
    """
    # Aligning costs far more than reading: the rows are small, so partitions by size would leave most cores idle. A task has units of few
    # pairs of languages, so that its counts of words add up before they leave it; ranges of a hash spread a pair that has many units.
    spark = units.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = units.na.fill({"ls": "", "lt": ""}).withColumn("h", F.xxhash64("b", "u", "sec")).repartitionByRange(tasks, "ls", "lt", "h").drop("h")
    units = cut_lineage(units.withColumn("part", F.spark_partition_id()))
    common = common_words(units)
    if not rounds:
        return units.mapInArrow(_aligner(None), f"{_UNIT}, pairs {_PAIRS}")
    words = units.select("b", "u", "sec", "ls", "lt", F.explode(F.array_distinct(F.flatten(F.transform("src", lambda s: F.regexp_extract_all(F.lower(s["text"]), F.lit(r"\d+(?:[.,]\d+)*|\p{L}+"), F.lit(0)))))).alias("w"))
    known_units = units
    for k in range(rounds):
        lexicon = lexicon_of(known_units.mapInArrow(_learner(common, first=k == 0), _COUNTS))
        known = words.join(lexicon, ["ls", "lt", "w"]).groupBy("b", "u", "sec").agg(F.collect_list(F.struct("w", "v", "d")).alias("lex"))
        known = known.withColumnsRenamed({"b": "b2", "u": "u2", "sec": "sec2"})
        with_words = units.join(known, F.col("b").eqNullSafe(F.col("b2")) & F.col("u").eqNullSafe(F.col("u2")) & (F.col("sec") == F.col("sec2")), "left").drop("b2", "u2", "sec2")
        known_units = with_words.repartitionById(tasks, F.col("part"))
    pairs = known_units.mapInArrow(_aligner(common), f"{_UNIT}, pairs {_PAIRS}")
    if not units.where("sec > 0").isEmpty():
        pairs, lexicon = cut_lineage(_settled(pairs)), cut_lineage(lexicon)
        pairs = pairs.unionByName(_across(pairs, lexicon, common))
    return pairs


def _aligned(spark: SparkSession, root: str) -> DataFrame:
    units = bilingual_units(table(spark, root, "sentences"), "book_slug", "unit_id", "sent_id", "side", "pos", "lang", "sent_text")
    return align_units(units)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = _aligned(spark, root).select(F.explode("pairs").alias("p"))
    return pairs.select(F.least("p.a", "p.b").alias("sent_id_a"), F.greatest("p.a", "p.b").alias("sent_id_b")).distinct()


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The pairs with their texts and score; the best score where sections of a long unit both found a pair."""
    rows = _aligned(spark, root).select("b", "u", "src", "tgt", F.explode("pairs").alias("p"))
    text = lambda side, key: F.filter(side, lambda s: s["id"] == F.col(key))[0]["text"]
    return rows.groupBy(F.col("b").alias("book_slug"), F.col("u").alias("unit_id"), F.col("p.a").alias("source_id"), F.col("p.b").alias("target_id")).agg(
        F.max("p.score").alias("score"), F.first(text("src", "p.a")).alias("source_text"), F.first(text("tgt", "p.b")).alias("target_text")
    )


def holding(quote: str, begins: list[int], text: str) -> set[int]:
    """Which of the sentences that ``text`` joins, and that begin at ``begins``, hold a part of any occurrence of the quote."""
    out: set[int] = set()
    at = text.find(quote) if quote else -1
    while at >= 0:
        out.update(range(bisect.bisect_right(begins, at) - 1, bisect.bisect_left(begins, at + len(quote))))
        at = text.find(quote, at + 1)
    return out


def _quoted(held: Broadcast):
    def joined(texts: list[str]) -> tuple[list[int], str]:
        return [0, *itertools.accumulate(len(t) + 1 for t in texts[:-1])], " ".join(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Canonical(held.value)
        squeezed = lambda t: " ".join(t.split())
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                texts = [s["text"] for s in r.src]
                own = own_script(" ".join(texts))
                form = lambda t: squeezed(c.form(t, own))
                sides = [(f, *joined([f(t) for t in texts])) for f in (squeezed, form)]
                for q in r.quotes:
                    found = set().union(*(holding(f(q["quote"]), begins, text) for f, begins, text in sides))
                    rows += [(q["key"], r.src[i]["id"]) for i in found]
            yield pd.DataFrame(rows, columns=["finding_key", "source_id"])

    return run


def p3_anchors(spark: SparkSession, root: str) -> DataFrame:
    """For each finding: the source sentences that hold the quote of its anchor or parts of it, and their counterparts.

    Quote and sentences are compared as they stand and in their consistent form. Every finding with a quote has a row: without
    ``source_id`` where no sentence of its unit holds the quote, without ``target_id`` where the sentence has no counterpart.
    """
    findings = table(spark, root, "findings").select("finding_key", _unit_key("book_slug", "unit_id").alias("g"), F.trim("source_anchor.quote").alias("quote")).where("quote <> ''").distinct()
    sentences = table(spark, root, "sentences").where("side = 'source' AND sent_text IS NOT NULL AND sent_id IS NOT NULL")
    held = spark.sparkContext.broadcast(fit_bigrams(sentences, "sent_text"))
    src = sentences.groupBy(_unit_key("book_slug", "unit_id").alias("g")).agg(F.array_sort(F.collect_set(F.struct("pos", F.col("sent_id").cast("long").alias("id"), F.col("sent_text").alias("text")))).alias("src"))
    quotes = findings.groupBy("g").agg(F.collect_list(F.struct(F.col("finding_key").alias("key"), "quote")).alias("quotes"))
    at = src.join(quotes, "g").select("src", "quotes").mapInPandas(_quoted(held), "finding_key long, source_id long")
    pairs = p3_pairs(spark, root).select("source_id", "target_id", "target_text")
    return findings.select("finding_key").distinct().join(at, "finding_key", "left").join(pairs, "source_id", "left").select("finding_key", "source_id", "target_id", "target_text")


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_anchors": p3_anchors}
ORACLE: dict[str, str] = {}
