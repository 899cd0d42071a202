"""Periodic runs of words: the places where a text repeats itself without a break.

A run is a stretch with smallest period q that no neighbouring word extends.  Every
run holds a Lyndon root, and that root is the longest Lyndon word at its place under
one of the two orders of the words, so the runs are found by scanning a stack of
next smaller suffixes from right to left under both orders and extending each
Lyndon word to both sides.  Suffixes are compared by their longest common extension
(LCE): a few words directly, then galloping and binary search on rolling hashes, and
what the hashes claim is compared word by word, each pair of places once.

A run as long as those asked for holds a window of words that comes again one period
later, so the stack is scanned only where windows that come twice or more lie; no run
lies elsewhere.  A text is worked on alone, within its task: nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches, with_texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
#: Words that are compared one by one before hashes are used.
_DIRECT = 8


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Extensions:
    """Longest common extensions of places of a sequence, exact: hashes only say where to compare words."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.n, self.ids, self.words = n, ids, ids.tolist()
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(n, _BASE, np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        sums[1:] = np.cumsum(_mixed(ids) * powers[:n])
        self.powers, self.sums = powers.tolist(), sums.tolist()
        #: distance -> places [low, high) of which it is known by their words that each equals the place so much further on.
        self.known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of so many words from i and from j are equal."""
        s = self.sums
        return not ((s[i + length] - s[i]) * self.powers[j - i] - (s[j + length] - s[j])) & _MASK

    def _longest(self, low: int, most: int, same) -> int:
        """The greatest length up to ``most`` for which ``same`` holds, galloping upwards from ``low``, for which it does."""
        step = _DIRECT
        while low < most and same(min(low + step, most)):
            low = min(low + step, most)
            step *= 2
        high = min(low + step, most)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if same(middle) else (low, middle)
        return low

    def _verified(self, i: int, j: int, length: int) -> int:
        """Of ``length`` words that seem equal from i and from j on, how many are, by the words themselves."""
        d, end = j - i, i + length
        low, high = self.known.get(d, (end, end))
        if not low <= end <= high:  # places come from right to left: this stretch lies before the one that is known
            low = high = end
        if i < low:
            differ = np.flatnonzero(self.ids[i:low] != self.ids[i + d : low + d])
            if len(differ):
                return int(differ[0])
            self.known[d] = (i, high)
        return length

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        words, most = self.words, self.n - j
        for k in range(min(most, _DIRECT)):
            if words[i + k] != words[j + k]:
                return k
        if most <= _DIRECT:
            return most
        low, high = self.known.get(j - i, (0, -1))
        if low <= i + _DIRECT <= high:  # what is known of this distance ends where its words differ
            self.known[j - i] = min(i, low), high
            return high - i
        return self._verified(i, j, self._longest(_DIRECT, most, lambda length: self._same(i, j, length)))

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        words = self.words
        for k in range(min(i, _DIRECT)):
            if words[i - 1 - k] != words[j - 1 - k]:
                return k
        if i <= _DIRECT:
            return i
        length = self._longest(_DIRECT, i, lambda length: self._same(i - length, j - length, length))
        differ = np.flatnonzero(self.ids[i - length : i] != self.ids[j - length : j])
        return length - 1 - int(differ[-1]) if len(differ) else length


def _runs_within(ids: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the runs of a whole sequence that are long enough."""
    n = len(ids)
    ext = Extensions(ids)
    words, forward = ext.words, ext.forward
    ends: dict[tuple[int, int], int] = {}
    for sign in (1, -1):
        following, common = [n] * n, [0] * n
        for i in range(n - 2, -1, -1):
            # The stack of next smaller suffixes: i's is sought among i + 1 and what lies below it.
            j, first = i + 1, words[i] * sign
            reach = 0
            while j < n:
                second = words[j] * sign
                if first != second:
                    reach = 0
                    if first > second:
                        break
                else:
                    reach = forward(i, j)
                    if j + reach == n or words[i + reach] * sign > words[j + reach] * sign:
                        break
                j = following[j]
            following[i], common[i] = j, reach if j < n else 0
        # [i, j) is the longest Lyndon word at i.  A run of three periods or more has its root at a place within its first
        # period, and from there on the words agree for a period at least.
        starts = np.arange(n)
        period = np.array(following) - starts
        reach = np.array(common)
        for i in np.flatnonzero(reach >= period).tolist():
            key = (int(period[i]), int(i + period[i] + reach[i]))
            ends[key] = min(i, ends.get(key, i))
    found = set()
    for (q, end), i in ends.items():
        start = i - ext.backward(i, i + q)
        if end - start >= max(min_length, min_exponent * q) and np.array_equal(ids[start : end - q], ids[start + q : end]):
            found.add((start, end, q))
    return found


def periodic_runs(ids: np.ndarray, *, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period, of every run of ``min_length`` words or more and ``min_exponent``
    (3 or more) periods or more in a sequence of word numbers."""
    if min_exponent < 3 or min_length < min_exponent:
        raise ValueError("runs are sought from three periods on")
    n = len(ids)
    # A run of length l and period q holds l - q >= l - l / exponent places that come again: so long a window comes twice.
    window = min_length - min_length // min_exponent
    if n < min_length:
        return []
    hashes, span, factor = _mixed(ids), 1, _BASE
    grown, left, done = None, window, 0
    with np.errstate(over="ignore"):
        while left:  # the window's hash is put together from those of powers of two
            if left & 1:
                if grown is None:
                    grown, done = hashes, span
                else:
                    m = min(len(grown), len(hashes) - done)
                    shift = np.uint64(pow(_BASE, span, 1 << 64))
                    grown, done = grown[:m] * shift + hashes[done : done + m], done + span
            left >>= 1
            if left:
                m = len(hashes) - span
                hashes, span, factor = hashes[:m] * np.uint64(factor) + hashes[span : span + m], span * 2, factor * factor & _MASK
    grown = grown[: n - window + 1]
    order = np.argsort(grown, kind="stable")
    equal = grown[order[1:]] == grown[order[:-1]]
    if not equal.any():
        return []
    twice = np.zeros(len(grown) + 1, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    change[at] += 1
    change[at + window] -= 1
    inside = np.concatenate([[0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    runs = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= min_length:
            runs += [(a + s, e - s, q) for s, e, q in _runs_within(ids[a:b], min_length, min_exponent)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the repetition that the contract lays into every tenth document; none for a null id."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n words those that lie in a run behind its first period."""
    gone = np.zeros(n, bool)
    for s, length, q in runs:
        gone[s + q : s + length] = True
    return gone


def run_columns(words: list[str], *, min_length: int = 24, min_exponent: int = 3) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_dropped."""
    runs = periodic_runs(_numbered(words), min_length=min_length, min_exponent=min_exponent)
    best, kept, dropped = (None,) * 4, words, 0
    if runs:
        s, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = s, length, q, 1000 * length // q
        gone = _dropped(len(words), runs)
        dropped = int(gone.sum())
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = lambda t: sha256(t.encode("utf-8", "replace")).hexdigest()
    return len(runs), *best, digest(listed), digest(" ".join(kept)), dropped


def run_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3, plant: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli; ties: smallest start, then period; null where there is none), runs_sha256, collapsed_sha256, n_dropped.

    A word is dropped if a run contains it behind that run's first period.  Null and empty texts have no words and no
    runs; null and repeated ids stay, each row on its own; an empty table gives an empty result; other columns are
    ignored.  A text of any length is worked on whole, in memory that grows with its number of words.  With ``plant``
    every tenth document is given a repetition first, by the hash of its id.
    """
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession, 200)
    longs = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    names = [*longs, "runs_sha256", "collapsed_sha256", "n_dropped"]
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]

    def measure(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall(text)
                rows.append((doc, *run_columns(planted(words, doc) if plant else words, min_length=min_length, min_exponent=min_exponent)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(measure, ", ".join(f"{n} long" for n in longs) + ", runs_sha256 string, collapsed_sha256 string, n_dropped long")


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``docs`` with the repeated periods of every run taken out of the text; texts without a run stay as they are, to the
    byte, and those with one have their words joined by one space.  Nulls stay null; all columns and rows stay."""
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession, 200)

    def shortened(text: str | None) -> str | None:
        words = _WORD.findall(text or "")
        gone = _dropped(len(words), periodic_runs(_numbered(words), min_length=min_length, min_exponent=min_exponent))
        return " ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else text

    return with_texts(docs, text_col, lambda texts: [shortened(t) for t in texts])
