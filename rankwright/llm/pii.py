"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Four kinds come from patterns and are checked (number parts, Luhn's sum, number of
digits).  The field then adds what the patterns miss: spelled-out addresses, numbers
without a country code, other separators, and two kinds of its own.  It is trained
here, by gradient ascent on the likelihood of a small labelled table, and decoded by
Viterbi in numpy over all the pieces of a batch of texts at once.  A span it finds is
checked by its kind's rule and stays out where a pattern's span lies already.

Personal data holds a digit, an at sign or a spelled one: words that are further than
REACH characters from any such place have no label but "none", so a text falls into
pieces that are decoded apart, with the result that the whole text would give.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches, with_texts

Span = tuple[str, int, int]

BASE = ("email", "ip", "card", "phone")
#: The base kinds in their order, then those that only the field finds.
KINDS = (*BASE, "ssn", "iban")
PLACEHOLDER = "[{}]"

# Fixed values of the contract.  Places where no match can start are passed over, so that time follows the text's length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]+", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _ip_ok(text: str) -> bool:
    return all(map(_small, text.split(".")))


def _card_ok(text: str) -> bool:
    number = digits(text)
    return 12 <= len(number) <= 19 and luhn(number)


def _emails(text: str) -> list[tuple[int, int]]:
    """An at sign belongs to the whole run of local characters before it, so the signs are looked for."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            found.append((start, domain.end()))
            last = domain.end()
        else:
            last = at + 1  # no match reaches over an at sign that has none
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[Span]:
    """The patterns' spans that pass, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return in_order(found)


def in_order(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# --- words and their shapes ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_TRIGGER = re.compile(r"[0-9@]+|[\[(]\x20?[aA][tT]\x20?[\])]|\x20[dD][oO][tT]\x20")
REACH = 48
#: Words that count as themselves (fixed values).
_CUES = frozenset("at dot com org net tel phone call fax card visa mail email ip ssn iban token version page date isbn order".split())
_SLOTS, _BOOK, _AROUND = 4096, 1024, 3


@lru_cache(maxsize=50_000)
def _shape(token: str) -> int:
    """Number of the token's class, from 1: what it is made of and how long it is."""
    if token[0] in "0123456789":
        kind = f"d{min(len(token), 24)}{'v' if 12 <= len(token) <= 19 and luhn(token) else ''}"
    elif token[0].isalpha():
        low = token.lower()
        form = "a" if token.islower() else "A" if token.isupper() else "T" if token.istitle() else "m"
        kind = f"={low}" if low in _CUES else f"{form}{min(len(token), 5)}{'x' if len(token) < 5 and not set(low) - set('abcdef') else ''}"
    else:
        kind = token if ord(token) < 128 else "other"
    return zlib.crc32(kind.encode()) % (_BOOK - 1) + 1


def pieces(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around digits, at signs and spelled ones."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


@dataclass
class Piece:
    """Where the tokens of a stretch start and end, their classes, and whether white space stands before them."""

    starts: list[int]
    ends: list[int]
    shapes: list[int]
    apart: list[bool]


def tokenised(text: str, a: int, b: int) -> Piece:
    piece, last = Piece([], [], [], []), a
    for m in _TOKEN.finditer(text, a, b):
        piece.starts.append(m.start())
        piece.ends.append(m.end())
        piece.shapes.append(_shape(m[0]))
        piece.apart.append(m.start() > last)
        last = m.end()
    return piece


def _features(shapes: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Slots [piece, token, feature]: the shapes around a token, and pairs and a triple of neighbours with the gaps between."""
    n, size = shapes.shape
    wide = np.zeros((n, size + 2 * _AROUND), np.int64)
    wide[:, _AROUND : _AROUND + size] = shapes
    gap = np.zeros((n, size + 1), np.int64)
    gap[:, :size] = apart
    at = lambda o: wide[:, _AROUND + o : _AROUND + o + size]
    single = [at(o) + _BOOK * k for k, o in enumerate(range(-_AROUND, _AROUND + 1))]
    base = _BOOK * len(single)
    before, after = gap[:, :size], gap[:, 1:]
    mixed = [
        (at(-1) * 31 + at(0) * 1009 + before * 7919) % _SLOTS,
        (at(0) * 37 + at(1) * 2003 + after * 6007) % _SLOTS + _SLOTS,
        (at(-1) * 41 + at(0) * 3001 + at(1) * 5003 + before * 101 + after * 211) % _SLOTS + 2 * _SLOTS,
    ]
    return np.stack([*single, *(m + base for m in mixed)], 2)


_WIDTH = _BOOK * (2 * _AROUND + 1) + 3 * _SLOTS
_LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_NONE = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Scores of impossible steps and starts: a span goes on only after a label of its kind."""
    step = np.zeros((len(_LABELS), len(_LABELS)))
    start = np.zeros(len(_LABELS))
    for b, label in enumerate(_LABELS):
        if label[0] == "I":
            start[b] = _NONE
            for a, before in enumerate(_LABELS):
                if before[2:] != label[2:]:
                    step[a, b] = _NONE
    return step, start


@dataclass(frozen=True)
class Field:
    """Weights of features by label, of steps from label to label, and of the first label."""

    emit: np.ndarray = field(repr=False)
    step: np.ndarray = field(repr=False)
    start: np.ndarray = field(repr=False)

    def decode(self, found: Sequence[Piece], cells: int = 40_000) -> list[np.ndarray]:
        """The best labels of every piece, by Viterbi; pieces of like length are worked on together, ``cells`` tokens at once."""
        order = sorted(range(len(found)), key=lambda k: len(found[k].shapes))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(found)
        k = 0
        while k < len(order):
            group, size = [], 0
            while k < len(order) and (not group or (len(group) + 1) * len(found[order[k]].shapes) <= cells):
                group.append(order[k])
                size = len(found[order[k]].shapes)
                k += 1
            if size:
                self._decode_group([found[g] for g in group], group, size, out)
        return out

    def _decode_group(self, group: list[Piece], numbers: list[int], size: int, out: list[np.ndarray]) -> None:
        n, labels = len(group), len(_LABELS)
        shapes, apart = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
        lengths = np.array([len(p.shapes) for p in group])
        for r, p in enumerate(group):
            shapes[r, : len(p.shapes)] = p.shapes
            apart[r, : len(p.shapes)] = p.apart
        slots = _features(shapes, apart)
        back = np.zeros((size, n, labels), np.int8)
        score = self.emit[slots[:, 0]].sum(1) + self.start
        for t in range(1, size):
            paths = score[:, :, None] + self.step
            best = paths.argmax(1)
            new = np.take_along_axis(paths, best[:, None], 1)[:, 0] + self.emit[slots[:, t]].sum(1)
            over = t >= lengths  # behind a piece's end its last labels stay
            best[over], new[over] = np.arange(labels), score[over]
            back[t], score = best, new
        labels_at = np.zeros((n, size), np.int8)
        at = score.argmax(1)
        rows = np.arange(n)
        for t in range(size - 1, -1, -1):
            labels_at[:, t] = at
            at = back[t, rows, at]
        for r, k in enumerate(numbers):
            out[k] = labels_at[r, : lengths[r]]


def train(labelled: Sequence[tuple[str, Sequence[Span]]], *, rounds: int = 60, rate: float = 0.12, penalty: float = 0.03) -> Field:
    """The field of the greatest likelihood of (text, spans) rows, less ``penalty`` times the squares of the weights, by
    ``rounds`` steps of Adam over all rows.  A few hundred rows are meant; they are held in memory."""
    found, gold = [], []
    for text, spans in labelled:
        for a, b in pieces(text):
            piece = tokenised(text, a, b)
            labels = np.zeros(len(piece.shapes), np.int64)
            for kind, s, e in spans:
                inside = [k for k, (x, y) in enumerate(zip(piece.starts, piece.ends)) if x >= s and y <= e]
                for nth, k in enumerate(inside):
                    labels[k] = 1 + 2 * KINDS.index(kind) + (nth > 0)
            if len(labels):
                found.append(piece)
                gold.append(labels)
    n, size, count = len(found), max(map(len, gold), default=1), len(_LABELS)
    banned, first = _allowed()
    emit, step, start = np.zeros((_WIDTH, count)), np.zeros((count, count)), np.zeros(count)
    if not n:
        return Field(emit, banned, first)
    shapes, apart, want, live = np.zeros((n, size), np.int64), np.zeros((n, size), bool), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for r, (p, g) in enumerate(zip(found, gold)):
        m = len(g)
        shapes[r, :m], apart[r, :m], want[r, :m], live[r, :m] = p.shapes, p.apart, g, True
    slots = _features(shapes, apart)
    flat = slots[live].ravel()
    order = np.argsort(flat, kind="stable")
    used, begins = np.unique(flat[order], return_index=True)
    owner = order // slots.shape[2]
    hot = np.zeros((n, size, count))
    np.put_along_axis(hot, want[:, :, None], 1.0, 2)
    pairs = live[:, 1:] & live[:, :-1]
    steps = np.zeros((count, count))
    np.add.at(steps, (want[:, :-1][pairs], want[:, 1:][pairs]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit[used], step, start)]
    for turn in range(1, rounds + 1):
        e = np.zeros((n, size, count))
        e[live] = emit[slots[live]].sum(1)
        # Forward and backward sums in probabilities, scaled at every token.
        top = e.max(2, keepdims=True)
        chance, go, begin = np.exp(e - top), np.exp(step + banned), np.exp(start + first)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, size))
        now = chance[:, 0] * begin
        for t in range(size):
            if t:
                now = np.where(live[:, t, None], (alpha[:, t - 1] @ go) * chance[:, t], alpha[:, t - 1])
            scale[:, t] = np.where(live[:, t], now.sum(1), 1.0)
            alpha[:, t] = now / scale[:, t, None]
        both = np.zeros((count, count))
        for t in range(size - 1, 0, -1):
            ahead = chance[:, t] * beta[:, t] / scale[:, t, None] * live[:, t, None]
            both += alpha[:, t - 1].T @ ahead
            beta[:, t - 1] = np.where(live[:, t, None], ahead @ go.T, 1.0)
        both *= go
        expected = alpha * beta
        expected[~live] = 0
        off = (hot - expected)[live]
        grads = [np.add.reduceat(off[owner], begins, axis=0) / n - penalty / n * emit[used], (steps - both) / n, (hot[:, 0] - expected[:, 0]).sum(0) / n]
        for k, (g, (m, v)) in enumerate(zip(grads, moments)):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            move = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-6)
            if k == 0:
                emit[used] += move
            elif k == 1:
                step += move
            else:
                start += move
    return Field(np.round(emit, 6), np.round(step + banned, 6), np.round(start + first, 6))


# --- the labelled table -------------------------------------------------------------------------------------------


def _with_luhn(number: str) -> str:
    return next(number + c for c in "0123456789" if luhn(number + c))


def labelled_table(rows: int = 900, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Made-up lines with personal data in many forms, and with numbers that are none."""
    rng = random.Random(seed)
    some = lambda n, among="0123456789": "".join(rng.choice(among) for _ in range(n))
    word = lambda: some(rng.randint(2, 8), "aeiourstlnmdhéü")
    host = lambda: rng.choice(("mail", "post", word())) + rng.choice(("", some(1)))
    top = lambda: rng.choice(("com", "org", "net", "de", "fr"))
    name = lambda: some(rng.randint(2, 7), "abcdefghijklmnoprstuvwz") + rng.choice(("", f".{some(2)}", some(2), f".{some(4, 'aeiours')}"))

    def email() -> str:
        a, h, t = name(), host(), top()
        forms = (f"{a}@{h}.example.{t}", f"{a}@{h}.{t}", f"{a} at {h} dot {t}", f"{a}[at]{h}.{t}", f"{a} (at) {h} (dot) {t}", f"{a} [at] {h} [dot] {t}", f"{a} AT {h} DOT {t}", f"{a} @ {h}.{t}")
        return rng.choice(forms)

    def phone() -> str:
        a, b, c = rng.choice("23456789") + some(2), some(3), some(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{some(2)} {some(2)} {some(7)}", f"00{some(2)} {some(2)} {some(3)} {c}", f"1-{a}-{b}-{c}"))

    def card() -> str:
        if rng.random() < 0.15:
            x = _with_luhn("3" + some(13))
            return f"{x[:4]} {x[4:10]} {x[10:]}"
        x = _with_luhn(rng.choice("456") + some(14))
        return rng.choice((x, *(s.join(x[k : k + 4] for k in range(0, 16, 4)) for s in (" ", "-", ".", "_", "/"))))

    def ip() -> str:
        v4 = ".".join(str(rng.randrange(256)) for _ in range(4))
        v6 = ":".join(some(rng.randint(1, 4), "0123456789abcdef") for _ in range(8))
        return rng.choice((v4, v4, v6))

    def iban() -> str:
        body, land = some(18), some(2, "ABDEFGIT")
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
        whole = f"{land}{check:02d}{body}"
        return rng.choice((whole, " ".join(whole[k : k + 4] for k in range(0, 22, 4))))

    make: dict[str, Callable[[], str]] = {"email": email, "phone": phone, "card": card, "ip": ip, "ssn": lambda: f"{rng.choice('1234578')}{rng.randint(1, 99):02d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "iban": iban}

    def other() -> str:
        y, m, d = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
        bad = next(x for x in iter(lambda: rng.choice("3456") + some(15), "") if not luhn(x))
        return rng.choice((
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{some(2)}:{some(2)}:{some(2)}", f"${some(1)},{some(3)}.{some(2)}", f"{some(1)}.{some(1)}.{some(2)}", f"3.{some(3)}", str(y), some(1), some(2), some(3), some(4), some(6),
            f"978-{some(1)}-{some(2)}-{some(6)}-{some(1)}", f"{some(2)}%", f'token = "{some(40, "0123456789abcdef")}"', bad, bad, f"{some(2)}-{some(2)}", f"{some(8)}", f"look at the dot on page {some(1)}", f"#{some(5)}", f"{some(3)} {some(3)} {some(3)}",
            f"x{some(3)}", f"{some(2)}x{some(2)}", f"sha {some(16, '0123456789abcdef')}", f"{some(1)}.{some(1)}.{some(1)}.{some(1)}.{some(1)}", f"a {word()} dot {word()}", f"@{word()}", f"{some(12)}" if rng.random() < 0.3 else some(5), f"AKIA{some(16, 'ABCDEFGH0123456789')}",
        ))

    table = []
    for _ in range(rows):
        parts: list[tuple[str, str | None]] = [(word().capitalize() if rng.random() < 0.2 else word(), None) for _ in range(rng.randint(3, 12))]
        for _ in range(rng.choice((0, 1, 1, 2))):
            kind = rng.choice((*KINDS, "email", "phone", "card"))
            parts.insert(rng.randint(0, len(parts)), (make[kind](), kind))
        for _ in range(rng.choice((0, 1, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), (other(), None))
        tail = rng.choice(("", "", "", "!!", "###", "%%%", "$$$", "&&&", ","))
        text, spans = "", []
        for part, kind in parts:
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + (tail or rng.choice(("", "", "", "", ".", ","))) + rng.choice((" ", " ", " ", "\n"))
        table.append((text.strip(), spans))
    return table


@lru_cache(maxsize=4)
def default_field(rows: int = 900, seed: int = 7) -> Field:
    return train(labelled_table(rows, seed))


# --- spans --------------------------------------------------------------------------------------------------------

_V6 = re.compile(r"[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}")


def _iban_ok(text: str) -> bool:
    whole = re.sub(r"[^0-9A-Z]", "", text)
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", whole)) and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1


#: What a span that the field found has to be like.
_CHECKS: dict[str, Callable[[str], bool]] = {
    "email": lambda t: bool(re.fullmatch(r"[\w.%+-]+(?:\x20?@\x20?|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[\w-]+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[\w-]+)+", t, re.IGNORECASE)),
    "phone": lambda t: 9 <= len(digits(t)) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][\x20()./0-9-]+[0-9]", t)),
    "card": _card_ok,
    "ip": lambda t: bool(_V6.fullmatch(t)) or t.count(".") == 3 and bool(re.fullmatch(r"[0-9.]+", t)) and _ip_ok(t),
    "ssn": lambda t: bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}[\x20-](?!00)[0-9]{2}[\x20-](?!0000)[0-9]{4}", t)),
    "iban": _iban_ok,
}


def _added(text: str, piece: Piece, labels: np.ndarray, base: Sequence[Span]) -> list[Span]:
    """The field's spans that pass their check and touch no base span."""
    found, k = [], 0
    marks = labels.tolist()
    while k < len(marks):
        if not marks[k]:
            k += 1
            continue
        kind, first = (marks[k] - 1) // 2, k
        k += 1
        while k < len(marks) and marks[k] == 2 * kind + 2:
            k += 1
        a, b = piece.starts[first], piece.ends[k - 1]
        if _CHECKS[KINDS[kind]](text[a:b]) and not any(s < b and a < e for _, s, e in base):
            found.append((KINDS[kind], a, b))
    return found


def all_spans(texts: Sequence[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and all spans with those that the field adds."""
    bases = [base_spans(t) for t in texts]
    where, found = [], []
    for k, text in enumerate(texts):
        for a, b in pieces(text):
            piece = tokenised(text, a, b)
            where.append(k)
            found.append(piece)
    added: dict[int, list[Span]] = {}
    for k, piece, labels in zip(where, found, model.decode(found)):
        if labels.any():
            near = [s for s in bases[k] if s[2] > piece.starts[0] and s[1] < piece.ends[-1]]
            added.setdefault(k, []).extend(_added(texts[k], piece, labels, near))
    return [(base, in_order([*base, *added[k]]) if added.get(k) else base) for k, base in enumerate(bases)]


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _batched(batch: list[str], most: int = 4 << 20):
    """Slices of a batch of about ``most`` characters at most, a text at least."""
    first, size = 0, 0
    for k, text in enumerate(batch):
        if k > first and size + len(text) > most:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(batch):
        yield first, len(batch)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (the patterns' spans), base_sha256, spans
    (kind:start:end of all spans by start, then kind, in code points, end exclusive), n_added.

    The patterns' spans all stay; of the ``model``'s those are added that pass the check of their kind and touch none of
    them.  Null text counts as empty; null and repeated ids stay, each row on its own; an empty table gives an empty
    result; other columns are ignored.  Texts are worked on whole, within their task.
    """
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    model = model or default_field()
    counts = [f"n_{k}" for k in BASE]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_added"]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]

    def scan(batches):
        for batch in batches:
            ids, texts = (batch.column(k).to_pylist() for k in range(2))
            for a, b in _batched(texts):
                rows = []
                for doc, (base, every) in zip(ids[a:b], all_spans(texts[a:b], model)):
                    found = [s[0] for s in base]
                    rows.append((doc, *(found.count(k) for k in BASE), sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long")


def mask_personal_data(docs: DataFrame, *, text_col: str = "text", model: Field | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that overlap the first to start names the kind and
    all of them go.  Null texts stay null; all rows and other columns stay; an empty table gives an empty result."""
    require_columns(docs, [text_col])
    small_batches(docs.sparkSession)
    model = model or default_field()

    def hide(text: str, spans: Sequence[Span]) -> str:
        out, last = [], 0
        for kind, a, b in spans:
            if a >= last:
                out += [text[last:a], PLACEHOLDER.format(kind.upper())]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def mask(texts: list) -> list:
        new = []
        whole = [t or "" for t in texts]
        for a, b in _batched(whole):
            new += [None if t is None else hide(t, spans) for t, (_, spans) in zip(texts[a:b], all_spans(whole[a:b], model))]
        return new

    return with_texts(docs, text_col, mask)
