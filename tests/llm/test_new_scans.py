"""Personal data, periodic runs and vector codes against brute force and made-up cases."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from rankwright.llm import periodic_runs, pii, queries, vector_codes

from .conftest import SF, by_id

# --- personal data ------------------------------------------------------------------------------------------------


def pii_brute(text):
    text = text or ""
    number = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(number(t)) <= 19 and luhn(number(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(number(t)) <= 15),
    ]
    found = [(name, *m.span()) for name, rule, ok in rules for m in re.finditer(rule, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_against_plain_search():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice("01239a@@..+-- ()%_") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == pii_brute(text), text
    for text in ("4111 1111 1111 1111", "a@b@c.de", "256.1.1.1", "01.002.3.4.5.6.7.8", "+1 (743) 555-3824", "x" * 200_000 + "@b.c", "1" * 200_000):
        assert pii.base_spans(text) == pii_brute(text) if len(text) < 100 else pii.base_spans(text) is not None


def test_personal_data_query(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        got = pii.personal_data(docs)
        rows = sorted(((r.doc_id is None, r.doc_id or 0), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect())
        want = []
        for r in docs.collect():
            spans = pii_brute(r.text)
            kinds = [s[0] for s in spans]
            want.append(((r.doc_id is None, r.doc_id or 0), *(kinds.count(k) for k in pii.BASE), sha256(pii.listed(spans).encode()).hexdigest()))
        assert rows == sorted(want)
    assert pii.personal_data(no_docs).collect() == []
    # The patterns' spans are all among the spans.
    texts = by_id(documents)
    for r in pii.personal_data(documents).where("spans != ''").collect():
        assert set(pii.listed(pii_brute(texts[r.doc_id].text)).split(",")) - {""} <= set(r.spans.split(","))


def test_field_finds_held_out_forms():
    model = pii.default_field()
    hit = missed = false = 0
    table = pii.labelled_table(600, seed=99)
    for (text, gold), (base, every) in zip(table, pii.all_spans([t for t, _ in table], model)):
        reachable = {g for g in gold if g in base or not any(s < g[2] and g[1] < e for _, s, e in base)}
        added = set(every) - set(base)
        hit += len(reachable & set(every))
        missed += len(reachable - set(every))
        false += len(added - set(gold))
        assert set(base) <= set(every)
    assert hit >= 0.93 * (hit + missed) and false <= 0.02 * hit
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.all_spans([t], model)[0][1]]
    assert found("Write to jane dot") == []
    assert ("email", "bob at mail dot com") in found("please ask bob at mail dot com today")
    assert found("call +1 (826) 555-4081 190.137.223.204 now") == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]


def test_clean_numbers_stay_clean(documents):
    """Of the documents in which no pattern finds anything, the field finds nothing in any."""
    added = pii.personal_data(documents).where("n_added > 0 AND n_email + n_ip + n_card + n_phone = 0")
    assert added.count() == 0


def test_decoding_in_pieces_equals_decoding_whole():
    """Viterbi over a padded group gives every piece the labels it gets alone, and those of a plain search over all paths."""
    model = pii.default_field()
    texts = [t for t, _ in pii.labelled_table(60, seed=3)]
    parts = [pii.tokenised(t, a, b) for t in texts for a, b in pii.pieces(t)]
    together = model.decode(parts)
    for part, labels in zip(parts, together):
        assert model.decode([part])[0].tolist() == labels.tolist()
        shapes, apart = np.array([part.shapes]), np.array([part.apart])
        emit = model.emit[pii._features(shapes, apart)[0]].sum(1)
        paths = {k: (emit[0, k] + model.start[k], (k,)) for k in range(len(model.start))}
        for t in range(1, len(emit)):
            paths = {k: max((s + model.step[j, k], p) for j, (s, p) in paths.items()) for k in paths}
            paths = {k: (s + emit[t, k], (*p, k)) for k, (s, p) in paths.items()}
        best = max(s for s, _ in paths.values())
        own = emit[np.arange(len(labels)), labels].sum() + model.start[labels[0]] + model.step[labels[:-1], labels[1:]].sum()
        assert abs(own - best) < 1e-6


def test_masking(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +1 (743) 555-3824.", "x"), (2, None, "y"), (3, "nothing here", None)], "doc_id long, text string, `a.b` string")
    got = by_id(pii.mask_personal_data(docs))
    assert got[1].text == "mail [EMAIL] or [PHONE]." and got[2].text is None and got[3].text == "nothing here" and got[1]["a.b"] == "x"


# --- periodic runs ------------------------------------------------------------------------------------------------


def runs_brute(words, least=24, times=3):
    """Every stretch of equal words at each distance, less those with a smaller period."""
    w, found = np.asarray(words), []
    for q in range(1, len(w) // times + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, w[:-q] == w[q:], False].astype(int)))
        for s, t in zip(edges[::2].tolist(), edges[1::2].tolist()):
            part = w[s : t + q]
            if len(part) >= max(least, times * q) and not any(np.array_equal(part[:-d], part[d:]) for d in range(1, q)):
                found.append((s, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("mask", [periodic_runs._MASK, 7])
def test_runs_against_brute_force(mask, monkeypatch):
    """Also where hashes hardly tell anything apart: words are compared themselves."""
    monkeypatch.setattr(periodic_runs, "_MASK", mask)
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(90), rng.choice((1, 2, 2, 3, 5))
        words = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 8))):
                words[i] = words[i - p]
        least, times = rng.choice(((24, 3), (3, 3), (8, 3), (6, 4), (24, 5)))
        assert periodic_runs.periodic_runs(np.array(words, np.int64), min_length=least, min_exponent=times) == runs_brute(words, least, times)


def test_runs_of_long_texts():
    assert periodic_runs.periodic_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic_runs.periodic_runs(np.array(fibonacci[-1])) == runs_brute(fibonacci[-1])
    block = np.random.default_rng(0).integers(0, 50, 7777)
    assert periodic_runs.periodic_runs(np.tile(block, 4)) == [(0, 4 * 7777, 7777)]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(block, min_exponent=2)


def report_brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number: dict[str, int] = {}
    runs = runs_brute([number.setdefault(w, len(number)) for w in words])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)), len(gone))


def test_run_report(spark, documents, odd_docs, no_docs):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    for docs in (documents, odd_docs):
        got = sorted(map(tuple, periodic_runs.run_report(docs, plant=True).collect()), key=key)
        assert got == sorted(((r.doc_id, *report_brute(r.doc_id, r.text)) for r in docs.collect()), key=key)
    assert periodic_runs.run_report(no_docs).collect() == []
    assert periodic_runs.run_report(documents, plant=True).where("n_runs > 0").count() > 50


def test_collapse_runs(spark):
    text = "start " + "one two three " * 20 + "end  of it"
    docs = spark.createDataFrame([(1, text, 0.5), (2, "a  b", None), (3, None, 1.0)], "doc_id long, text string, `x.y` double")
    got = by_id(periodic_runs.collapse_runs(docs))
    assert got[1].text == "start one two three end of it" and got[2].text == "a  b" and got[3].text is None and got[1]["x.y"] == 0.5


# --- vector codes -------------------------------------------------------------------------------------------------


def test_nearest_against_all_entries():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, size, entries = rng.integers(1, 60), rng.integers(1, 5), rng.integers(1, 17)
        x, book = rng.integers(-4, 5, (n, size)), rng.integers(-4, 5, (entries, size))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        best, least = vector_codes.nearest(x, rng.integers(0, entries, n), book)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def codes_brute(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    if not kept:
        return []
    x = np.array([[int(np.floor(4096 * float(c))) for c in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = x[first].swapaxes(0, 1).copy()
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        at = near().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own := x[at[:, p] == e, p]).size:
                    books[p, e] = own.sum(0) // len(own)
    at, error = near().argmin(2), near().min(2).sum(1)
    by_label: dict = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in at[k]), int(error[k]), by_label[r[2]], digest) for k, r in enumerate(kept)]


def test_vector_codes(spark):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert sorted(map(tuple, queries.op13_vector_codes(spark, SF).collect()), key=key) == sorted(codes_brute(list(map(tuple, df.collect()))), key=key)
    rng = random.Random(2)
    made = [(None if k == 5 else k // 2 * 2, [rng.uniform(-1, 1) for _ in range(16)], rng.choice((None, 1, 2)), "x", 1) for k in range(60)]
    made += [made[0], (99, None, 1, "x", 1), (98, [None] + [0.0] * 15, 1, "x", 1), (97, [float("nan")] * 16, None, "x", 1), (96, [float("inf")] * 16, None, "x", 1)]
    schema = "vec_id long, embedding array<float>, label int, code string, `n.v` int"
    odd = spark.createDataFrame(made, schema).repartition(3)
    assert sorted(map(tuple, vector_codes.code_report(odd).collect()), key=key) == sorted(codes_brute([tuple(r)[:3] for r in odd.collect()]), key=key)
    few = odd.where("vec_id < 6")
    assert sorted(map(tuple, vector_codes.code_report(few).collect()), key=key) == sorted(codes_brute([tuple(r)[:3] for r in few.collect()]), key=key)
    assert vector_codes.code_report(odd.limit(0)).collect() == [] and vector_codes.code_report(odd.where("vec_id > 95")).collect() == []
    with pytest.raises(ValueError):
        vector_codes.code_report(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))
    books, coded = vector_codes.fit_codes(odd)
    near = vector_codes.restored(coded, books).selectExpr("max(abs(v[0] / 4096D - approx[0])) AS d", "max(size(approx)) AS n").first()
    assert near.d < 1 and near.n == 16
