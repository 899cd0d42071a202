"""Exact and near deduplication against brute force."""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rankwright.llm import common, exact_dedup, language, located, near_dedup

from .conftest import SF


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc, text in rows:
        groups[norm(text)].append(doc)
    out = []
    for doc, text in rows:
        ids = groups[norm(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = exact_brute([(r.doc_id, r.text) for r in docs.collect()])
        assert shown(exact_dedup.exact_groups(docs)) == want
    assert exact_dedup.exact_groups(no_docs).collect() == []


def test_colliding_digests_are_told_apart_by_full_bytes(documents):
    want = exact_brute([(r.doc_id, r.text) for r in documents.collect()])
    assert shown(exact_dedup.exact_groups(documents, digest_digits=2)) == want


def test_state_outlives_a_batch_and_a_call(spark, documents):
    state = exact_dedup.DedupState(spark)
    half = documents.where("doc_id % 2 = 1")
    exact_dedup.exact_groups(half, state=state).collect()
    got = exact_dedup.exact_groups(documents.where("doc_id % 2 = 0").repartition(5), state=state, files_per_batch=2)
    want = {r[0]: r for r in exact_brute([(r.doc_id, r.text) for r in documents.collect()])}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == {d: w[1:3] for d, w in want.items() if d % 2 == 0}


def test_texts_of_an_earlier_call_are_compared_by_their_bytes(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    state = exact_dedup.DedupState(spark)
    one = lambda rows: sorted(tuple(r)[:4] for r in exact_dedup.exact_groups(table(rows), digest_digits=0, state=state).collect())
    assert one([(1, "a")]) == [(1, 1, 1, True)]
    # Every digest is the same: only the bytes tell that the first is no copy of what the state holds, and the second is.
    assert one([(11, "zz"), (12, "a")]) == [(11, 11, 1, True), (12, 1, 2, False)]
    assert one([(0, "zz"), (13, "b"), (14, "b"), (15, "a  "), (16, "a ")]) == [(0, 0, 2, True), (13, 13, 2, True), (14, 13, 2, False), (15, 15, 2, True), (16, 15, 2, False)]
    assert sorted(tuple(r) for r in state.groups().select("keep_id", "group_size").collect()) == [(0, 2), (1, 2), (13, 2), (15, 2)]


def test_locators_lead_to_the_texts(spark, documents):
    state = exact_dedup.DedupState(spark)
    exact_dedup.exact_groups(documents, state=state)
    found = state.texts_at(state.groups()).join(documents.selectExpr("doc_id AS keep_id", "text"), "keep_id").withColumn("want", exact_dedup.normalised(F.col("text")))
    assert found.where("norm <> want").count() == 0 and found.count() == state.groups().count()
    folder = re.escape(SF)
    assert all(re.match(f"file:/+{folder.lstrip('/')}/documents.parquet", r.file) for r in state.groups().collect())
    again = exact_dedup.exact_groups(documents, state=state).collect()
    assert {r.group_size % 2 for r in again} == {0}


def test_hot_keys_meet_without_a_shuffle_of_their_rows(spark, monkeypatch):
    from rankwright.llm import common

    monkeypatch.setattr("rankwright.functions.shared.BROADCAST_BYTES", 0)
    rows = [(k, "hot text") for k in range(900)] + [(k, f"t{k % 60}") for k in range(900, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    assert shown(exact_dedup.exact_groups(docs)) == exact_brute(rows)
    kept = [r.doc_id for r in exact_dedup.drop_exact_copies(docs.union(docs.where("doc_id < 500"))).collect()]
    assert sorted(kept) == sorted(r[0] for r in exact_brute(rows) if r[3])


def test_dropping_exact_copies(documents, odd_docs):
    want = {r[0] for r in exact_brute([(r.doc_id, r.text) for r in documents.collect()]) if r[3]}
    kept = exact_dedup.drop_exact_copies(documents.union(documents))
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    left = exact_dedup.drop_exact_copies(odd_docs)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()]
    assert left.columns == odd_docs.columns
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd_docs.collect()})


def simhash_brute(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\x0b\xa0İ.", max_size=60))
def test_fingerprint(text):
    assert near_dedup.fingerprint(text) == simhash_brute(text)


def component_brute(fps: list[int], distance: int = 4) -> list[int]:
    """Smallest place reachable, for each place."""
    values = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(k) for k in range(len(fps))]


def test_near_groups_of_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    fps = [simhash_brute(t) for _, t in rows]
    want = {rows[k][0]: (f"{fps[k]:016x}", rows[c][0]) for k, c in enumerate(component_brute(fps))}
    got = near_dedup.near_duplicate_groups(documents).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    kept = near_dedup.drop_near_copies(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def clustered(seed: int, n: int) -> list[int]:
    """Fingerprints in chains and dense balls, so that ranges have to be split."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(6):
        fp = int(r.integers(0, 1 << 63))
        for _ in range(n):
            out.append(fp)
            step = fp
            for b in r.choice(64, r.integers(1, 7), replace=False):
                step ^= 1 << int(b)
            fp = step if r.random() < 0.5 else out[int(r.integers(len(out)))]
    return [*out, *(int(x) for x in r.integers(0, 1 << 63, n))]


def test_links_of_clustered_fingerprints_with_split_ranges(spark):
    fps = sorted(set(clustered(5, 60)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = component_brute(fps)
    for size in (1 << 21, 3000, 40):
        roots = {r.node: r.root for r in near_dedup.components(near_dedup.ball_links(nodes, range_variants=size)).collect()}
        named = [roots.get(f, f) for f in signed]
        assert len(set(zip(named, want))) == len(set(named)) == len(set(want)), size


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)]
    roots = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({roots[k] for k in range(301)}) == 1 and len({roots[1000 + k] for k in range(200)}) == 1
    assert roots[0] != roots[1000]
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_groups_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [simhash_brute(r.text) for r in rows]
    groups = defaultdict(list)
    for r, c in zip(rows, component_brute(fps)):
        groups[c].append(r.doc_id)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = sorted(((r.doc_id, f"{f:016x}", least(groups[c])) for r, f, c in zip(rows, fps, component_brute(fps))), key=repr)
    assert shown(near_dedup.near_duplicate_groups(odd_docs)) == want
    assert near_dedup.near_duplicate_groups(no_docs).collect() == []
    assert near_dedup.drop_near_copies(odd_docs).columns == odd_docs.columns


def test_dropping_near_copies_decides_by_row(spark):
    texts = [" ".join(sha256(f"{k} {j}".encode()).hexdigest()[:8] for j in range(200)) for k in range(6)]
    close = lambda a, b: 0 < (simhash_brute(a) ^ simhash_brute(b)).bit_count() <= 4
    near = lambda k: next(t for j in range(100) if close(t := f"{texts[k]} end{j}", texts[k]))
    rows = [
        (1, texts[0]), (None, near(0)),  # a null id beside an id
        (None, texts[3]), (None, texts[4]),  # unique, without ids
        (None, texts[1]), (None, near(1)), (None, near(1)),  # near copies, none with an id
        (2, texts[2]), (3, near(2)), (3, texts[5]),  # a repeated id, one text of it a near copy
        (7, "once again"), (7, "once again"), (8, None), (8, ""),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    got = [(r.doc_id, r.text or "") for r in near_dedup.drop_near_copies(docs).collect()]
    first = min((texts[1], near(1)), key=lambda t: sha256(t.encode()).digest())
    want = [(1, texts[0]), (None, texts[3]), (None, texts[4]), (None, first), (2, texts[2]), (3, texts[5]), (7, "once again"), (8, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_state_that_is_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").repartition(2)
    first = exact_dedup.DedupState(spark, folder)
    assert not first.used
    exact_dedup.exact_groups(rows((1, "a"), (2, "b")), state=first, digest_digits=0).collect()
    again = exact_dedup.DedupState(spark, folder)  # as a new session does
    assert again.used
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows((11, "zz"), (12, "a")), state=again, digest_digits=0).collect()}
    assert got == {11: (11, 1, True), 12: (1, 2, False)}


def test_a_call_that_failed_counts_once(spark, tmp_path):
    state = exact_dedup.DedupState(spark, f"file://{tmp_path}/state")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    with pytest.raises(Exception):  # the stream fails when the rows are in the inbox
        exact_dedup.exact_groups(docs, state=state, call="monday", files_per_batch=-1).collect()
    for _ in range(2):  # the call again, and once more
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, state=state, call="monday").collect()}
        assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
    more = {r.doc_id: r.group_size for r in exact_dedup.exact_groups(docs, state=state, call="tuesday").collect()}
    assert more == {1: 4, 2: 4, 3: 2}


def test_no_text_is_moved_to_drop_rows(spark, documents, capsys):
    """Whatever the number of rows that go, the plan that leaves them out has no exchange."""
    written_docs = common.written(documents, "plan-test")
    for kept in (exact_dedup.drop_exact_copies(written_docs), near_dedup.drop_near_copies(written_docs), language.keep_identified(written_docs)):
        kept.explain()
        assert "Exchange" not in capsys.readouterr().out


def test_rows_by_their_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(located, "BLOCK_ROWS", 100)
    monkeypatch.setattr(located, "BUCKET_PLACES", 50)
    path = f"{tmp_path}/a b%20c"
    spark.range(3000).withColumn("x.y", F.col("id") % 7).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    assert located.is_located(docs) and not located.is_located(docs.where("id > 5"))
    gone = docs.where("id % 3 = 0").select(*located.place())
    left = located.without_rows(docs, common.written(gone, "t"))
    assert left.columns == docs.columns and sorted(r.id for r in left.collect()) == [k for k in range(3000) if k % 3]
    assert located.without_rows(docs, common.written(gone.limit(0), "t")).count() == 3000
    other = docs.where("id < 10").select(F.lit("file:///no/such/file").alias("file"), F.col("_metadata.row_index").alias("row"))
    assert located.without_rows(docs, common.written(other, "t")).count() == 3000
