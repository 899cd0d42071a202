"""The pipeline's stages against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankwright.llm.common import written
from rankwright.llm.queries import ORACLES, QUERIES

from .conftest import SF
from .test_dedup import component_brute, simhash_brute
from .test_tokens import check_packed


def test_stages(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    seen = [documents]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    start, known, unique, apart, clean, packed = ({r.doc_id: r for r in df.collect()} for df in seen)
    assert len(known) > 0.97 * len(start) and all(known[d] == start[d] for d in known)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first: dict[str, int] = {}
    for d in sorted(known):
        first.setdefault(norm(known[d].text), d)
    assert set(unique) == set(first.values())
    ids = sorted(unique)
    assert set(apart) == {ids[k] for k in component_brute([simhash_brute(unique[d].text) for d in ids])}
    assert set(clean) == set(apart) == set(packed)
    for df in seen[1:-1]:
        assert df.columns == documents.columns
    check_packed(seen[-1].collect(), {d: r.text for d, r in clean.items()})
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == seen[-1].columns and run.count() == seen[-1].count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    plain = lambda df: sorted(tuple(None if v != v else v for v in r) for r in df.itertuples(index=False))
    assert plain(got) == plain(want)


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.select(no_docs.columns), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "odd")
    assert docs.collect() == []


#: Names that the stages use beside a document's own columns, and some that look like results.
CLASHING = """_row _text _declared _host _suffix _like _post _h _s _n _sums _by_suffix _spoken _scores _sum language _sha _id _gone _spared
repo owner value_sha256 kind posterior kept keep_id group_size text_sha256 component_id fingerprint root fp piece sequence_id offset _part _nth""".split()


def test_stages_carry_columns_with_clashing_names(spark, odd_docs, no_docs):
    plain = odd_docs.select(no_docs.columns)
    odd = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)), F.lit("dot").alias("a.b"))
    for name, stage in corpus_pipeline.STAGES:
        got, want = (written(stage(spark, d, SF), "clash") for d in (odd, plain))
        key = lambda r: tuple(map(str, r))
        if name == "best_fit_packing":
            same = ["doc_id", "piece", "start", "length", "ids_crc32"]
            assert sorted(got.select(same).collect(), key=key) == sorted(want.select(same).collect(), key=key)
            continue
        assert got.columns == odd.columns
        rows = sorted(got.collect(), key=key)
        assert [r[: len(plain.columns)] for r in rows] == [tuple(r) for r in sorted(want.collect(), key=key)]
        assert {r[len(plain.columns) :] for r in rows} == {(*range(len(CLASHING)), "dot")}
