"""Fold tables and predictions compared by fingerprints, held against counts in plain Python."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F
from rankwright.functions import multisets
from rankwright.operators import folds, scoring


def counted(rows, outer, inner):
    """The six checks, by plain Python."""
    ids, seen = set(rows), Counter(i for _, i in outer)
    pairs, there = set(outer), Counter(inner)
    return {
        "outer_missing": sum(i is None or not seen[i] for i in ids),
        "outer_extra": sum(i is None or i not in ids for _, i in outer),
        "outer_repeated": sum(n > 1 for n in seen.values()),
        "inner_repeated": sum(n > 1 for n in there.values()),
        "inner_holds_outer_validation": sum(p in pairs and p[1] is not None for p in inner),
        "inner_incomplete": sum(i is None or (f, i) not in there for own, i in outer for f in {f for f, _ in outer} if f != own),
    }


def test_fold_tables_that_break(spark):
    r = random.Random(5)
    for case in range(9):
        ids = list(range(60))
        outer = [(i % 3 + 1, i) for i in ids]
        inner = [(f, i) for f in (1, 2, 3) for own, i in outer if own != f]
        rows = list(ids)
        if case == 1:
            inner.remove(r.choice(inner))
        if case == 2:
            inner[3] = inner[4]
        if case == 3:
            inner.append(outer[7])
        if case == 4:
            outer.append((2, 3))
        if case == 5:
            rows += [None, 500, 500, 1]
        if case == 6:
            outer += [(1, None), (2, 900)]
        if case == 7:
            inner = []
        if case == 8:
            rows, outer, inner = [], [], []
        tables = (spark.createDataFrame([(*o, 0) for o in outer], "outer_fold int, id long, extra int").select("outer_fold", "id"), spark.createDataFrame([(*i, 1) for i in inner], "outer_fold int, id long, inner_fold int"), spark.createDataFrame([(i, 0) for i in rows], "id long, y int"))
        got = [(x.name, x.violations) for x in folds.split_integrity(*tables).collect()]
        assert [n for n, _ in got] == list(folds.CHECKS) and dict(got) == counted(rows, outer, inner), case


def test_complete_pairs_by_fingerprint(spark):
    r = random.Random(8)
    outer = [(f, 10 * f + i) for f in (1, 2) for i in range(6)] + [(3, 90), (3, 90), (4, 95), (4, None), (5, 97)]
    pairs, rows = {}, []
    for f in (1, 2, 3, 4, 5, 6):
        own = [i for g, i in outer if g == f]
        for config, samples in {"all": own, "short": own[1:], "twice": [*own[1:], *own[-1:]], "more": [*own, 1000], "null": [*own[1:], None], "other": [i + 10 if i else i for i in own]}.items():
            pairs[f, config] = samples
            rows += [(f, config, s) for s in samples]
    r.shuffle(rows)
    manifest = Counter(outer)
    want = {(f, c) for (f, c), s in pairs.items() if s and None not in s and sorted(s) == sorted({i for g, i in outer if g == f} - {None}) and all(manifest[f, i] == 1 for i in s) and manifest[f, None] == 0}
    got = scoring.complete_pairs(spark.createDataFrame(rows, "outer_fold int, recipe_config_id string, sample_index int"), spark.createDataFrame(outer, "outer_fold int, id long"))
    assert {tuple(x) for x in got.collect()} == want and {(1, "all"), (2, "all")} <= want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sample_index" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_fingerprints_add_up(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    by = {x.g: x for x in df.groupBy("g").agg(*multisets.multiset_print("id")).collect()}
    whole = df.agg(*multisets.multiset_print("id")).first()
    assert all(by[0][p] + by[1][p] == whole[p] and by[0][p] != by[1][p] for p in multisets.PIECES)
    text = df.agg(*multisets.multiset_print("id")).first(), df.select(F.col("id").cast("string").alias("id")).agg(*multisets.multiset_print("id")).first()
    assert text[0] == text[1]
