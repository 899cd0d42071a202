"""Permutations of places that need no sort: a keyed bijection, computed for each place on its own.

Four rounds of a Feistel network mix the two halves of a place's bits; what falls beyond
the number of places is put through again until it falls inside (cycle walking).  The
network covers less than four times as many places as there are, so four turns do on
average, and each place has exactly one image, whatever the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROUNDS = 4


def permuted_places(places: np.ndarray, count: int, key: int) -> np.ndarray:
    """The image of each of ``places`` (0 to ``count`` - 1) under the permutation of ``key``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    seeds = np.random.default_rng([key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]).integers(1, 1 << 62, _ROUNDS, dtype=np.uint64)
    out = np.asarray(places).astype(np.uint64)
    outside = np.arange(len(out))
    while len(outside):
        x = out[outside]
        left, right = x >> shift, x & mask
        for seed in seeds:
            mixed = (right + seed) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (mixed >> np.uint64(32))) & mask
        x = left << shift | right
        out[outside] = x
        outside = outside[x >= np.uint64(count)]
    return out.astype(np.int64)


def permuted_columns(rows: DataFrame, count: int, width: int, seed: int) -> DataFrame:
    """place, mixed: the features of ``rows`` (place from 0 to ``count`` - 1, features) with every column permuted on its own.

    Each value is sent once to the place that its column's permutation gives it: one shuffle for all columns."""

    def deal(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.array(batch.column(1).to_pylist(), float).reshape(n, width)
            for k in range(width):
                to = permuted_places(place, count, seed * 1_000_003 + k)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(n, k, np.int32)), pa.array(values[:, k])], names=["place", "k", "v"])

    dealt = rows.select("place", F.transform("features", lambda v: v.cast("double")).alias("v")).mapInArrow(deal, "place long, k int, v double")
    listed = F.array_sort(F.collect_list(F.struct("k", "v")))  # one for each column
    return dealt.groupBy("place").agg(F.transform(listed, lambda x: x["v"]).alias("mixed"))
