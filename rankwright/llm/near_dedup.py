"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 2r share a variant at a distance of at
most r from either, so each fingerprint emits its ball of radius r and those
that meet in a variant are linked.  The variants are dealt out by their leading
bits: a fingerprint is sent once to each range of variants that its ball reaches,
and the task that owns the range spells out the variants that lie in it.  That
moves tens of rows for a fingerprint where the ball has 2,081 variants.  A range
that would hold too many variants is cut by further bits until it doesn't.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on_counted, require_columns, small_batches, written
from .located import located, place, without_rows

BITS, SEED, SHINGLE = 64, 42, 4
#: Variants that one task spells out at a time (8 bytes each, and as much again to sort).
RANGE_VARIANTS = 1 << 20
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a lower-cased text; no word gives zero."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[words - 1 :].tolist())]
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + (np.arange(8, dtype=np.int64) * 256)).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, *where: Column) -> DataFrame:
    """doc_id, sha (of the text), what says ``where`` a row is (file and row), and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "sha", "file", "row", "fp"]

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(4).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(found.view(np.int64))], names=names)

    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), *where, text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, sha binary, file string, row long, fp long")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row.  Null text counts as empty, and a text without a word has
    the fingerprint zero; null and repeated ids stay; an empty table gives an empty result."""
    require_columns(docs, [id_col, text_col])
    none = F.lit(None)
    return _fingerprints(docs, id_col, text_col, words, none.cast("string").alias("file"), none.cast("long").alias("row")).select("doc_id", "fp")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with exactly ``flips`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], np.uint64)


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def range_links(fps: np.ndarray, flips: np.ndarray, prefix_bits: int, radius: int) -> np.ndarray:
    """Links (fingerprint, smallest that shares a variant) among the fingerprints of one range.

    ``flips`` says how many bits of the prefix a fingerprint has to change to get into the range.  All
    fingerprints that share a variant are linked with each other, so the star to the smallest keeps
    every component; each link is verified by its distance.
    """
    low = BITS - prefix_bits
    keep = np.uint64((1 << low) - 1)
    keys, owners = [], []
    for used in range(radius + 1):
        own = np.flatnonzero(flips == used)
        for more in range(min(radius - used, low) + 1) if len(own) else ():
            masks = _masks(low, more)
            keys.append(((fps[own] & keep)[:, None] ^ masks).ravel())
            owners.append(np.repeat(own, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    if len(key) < 2:
        return np.empty((0, 2), np.uint64)
    # Sort a hash with the place behind it in one word; equal hashes are then compared in full.
    place_bits = int(len(key) - 1).bit_length()
    tagged = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(place_bits) << np.uint64(place_bits) | np.arange(len(key), dtype=np.uint64)
    tagged.sort()
    same = (tagged[1:] ^ tagged[:-1]) >> np.uint64(place_bits) == 0
    met = (tagged & np.uint64((1 << place_bits) - 1))[np.r_[same, False] | np.r_[False, same]].astype(np.int64)
    if not len(met):
        return np.empty((0, 2), np.uint64)
    key, fp = key[met], fps[owner[met]]
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    least = np.repeat(fp[begins], np.diff(np.r_[begins, len(fp)]))
    pairs = np.unique(np.stack([fp, least], 1)[fp != least], axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * radius]


def ball_links(nodes: DataFrame, *, radius: int = 2, range_variants: int = RANGE_VARIANTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` at most 2 * radius apart."""
    count = nodes.count()
    bits = 4
    while bits < BITS - radius and count * _ball(BITS, radius) > range_variants << bits:
        bits += 1
    links = None
    # Rows: fp, the variants' prefix, its bits, and the flips spent on it.
    rows = nodes.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("flips"))
    done, step = 0, bits
    while True:
        rows = _deal(rows, done, step, radius)
        done += step
        spelled = F.create_map(*(F.lit(x) for k in range(radius + 1) for x in (k, _ball(BITS - done, radius - k))))[F.col("flips")]
        rows = written(rows, "ball-ranges")
        heavy = None
        if done < BITS:
            heavy = rows.groupBy("prefix").agg(F.sum(spelled).alias("variants")).where(F.col("variants") > 4 * range_variants).select("prefix")
            heavy = written(heavy, "ball-heavy")
        light = rows
        split = heavy is not None and not heavy.isEmpty()
        if split:
            light = rows.join(heavy, "prefix", "left_anti")
        found = _spell(light, done, radius) if done < BITS else _meet(light)
        links = found if links is None else links.unionByName(found)
        if not split:
            return links.distinct()
        rows, step = rows.join(heavy, "prefix", "left_semi"), min(6, BITS - done)


def _deal(rows: DataFrame, done: int, step: int, radius: int) -> DataFrame:
    """Send every fingerprint to the ranges, ``step`` bits finer, that its ball reaches."""
    own = F.shiftrightunsigned("fp", BITS - done - step).bitwiseAND(F.lit((1 << step) - 1)).cast("long")
    masks = F.array(*(F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(k).alias("k")) for k in range(min(radius, step) + 1) for m in _masks(step, k)))
    dealt = rows.select("fp", "prefix", "flips", own.alias("own"), F.explode(masks).alias("x"))
    return dealt.where(F.col("flips") + F.col("x.k") <= radius).select(
        "fp", (F.shiftleft("prefix", step).bitwiseOR(F.col("own").bitwiseXOR(F.col("x.m")))).alias("prefix"), (F.col("flips") + F.col("x.k")).alias("flips")
    )


def _spell(rows: DataFrame, done: int, radius: int) -> DataFrame:
    def links(group: pd.DataFrame) -> pd.DataFrame:
        pairs = range_links(group["fp"].to_numpy(np.int64).view(np.uint64), group["flips"].to_numpy(), done, radius).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("prefix").applyInPandas(links, "a long, b long")


def _meet(rows: DataFrame) -> DataFrame:
    """Ranges of a single variant: its fingerprints are linked with the smallest by a join, whatever their number."""
    least = rows.groupBy("prefix").agg(F.min("fp").alias("b"))
    return rows.join(least, "prefix").where("fp <> b").select(F.col("fp").alias("a"), "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): equal roots are connected.

    Rounds of contraction: each node goes to the neighbour, or itself, with the least of a hash that is
    new in each round, until no link is left.  Minima are taken within tasks first, and the links of a node
    that has very many of them, the hub of a star, stay where they are.  Nothing but counts comes to the driver.
    """
    maps: list[DataFrame] = []
    edges = written(links.select("a", "b"), "links")
    while count := edges.count():
        seed = F.lit(len(maps))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("r"), F.count("*").alias("links"))
        step = best.select(F.col("a").alias("node"), F.least("r", F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("n")))["n"].alias("root"), "links")
        step = written(step, "component-step")
        maps.append(step.select("node", "root"))
        to_a, to_b = step.toDF("a", "ra", "links"), step.toDF("b", "rb", "links")
        half = join_on_counted(edges, to_a, "a", "links", 2 * count).drop("links")
        moved = join_on_counted(half, to_b, "b", "links", 2 * count).where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1]
    for step in reversed(maps[:-1]):
        # A root that gathered very many nodes is met by a broadcast; roots that went no further keep their nodes.
        after = step.groupBy("root").agg(F.count("*").alias("n")).join(roots.toDF("root", "last"), "root", "left").select("root", F.coalesce("last", "root").alias("last"), "n")
        met = join_on_counted(step, written(after, "component-after"), "root", "n", step.count())
        roots = written(met.select("node", F.col("last").alias("root")), "component-roots")
    return roots


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, range_variants: int = RANGE_VARIANTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id, the smallest id reachable over
    links of at most 2 * radius differing bits.

    Null text counts as empty; texts without a word have the fingerprint zero and link as any other.  Null
    ids are never the smallest unless a component has no other.  Repeated rows stay, other columns are
    ignored, and an empty table gives an empty result.
    """
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    named = _with_first(marked, F.col("doc_id"), radius, range_variants)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def _with_first(marked: DataFrame, order: Column, radius: int = 2, range_variants: int = RANGE_VARIANTS) -> DataFrame:
    """``marked`` with first: the least ``order`` among the rows of the fingerprint's component."""
    nodes = written(marked.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "fingerprint-nodes")
    roots = components(ball_links(nodes, radius=radius, range_variants=range_variants))
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    size = rooted.agg(F.count("*").alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    least = written(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("fps")), "fingerprint-least")
    named = written(join_on_counted(rooted.select("fp", "root", "n"), least, "root", "fps", size.fps).select("fp", "first", "n"), "fingerprint-first")
    return join_on_counted(marked, named, "fp", "n", size.rows).drop("n")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component: the one with the smallest id, nulls last, of several
    texts under that id the one with the least SHA-256, and of rows that repeat both the first.  Null text counts as empty, an empty table gives an empty result, and all columns
    stay.  The rows that go are known by their places in the table's files, so no text is moved for them to be left out."""
    require_columns(docs, [id_col, text_col])
    docs = located(docs, "near-copies")
    marked = written(_fingerprints(docs, id_col, text_col, SHINGLE, *place()), "fingerprints")
    named = _with_first(marked, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "file", "row"))
    stays = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    return without_rows(docs, written(named.where(~stays).select("file", "row"), "near-gone"))
