"""Vector best-fit packing of tokenised documents into sequences.

Only the length of a piece decides where it fits, so the plan is made from the
histogram of lengths: at most ``capacity`` counts, whatever the corpus holds.
Bins that look alike are kept as one run of sequence ids, and each step of the
plan says: pieces number a..b of length L go to the bins from s on, q to a bin,
at offset o.  Pieces find their step by length and by their number among the
pieces of that length, which comes from a range-partitioned sort.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches, written
from .tokens import pack, word_level

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacities:
    """What one sequence may hold: tokens, pieces, and attention cost (the sum of squared piece lengths).

    The defaults of the last two can never bind before the tokens do, so that as few sequences as
    possible come out; lower them to bound the pieces or the attention work of a sequence.
    """

    tokens: int = 4096
    pieces: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"


def plan(counts: dict[int, int], cap: Capacities = Capacities()) -> tuple[np.ndarray, int]:
    """Steps (length, first piece, pieces, first sequence, pieces a bin, offset), and the number of sequences.

    Lengths go from long to short.  Among the runs of bins that can take a piece under all three
    capacities, the one with the smallest weighted residual norm after it (rule ``norm``) or the smallest
    weighted dot product of demand and residual (rule ``dot``) is filled first; ties go to the first made.
    """
    if cap.rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {cap.rule}")
    limits = np.array([cap.tokens, cap.pieces, cap.attention], dtype=np.float64)
    weights = np.array(cap.weights)
    runs: list[list[int]] = []  # first sequence, bins, tokens used, pieces, attention used
    steps: list[tuple[int, int, int, int, int, int]] = []
    made = 0
    for length in sorted(counts, reverse=True):
        if length <= 0 or length > cap.tokens or length * length > cap.attention:
            raise ValueError(f"a piece of {length} tokens can't fit")
        left, rank = counts[length], 0
        order: list[int] = []
        if runs:
            state = np.array(runs, dtype=np.int64)
            rest = np.stack([cap.tokens - state[:, 2], cap.pieces - state[:, 3], cap.attention - state[:, 4]], 1)
            demand = np.array([length, 1, length * length], dtype=np.int64)
            fits = np.flatnonzero((rest >= demand).all(1))
            if cap.rule == "norm":
                score = (weights * ((rest[fits] - demand) / limits) ** 2).sum(1)
            else:
                score = (weights * (demand / limits) * (rest[fits] / limits)).sum(1)
            order = fits[np.lexsort((state[fits, 0], score))].tolist()
        fresh: list[list[int]] = []
        gone: set[int] = set()

        def fill(run: list[int], left: int, rank: int) -> tuple[int, int]:
            """Put pieces into a run of bins; what is touched becomes up to three new runs."""
            first, bins, tokens, pieces, cost = run
            each = min((cap.tokens - tokens) // length, cap.pieces - pieces, (cap.attention - cost) // (length * length))
            whole = min(bins, left // each)
            if whole:
                steps.append((length, rank, whole * each, first, each, tokens))
                fresh.append([first, whole, tokens + each * length, pieces + each, cost + each * length * length])
                rank, left = rank + whole * each, left - whole * each
            if left and whole < bins:
                steps.append((length, rank, left, first + whole, left, tokens))
                fresh.append([first + whole, 1, tokens + left * length, pieces + left, cost + left * length * length])
                rank, left, whole = rank + left, 0, whole + 1
            if whole < bins:
                fresh.append([first + whole, bins - whole, tokens, pieces, cost])
            return left, rank

        for k in order:
            if not left:
                break
            gone.add(k)
            left, rank = fill(runs[k], left, rank)
        if left:
            each = min(cap.tokens // length, cap.pieces, cap.attention // (length * length))
            bins = -(-left // each)
            left, rank = fill([made, bins, 0, 0, 0], left, rank)
            made += bins
        runs = [r for k, r in enumerate(runs) if k not in gone] + fresh
        runs = [r for r in runs if r[2] < cap.tokens and r[3] < cap.pieces and r[4] < cap.attention]
    return np.array(steps, dtype=np.int64).reshape(-1, 6), made


def pieces_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise with word_bpe_49k.json, append ``end_id`` and cut documents of more than ``capacity`` ids.

    Null text counts as empty and gives one piece with the end id; null and repeated ids stay as they are.
    """
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    end, width = pack([end_id]), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches):
        encode = word_level().encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, cap: Capacities = Capacities()) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...), in place of columns of those names.

    The pieces are sorted over range partitions by length and id; a partition numbers its own pieces of
    each length.  The counts of (partition, length), at most partitions plus lengths of them since the
    partitions are ranges of lengths, go to the driver, and the plan made there goes to all executors.
    Other columns stay, whatever their names; null and repeated ids are pieces like any other, and repeated rows
    are packed as often as they stand there.  An empty table gives an empty result.
    """
    require_columns(pieces, ["doc_id", "piece", "length"])
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    own = lambda name: name if name not in {n.lower() for n in names} else own(name + "_")
    part_col, nth_col = own("_part"), own("_nth")
    ordered = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            at = np.arange(len(lengths))
            begins = np.maximum.accumulate(np.where(np.r_[True, lengths[1:] != lengths[:-1]], at, 0))
            nth = at - begins
            if lengths[0] == last:
                nth[lengths == last] += seen
            last, seen = lengths[-1], nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(nth, pa.int64())], names=[*names, part_col, nth_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    numbered = written(ordered.mapInArrow(number, f"{fields}, {part_col} int, {nth_col} long"), "numbered-pieces")
    seen = numbered.groupBy(F.col(part_col).alias("part"), F.col("length").alias("length")).agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(seen, key=lambda r: (r.length, r.part)):
        base[row.part, row.length] = counts.get(row.length, 0)
        counts[row.length] = base[row.part, row.length] + row.n
    steps, _ = plan(counts, cap)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    shared = spark.sparkContext.broadcast((base, steps))

    def place(batches):
        base, steps = shared.value
        key = steps[:, 0] * (1 << 48) + steps[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            parts = batch.column(part_col).to_numpy()
            begins = np.flatnonzero(np.r_[True, (lengths[1:] != lengths[:-1]) | (parts[1:] != parts[:-1])])
            first = np.array([base[int(parts[k]), int(lengths[k])] for k in begins])
            rank = np.repeat(first, np.diff(np.r_[begins, len(lengths)])) + batch.column(nth_col).to_numpy()
            step = steps[np.searchsorted(key, lengths * (1 << 48) + rank, side="right") - 1]
            nth = rank - step[:, 1]
            sequence = step[:, 3] + nth // step[:, 4]
            offset = step[:, 5] + nth % step[:, 4] * lengths
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, cap: Capacities = Capacities(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and is its end id alone; null and repeated ids stay, each row packed on its own; an empty
    table gives an empty result; other columns are ignored."""
    pieces = written(pieces_of(docs, id_col=id_col, text_col=text_col, capacity=cap.tokens), "pieces")
    return pack_pieces(pieces, cap)
