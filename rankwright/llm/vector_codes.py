"""Vector code compression: product quantisation in exact integers, assigned by Exponion search.

Vectors are cut into equal parts, each part position has a codebook, and a vector's
code is the number of the nearest entry of each of its parts.  A round assigns every
part and replaces each entry by the floored mean of its parts.

A part starts at the entry that it had in the round before.  An entry that is as
near as that one, at distance r, lies within 2r of it, so the entry's neighbours,
sorted by their distance from it, are scanned up to 2r and no further.  Distances are
squared and whole numbers, so nothing is rounded, and ties go to the lower index.

The vectors are carried through the rounds in two written tables in turn, each with
the codes of its round and one row a task of the sums of its parts, so a round is one
narrow pass and a sum of a row a task; nothing else is shuffled.  Codebooks, of
entries times parts, are all that the driver holds.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_on_counted, require_columns, shared_folder, small_batches, written

#: Fixed values of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components have to be below this size, so that squared distances are whole 64-bit numbers.
LARGEST = 1 << 17


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry of ``book``, ties to the lower index, by Exponion search
    from the entries ``start``; all whole numbers."""
    between = ((book[:, None] - book[None]) ** 2).sum(2)
    neighbours = np.argsort(between, axis=1, kind="stable")
    far = np.take_along_axis(between, neighbours, 1)
    best, at = start.astype(np.int64), start.astype(np.int64)
    least = ((x - book[at]) ** 2).sum(1)
    ball = 4 * least  # the square of twice the distance from the first entry
    active = np.arange(len(x))
    for k in range(len(book)):
        active = active[far[at[active], k] <= ball[active]]
        if not len(active):
            break
        other = neighbours[at[active], k]
        d = ((x[active] - book[other]) ** 2).sum(1)
        better = (d < least[active]) | ((d == least[active]) & (other < best[active]))
        moved = active[better]
        least[moved], best[moved] = d[better], other[better]
    return best, least


def _assigned(vectors: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codes and squared distances [vector, part]."""
    found = [nearest(vectors[:, p], codes[:, p], books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def whole_vectors(df: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows whose vector has neither null nor infinite nor NaN components."""
    v = df[f"`{vector_col}`"].cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    too_large = F.raise_error(F.lit(f"components must be below {LARGEST * SCALE // scale}")).cast("int")
    # A component that is no number is made null first, so that no row fails that is left out anyway.
    whole = lambda x: F.when(bad(x), None).when(F.abs(x) * scale >= LARGEST * SCALE, too_large).otherwise(F.floor(x * float(scale)).cast("int"))
    kept = df.where(v.isNotNull() & ~F.exists(v, bad))
    return kept.select(df[f"`{id_col}`"].cast("long").alias("vec_id"), df[f"`{label_col}`"].cast("string").alias("label"), F.transform(v, whole).alias("v"))


def _pass(rows: DataFrame, books: np.ndarray, *, sums: bool) -> DataFrame:
    """vec_id, label, v, code, error of every row by ``books``, and, if asked for, a row for each task with only ``sums``:
    for every part and entry the number of its parts and the total of each of their components."""
    parts, entries, size = books.shape
    schema = "vec_id long, label string, v array<int>, code binary, error long, sums array<long>"

    def run(batches):
        totals = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, label, v, code = (batch.column(k) for k in range(4))
            vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, size)
            before = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(n, parts)
            codes, errors = _assigned(vectors, before, books)
            if sums:
                for p in range(parts):
                    np.add.at(totals[p, :, 0], codes[:, p], 1)
                    np.add.at(totals[p, :, 1:], codes[:, p], vectors[:, p])
            text = codes.astype(np.uint8).tobytes()
            new = pa.array([text[k : k + parts] for k in range(0, n * parts, parts)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, label, v, new, pa.array(errors.sum(1)), pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "error", "sums"])
        if sums:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([totals.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "error", "sums"])

    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, schema)


def fit_codes(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[np.ndarray, DataFrame]:
    """Codebooks [part, entry, component] and a table vec_id, label, v, code (a byte a part), error (squared distances added up).

    Vectors that are null or hold null or non-finite components are left out.  The others need one length, a multiple of
    ``parts`` (else a ValueError), and components below 131,072 (else Spark's error says so).  The codebooks start as the vectors of the
    smallest ids (repeated ids by their components, null ids last), or as fewer entries where there are fewer vectors; an
    entry that no part is nearest to stays as it is.
    """
    require_columns(df, [id_col, vector_col, label_col])
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte")
    spark = df.sparkSession
    small_batches(spark, 2000)
    rows = whole_vectors(df, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    folders = [shared_folder(spark, "vector-codes") for _ in range(2)]
    schema = "vec_id long, label string, v array<int>, code binary, error long, sums array<long>"
    blank = F.lit(bytes(parts))
    empty = {"error": F.lit(None).cast("long"), "sums": F.lit(None).cast("array<long>")}
    rows.select("*", blank.alias("code"), *(c.alias(n) for n, c in empty.items())).write.parquet(folders[0])
    table = spark.read.schema(schema).parquet(folders[0])
    sizes = table.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes.low is None:
        return np.zeros((parts, 0, 0), np.int64), table.select("vec_id", "label", "v", "code", "error")
    if sizes.low != sizes.high or sizes.low % parts or not sizes.low:
        raise ValueError(f"vectors of {sizes.low} to {sizes.high} components can't be cut into {parts} equal parts")
    first = table.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    shape = (*books.shape[:2], books.shape[2] + 1)
    for k in range(rounds):
        _pass(table.where("v IS NOT NULL"), books, sums=True).write.mode("overwrite").parquet(folders[1 - k % 2])
        table = spark.read.schema(schema).parquet(folders[1 - k % 2])
        each = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "x"))
        total = np.zeros(int(np.prod(shape)), np.int64)
        for r in each.groupBy("place").agg(F.sum("x").alias("x")).collect():  # entries x (components + parts) rows
            total[r.place] = r.x
        total = total.reshape(shape)
        used = total[:, :, 0] > 0
        books[used] = total[:, :, 1:][used] // total[:, :, :1][used]
    last = _pass(table.where("v IS NOT NULL"), books, sums=False).select("vec_id", "label", "v", "code", "error")
    return books, last


def code_report(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``df`` with a whole vector: vec_id, code (two hex digits a part), error, label_error (over all
    rows of that label, nulls together), codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components have no row; repeated rows and null ids stay; an empty
    table gives an empty result; other columns are ignored.  See ``fit_codes`` for what vectors have to be like.
    """
    books, coded = fit_codes(df, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, entries=entries, rounds=rounds)
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A null label gets a name that no other can have.
    name = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("-")).alias("name")
    rows = written(coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", name), "vector-errors")
    by_label = written(rows.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "vector-labels")
    total = by_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    joined = join_on_counted(rows, by_label, "name", "n", total)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def restored(coded: DataFrame, books: np.ndarray, *, scale: int = SCALE) -> DataFrame:
    """``coded`` (with code) with approx: the vector that the code stands for."""
    flat = [[[(float(x) + 0.5) / scale for x in entry] for entry in book] for book in books.tolist()]
    listed = F.array(*(F.array(*(F.array(*map(F.lit, entry)) for entry in book)) for book in flat))
    index = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return coded.withColumn("approx", F.concat(*(F.get(F.get(listed, F.lit(p)), index(p)) for p in range(len(flat)))))
