"""Exact deduplication by a stateful stream.

A stream of (digest, part, id, content locator) feeds an aggregation whose keyed
state lies on disk in RocksDB and never expires; the state holds, for each
digest, the smallest id, the locator of that text and the number of texts.  A
locator names a file and a row of it, from which the text is read again.  Before
new documents enter the state, the digests that are hit, among themselves or in
the state, are checked by the full bytes of their texts; texts that differ under
one digest get parts of their own.  Spark adds up within a task before it
shuffles, so a text with very many copies costs a row a task.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, join_on_counted, require_columns, shared_folder, written
from .located import RowSet, is_located, located, place, without_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STREAM = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each of the state's partitions sets 4 MB aside for its manifest alone.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
_KEYS = "digest string, part string, doc_id long, file string, row long"
_FIRST = "struct<no_id: boolean, doc_id: long, file: string, row: long>"


def normalised(text):
    """The text in which every run of white space is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DedupState:
    """The stream's state in a shared folder; ``absorb`` may be called again with later documents.

    Locators point into the tables that were given, as long as they are plain Parquet tables, which then have to
    stay as they are, else into copies of the texts in the shared folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, text_col: str = "text"):
        self.spark, self.folder, self.text_col = spark, folder or shared_folder(spark, "dedup"), text_col

    def _written(self, name: str) -> bool:
        try:
            self.spark.read.schema("x int").parquet(f"{self.folder}/{name}")
            return True
        except AnalysisException:
            return False

    @property
    def used(self) -> bool:
        """Whether the folder holds documents of earlier calls, of this session or another."""
        return self._written("changes")

    def located(self, docs: DataFrame, id_col: str) -> DataFrame:
        """doc_id, norm, file, row of every row of a located table: the normalised text and where it stands."""
        return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), normalised(docs[f"`{self.text_col}`"]).alias("norm"), *place())

    def texts_at(self, locators: DataFrame) -> DataFrame:
        """``locators`` (file, row, ...) with norm, the text that stands there; only files that are named are read."""
        # No more names than Spark's own list of the files that the state was fed from.
        names = sorted(r.file for r in locators.select("file").distinct().collect())
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(n)) for n in names]
        content = self.spark.read.schema(f"`{self.text_col}` string")
        content = content.parquet(*paths) if paths else self.spark.createDataFrame([], f"`{self.text_col}` string, _metadata struct<file_path: string, row_index: long>")
        read = content.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col(f"`{self.text_col}`")).alias("norm"))
        return locators.join(read, ["file", "row"])

    def absorb(self, keys: DataFrame, files_per_batch: int | None = None, *, call: str | None = None) -> None:
        """Run the stream over ``keys`` (digest, part, doc_id, file, row) until all of it is in the state.

        A ``call`` that failed may be made again under its name: keys that lie in the inbox already are not written a
        second time, and the stream goes on from its checkpoint, so that no row counts twice.
        """
        spark, inbox, out = self.spark, f"{self.folder}/inbox", f"{self.folder}/changes"
        call = call or uuid.uuid4().hex
        if not self._written(f"calls/{call}"):
            keys.select("digest", "part", "doc_id", "file", "row").write.mode("overwrite").parquet(f"{inbox}/{call}")
            spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/calls/{call}")
        # An id that is null stands behind all others.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))
        source = spark.readStream.schema(_KEYS)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        state = source.parquet(f"{inbox}/*").groupBy("digest", "part").agg(first.alias("first"), F.count("*").alias("n"))

        def save(changed: DataFrame, batch: int) -> None:
            changed.select("digest", "part", "first", "n").write.mode("overwrite").parquet(f"{out}/batch={batch}")

        before = {k: spark.conf.get(k, None) for k in _STREAM}
        try:
            for k, v in _STREAM.items():
                spark.conf.set(k, v)
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(save).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """digest, part, keep_id, file, row, group_size as of now."""
        if not self.used:
            return self.spark.createDataFrame([], "digest string, part string, keep_id long, file string, row long, group_size long")
        changes = self.spark.read.schema(f"digest string, part string, first {_FIRST}, n long, batch int").parquet(f"{self.folder}/changes")
        # A batch holds a key once; of several batches the last one has the whole count.
        last = changes.groupBy("digest", "part").agg(F.max(F.struct("batch", "n", "first")).alias("s"))
        return last.select("digest", "part", F.col("s.first.doc_id").alias("keep_id"), F.col("s.first.file").alias("file"), F.col("s.first.row").alias("row"), F.col("s.n").alias("group_size"))


def _with_parts(texts: DataFrame, keys: DataFrame, state: DedupState) -> DataFrame:
    """``keys`` with part, by which texts that differ under one digest are told apart.

    Every digest that is hit is checked by full bytes: the distinct texts under it, of these documents and of the
    state's, must be one.  Tasks leave out what they have seen, so of many copies a text a task is moved.
    """
    counted = keys.groupBy("digest").agg(F.count("*").alias("n"))
    hits, earlier = counted.where("n > 1"), None
    if state.used:
        found = state.groups().join(counted.select("digest"), "digest", "left_semi").select("digest", "part", "file", "row")
        earlier = written(state.texts_at(written(found, "dedup-locators")).select("digest", "part", "norm"), "dedup-earlier")
        known = earlier.select("digest").distinct().withColumn("known", F.lit(True))
        hits = counted.join(known, "digest", "left").where("n > 1 OR known").select("digest", "n")
    hits = written(hits, "dedup-hits")
    rows = join_on_counted(keys.select("digest", "file", "row"), hits, "digest", "n", keys.count())
    # Only the rows that are hit leave the table, and of each task's equal texts one.
    seen = texts.where(RowSet(written(rows.select("file", "row"), "dedup-hit-rows")).holds(F.col("file"), F.col("row"))).select("digest", "norm")
    seen = (seen if earlier is None else seen.union(earlier.select("digest", "norm"))).distinct()
    collided = written(seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "dedup-collided")
    plain = keys.withColumn("part", F.lit(""))
    if collided.isEmpty():
        return plain
    # A text's part is that of the state if it is there, else the place of its first row: no two texts have that.
    odd = texts.join(broadcast_if_small(collided, collided.count(), 96), "digest", "left_semi")
    own = odd.groupBy("digest", "norm").agg(F.min(F.struct("file", "row")).alias("at")).select("digest", "norm", F.concat_ws("#", "at.file", "at.row").alias("own"))
    if earlier is None:
        named = own.withColumnRenamed("own", "part")
    else:
        named = own.join(earlier, ["digest", "norm"], "left").select("digest", "norm", F.coalesce("part", "own").alias("part"))
    apart = odd.join(named, ["digest", "norm"]).select(*keys.columns, "part")
    return written(plain.join(collided, "digest", "left_anti").unionByName(apart), "dedup-parts")


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest_digits: int, state: DedupState, files_per_batch: int | None, call: str | None) -> DataFrame:
    """doc_id, text_sha256, file, row of every row of ``docs`` (located), and keep_id, group_size and keep_file, keep_row: the
    place of the text that stays."""
    if state.text_col != text_col:
        raise ValueError(f"the state's texts are in {state.text_col}")
    texts = state.located(docs, id_col).withColumn("text_sha256", F.sha2("norm", 256))
    texts = texts.withColumn("digest", F.substring("text_sha256", 1, digest_digits))
    keys = written(texts.select("digest", "doc_id", "file", "row", "text_sha256"), "dedup-keys")
    keys = _with_parts(texts, keys, state)
    state.absorb(keys, files_per_batch, call=call)
    groups = written(state.groups().select("digest", "part", "keep_id", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), "group_size"), "dedup-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first().n
    return join_on_counted(keys.select("digest", "part", "doc_id", "text_sha256", "file", "row"), groups, ["digest", "part"], "group_size", total)


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_digits: int = 64, state: DedupState | None = None, files_per_batch: int | None = None, call: str | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after normalisation; the smallest id of equal texts stays.  With a ``state`` that
    has seen documents before, those count as well, whichever session they came in; a ``call`` that failed can be made
    again under its name.  Null text counts as empty, null ids stand behind all others, rows that repeat both id and
    text are the same document and all say ``kept``; an empty table gives an empty result.  Other columns are ignored.
    ``digest_digits`` below 64 makes digests collide, which the check by full bytes then tells apart; one state wants
    the same number always.
    """
    require_columns(docs, [id_col, text_col])
    state = state or DedupState(docs.sparkSession, text_col=text_col)
    narrow = docs if is_located(docs) else written(docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string").alias(text_col)), "dedup-content")
    rows = _grouped(narrow, id_col, text_col, digest_digits, state, files_per_batch, call)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies: of equal texts the row with the smallest id stays, and once.

    The rows that go are known by their places in the table's files, so no text is moved for them to be left out."""
    require_columns(docs, [id_col, text_col])
    docs = located(docs, "dedup-content")
    rows = _grouped(docs, id_col, text_col, 64, DedupState(docs.sparkSession, text_col=text_col), None, None)
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return without_rows(docs, written(rows.where(~stays).select("file", "row"), "dedup-gone"))
