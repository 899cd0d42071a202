"""Token-id files: independent zstandard frames, a trailing seek table, one checksum for each frame.

A shard is a sequence of zstandard frames and, at its end, the seek table of the
public "zstd seekable format": a skippable frame with compressed size,
decompressed size and the low 32 bits of XXH64 for every frame.  Any zstandard
tool can read a shard.  A skippable frame before the seek table holds the first
and the last id of every frame, so that a reader of single documents decompresses
their frames and no others.

A frame, decompressed, holds: u32 documents, u32 bytes of an id (2 or 4), then
for the documents i64 ids, u8 null marks and u32 token counts, then the tokens.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require_columns, shared_folder, small_batches, written
from .tokens import byte_level, pack

#: Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The skippable frame of first and last ids (a magic number that zstandard leaves to users), and an entry of it:
#: first id, last id, and whether each of them is null.
IDS_MAGIC, IDS = 0x184D2A53, struct.Struct("<qqBB")
FRAME_BYTES = 1 << 20
MANIFEST = (
    "shard int, file string, frame int, position long, packed_bytes long, raw_bytes long, checksum long, "
    "n_docs long, n_tokens long"
)


class FrameWriter:
    """Gathers documents into frames of about ``frame_bytes`` and writes them to an open stream."""

    def __init__(self, stream, id_bytes: int, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.stream, self.id_bytes, self.frame_bytes = stream, id_bytes, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int, int, int, int]] = []
        self.ends: list[bytes] = []
        self.position = 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.nulls, self.counts, self.tokens, self.held = [], [], [], [], 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        """tokens: little-endian unsigned 32-bit ids."""
        count = len(tokens) // 4
        if self.id_bytes == 2:
            wide = np.frombuffer(tokens, "<u4")
            if count and wide.max() > 0xFFFF:
                raise ValueError(f"id {wide.max()} doesn't fit into two bytes")
            tokens = wide.astype("<u2").tobytes()
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(count)
        self.tokens.append(tokens)
        self.held += len(tokens) + 13
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        raw = b"".join(
            [
                struct.pack("<II", len(self.ids), self.id_bytes),
                np.array(self.ids, "<i8").tobytes(),
                np.array(self.nulls, "u1").tobytes(),
                np.array(self.counts, "<u4").tobytes(),
                *self.tokens,
            ]
        )
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.frames.append((self.position, len(packed), len(raw), check, len(self.ids), sum(self.counts)))
        self.ends.append(IDS.pack(self.ids[0], self.ids[-1], self.nulls[0], self.nulls[-1]))
        self.position += len(packed)
        self._clear()

    def close(self) -> None:
        self.flush()
        ends = b"".join(self.ends)
        self.stream.write(struct.pack("<II", IDS_MAGIC, len(ends)) + ends)
        entries = b"".join(struct.pack("<III", f[1], f[2], f[3]) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


def read_seek_table(stream) -> list[tuple[int, int, int, int]]:
    """(position, packed bytes, raw bytes, checksum) of every frame, from the end of a shard."""
    size = stream.size()
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
        raise ValueError("no seek table at the end of the file")
    stream.seek(size - 9 - 12 * n)
    sizes = list(struct.iter_unpack("<III", stream.read(12 * n)))
    out, position = [], 0
    for packed, raw, check in sizes:
        out.append((position, packed, raw, check))
        position += packed
    return out


def read_frame(stream, position: int, packed: int, raw: int, check: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, tokens as little-endian unsigned 32-bit) of one frame; the checksum is compared first."""
    stream.seek(position)
    data = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=raw)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"checksum of the frame at {position} differs")
    n, id_bytes = struct.unpack_from("<II", data)
    ids = np.frombuffer(data, "<i8", n, 8)
    nulls = np.frombuffer(data, "u1", n, 8 + 8 * n)
    counts = np.frombuffer(data, "<u4", n, 8 + 9 * n)
    at = 8 + 13 * n
    kind = "<u2" if id_bytes == 2 else "<u4"
    for doc, null, count in zip(ids.tolist(), nulls.tolist(), counts.tolist()):
        tokens = np.frombuffer(data, kind, count, at)
        at += count * id_bytes
        yield (None if null else doc), tokens.astype("<u4").tobytes()


def _rank(doc_id: int | None) -> tuple[bool, int]:
    """Order of ids in a shard: null first."""
    return doc_id is not None, doc_id or 0


def read_frame_ids(stream, frames: list[tuple[int, int, int, int]]) -> list[tuple[tuple, tuple]]:
    """Rank of the first and of the last id of every frame, from the frame before the seek table."""
    at = frames[-1][0] + frames[-1][1] if frames else 0
    stream.seek(at)
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != IDS_MAGIC or size != IDS.size * len(frames):
        raise ValueError("no ids before the seek table")
    return [(_rank(None if no_first else first), _rank(None if no_last else last)) for first, last, no_first, no_last in IDS.iter_unpack(stream.read(size))]


def read_documents(file: str, wanted: Iterable[int | None]) -> dict[int | None, list[bytes]]:
    """Tokens of every document of one shard whose id is wanted, in the shard's order; null may be asked for.

    Ids rise through a shard, so the frames whose first and last ids enclose a wanted one are known beforehand;
    each of them is decompressed once and no other is.  Ids that the shard lacks are left out.
    """
    fs, path = pafs.FileSystem.from_uri(file)
    asked, found, needed = set(wanted), {}, set()
    with fs.open_input_file(path) as stream:
        frames = read_seek_table(stream)
        ends = read_frame_ids(stream, frames)
        firsts, lasts = [e[0] for e in ends], [e[1] for e in ends]
        for doc in asked:
            needed.update(range(bisect_left(lasts, _rank(doc)), bisect_right(firsts, _rank(doc))))
        for k in sorted(needed):
            for doc, tokens in read_frame(stream, *frames[k]):
                if doc in asked:
                    found.setdefault(doc, []).append(tokens)
    return found


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, id_bytes: int = 2, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode ``docs`` with byte_bpe_50k.json into shards under ``folder`` in ascending id order; return the manifest.

    One row of the manifest stands for one frame.  Null ids come first, null text counts as empty, rows
    with equal ids all stay, in the order of their texts' hashes, by which rows without an id or of one id are spread over
    shards; other columns are ignored; an empty table gives an empty manifest.  A task
    that runs again writes a file of another name, and the manifest lists the files of the attempts that
    Spark committed.  ``id_bytes`` 2 holds for vocabularies of up to 65,536 ids; a larger id is an error.
    """
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie", "text")
    )
    end = pack([end_id])

    def write(batches):
        shard = TaskContext.get().partitionId()
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        writer, stream, encode = None, None, byte_level().encode
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    fs, path = pafs.FileSystem.from_uri(file)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(path, compression=None)
                    writer = FrameWriter(stream, id_bytes, frame_bytes=frame_bytes)
                writer.add(doc, encode(text) + end)
        if writer is not None:
            writer.close()
            stream.close()
            rows = [(shard, file, k, *f) for k, f in enumerate(writer.frames)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 6))],
                names=["shard", "file", "frame", "position", "packed_bytes", "raw_bytes", "checksum", "n_docs", "n_tokens"],
            )

    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (tokens of all documents before it), tokens (binary).

    Totals of shards, of which there are as many as partitions, go through the driver; places of frames in
    a shard come from a window over that shard's manifest rows.
    """
    spark = manifest.sparkSession
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, starts = 0, []
    for row in totals:
        starts.append((row.shard, before))
        before += row.n
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))
    earlier = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    frames = manifest.withColumn("in_shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(offsets, "shard")
    frames = frames.select("file", "position", "packed_bytes", "raw_bytes", "checksum", (F.col("shard_start") + F.col("in_shard")).alias("start"))
    parts = max(2 * spark.sparkContext.defaultParallelism, len(starts))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                start, ids, starts, tokens = row["start"], [], [], []
                with fs.open_input_file(path) as stream:
                    for doc, data in read_frame(stream, row["position"], row["packed_bytes"], row["raw_bytes"], row["checksum"]):
                        ids.append(doc)
                        starts.append(start)
                        tokens.append(data)
                        start += len(data) // 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "start", "tokens"])

    return frames.repartition(parts, "file", "position").mapInArrow(read, "doc_id long, start long, tokens binary")


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Write the token files, read them back, and describe each document: doc_id, start, n_tokens, ids_crc32.

    Null text counts as empty and has the end id alone; null ids come first, rows that repeat an id all stay, in the order
    of their texts' hashes; an empty table gives an empty result."""
    manifest = write_token_files(docs, shared_folder(docs.sparkSession, "token-files"))
    return read_token_files(manifest).select(
        "doc_id", "start", F.floor(F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


