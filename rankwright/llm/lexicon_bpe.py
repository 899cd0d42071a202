"""BPE encoding through a minimal acyclic transducer of frequent words.

The most frequent words of the corpus are compiled, with their token ids, into
an automaton that shares prefixes and suffixes.  Every arc carries a number; the
numbers on a word's path add up to the word's place in the lexicon, where its
ids stand.  Executors map the file into memory.  A word outside the lexicon is
merged exactly by the BPE core.  A worker remembers what it has looked up, so
that a batch takes only its new words through the automaton, all of them at once.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, shared_folder, small_batches, written
from .tokens import ODD, ByteLevel, byte_level

#: Words of the lexicon: the feature's size, not a cap on what is encoded.
LEXICON_WORDS = 50_000
#: Words a task counts before it hands its counts on, and words a worker remembers before it starts afresh.
COUNTED_WORDS, REMEMBERED_WORDS = 150_000, 200_000
MAGIC = b"MATL"


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """File of the minimal automaton for word -> packed ids."""
    children: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []

    def minimise(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            signature = (final[child], tuple(children[child].items()))
            children[parent][byte] = register.setdefault(signature, child)

    words = sorted(entries)
    last = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        minimise(shared)
        state = path[-1][2] if path else 0
        for byte in word[shared:]:
            children.append({})
            final.append(False)
            children[state][byte] = len(children) - 1
            path.append((state, byte, len(children) - 1))
            state = len(children) - 1
        final[state] = True
        last = word
    minimise(0)

    number: dict[int, int] = {}
    below: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # children before parents, so that the words below each state are known
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[c] for c in children[state].values())
        elif state not in number:
            number[state] = len(number)
            stack.append((state, True))
            stack.extend((c, False) for c in children[state].values() if c not in number)
    arcs = []
    for state, n in number.items():
        passed = int(final[state])
        for byte, child in children[state].items():
            arcs.append((n * 256 + byte, number[child], passed))
            passed += below[child]
    arcs.sort()
    keys, targets, outputs = (np.array(x) for x in (zip(*arcs) if arcs else ((), (), ())))
    finals = np.zeros(len(number), "u1")
    finals[[number[s] for s in number if final[s]]] = 1
    offsets = np.cumsum([0] + [len(entries[w]) // 4 for w in words])
    parts = {
        "keys": keys.astype("<i8"), "targets": targets.astype("<i4"), "outputs": outputs.astype("<i4"),
        "finals": finals, "offsets": offsets.astype("<i8"), "ids": np.frombuffer(b"".join(entries[w] for w in words), "<u4"),
    }
    head, at = {}, 0
    for name, x in parts.items():
        head[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts.values())


class Lexicon:
    """A lexicon file mapped into memory."""

    def __init__(self, file: str):
        whole = np.memmap(file, np.uint8, "r")
        if bytes(whole[:4]) != MAGIC:
            raise ValueError("not a lexicon file")
        size = struct.unpack("<I", bytes(whole[4:8]))[0]
        for name, (kind, n, at) in json.loads(bytes(whole[8 : 8 + size])).items():
            start = 8 + size + at
            setattr(self, name, whole[start : start + n * np.dtype(kind).itemsize].view(kind))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, or -1: all words take their next step at once."""
        n = len(words)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return place
        lengths = np.fromiter(map(len, words), np.int64, n)
        begins = np.cumsum(lengths) - lengths
        letters = np.frombuffer(b"".join(words), np.uint8)
        who, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(who):
            over = lengths[who] == depth
            ended = over & (self.finals[state] == 1)
            place[who[ended]] = total[ended]
            who, state, total = who[~over], state[~over], total[~over]
            key = state * 256 + letters[begins[who] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            who, arc = who[ok], arc[ok]
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.outputs[arc]
            depth += 1
        return place

    def ids_of(self, places: list[int]) -> list[bytes]:
        """Packed ids of each place."""
        raw, offsets = memoryview(self.ids).cast("B"), self.offsets
        begins, ends = 4 * offsets[places], 4 * offsets[np.asarray(places, np.int64) + 1]
        return [bytes(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]


@lru_cache(maxsize=2)
def _opened(file: str) -> Lexicon:
    return Lexicon(file)


def _cut(encoder: ByteLevel, text: str) -> tuple[list[str], list[str]]:
    """A text as pieces that stand as they are, and behind them words that are meant with a space before, or start
    with a line feed."""
    words = encoder.words(text)
    if words is None:
        return encoder.chunks(text), []
    first = words[:1] if words[0] else []
    del words[0]
    return first, words


def _spaced(word: str) -> str:
    return word if word[:1] == "\n" else " " + word


class Remembered:
    """What a worker knows: words and pieces with their packed ids, looked up in the lexicon or else merged."""

    def __init__(self, encoder: ByteLevel, lexicon: Lexicon, limit: int = REMEMBERED_WORDS):
        self.encoder, self.lexicon, self.limit = encoder, lexicon, limit
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], wanted: set[str], form) -> None:
        new = wanted - known.keys()
        if len(known) + len(new) > self.limit:
            known.clear()
            new = wanted
        keys = list(new)
        texts = list(map(form, keys)) if form else keys
        places = self.lexicon.find([t.encode() for t in texts])
        held = np.flatnonzero(places >= 0).tolist()
        for k, ids in zip(held, self.lexicon.ids_of(places[held])):
            known[keys[k]] = ids
        merge = self.encoder.chunk
        for k in np.flatnonzero(places < 0).tolist():
            known[keys[k]] = merge(texts[k])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        special, whole = self.encoder.special, self.encoder.whole
        cut = [None if any(s in t for s in special) or ODD.search(t) else _cut(self.encoder, t) for t in texts]
        self._learn(self.pieces, set().union(*(c[0] for c in cut if c)), None)
        self._learn(self.words, set().union(*(c[1] for c in cut if c)), _spaced)
        piece, word = self.pieces.__getitem__, self.words.__getitem__
        return [whole(t) if c is None else b"".join(map(piece, c[0])) + b"".join(map(word, c[1])) for t, c in zip(texts, cut)]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Count of every word of all texts: tasks count first, then the counts are added by word."""
    small_batches(docs.sparkSession)

    def count(batches):
        encoder, pieces, words = byte_level(), Counter(), Counter()

        def out():
            for seen, form in ((pieces, str), (words, _spaced)):
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(map(form, seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                first, rest = _cut(encoder, text)
                pieces.update(first)
                words.update(rest)
            if len(words) + len(pieces) >= COUNTED_WORDS:
                yield from out()
        yield from out()

    counted = docs.select(F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, *, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, at most ``words``, and send the file to all executors.

    The lexicon holds every word whose count lies on or above the lowest step at which no more than ``words``
    do; words of one step are all in or all out.  Returns the name under which SparkFiles has it.
    """
    counted = written(word_counts(docs, text_col), "word-counts")
    # Words by steps of their count, 32 to a doubling: at most some two thousand steps for any corpus.
    step = F.floor(F.log2("n") * 32)
    sizes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("w")).collect()
    least, held = None, 0
    for row in sorted(sizes, key=lambda r: -r.step):
        held += row.w
        if held > words:
            break
        least = row.step
    top = counted.where(step >= least).select("word").collect() if least is not None else []
    encoder = byte_level()
    found = (r.word for r in top if not any(s in r.word for s in encoder.special))
    blob = compile_lexicon({w.encode(): encoder.chunk(w) for w in found})
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    spark = docs.sparkSession
    file = f"{shared_folder(spark, 'lexicon')}/{name}"
    fs, path = pafs.FileSystem.from_uri(file)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(blob)
    spark.sparkContext.addFile(file)
    return name


def encode_with_lexicon(docs: DataFrame, lexicon: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text as the tokenizers library gives them: doc_id, ids (packed little-endian u32).

    With ``decoded`` also text, the ids decoded again, from the same worker.  Null text counts as empty and
    has no ids; null and repeated doc_ids stay; other columns are ignored.  A text that holds a special token's name is encoded by the library as a whole.
    """
    require_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)

    def encode(batches):
        encoder = byte_level()
        known = Remembered(encoder, _opened(SparkFiles.get(lexicon)))
        for batch in batches:
            ids = known.encode(batch.column(1).to_pylist())
            out = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["text"] = pa.array(map(encoder.decode, ids), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    return texts.mapInArrow(encode, "doc_id long, ids binary" + ", text string" * decoded)


def decode_ids(ids: DataFrame) -> DataFrame:
    """Add ``text``, the decoded ids, to a table with doc_id and ids."""

    def decode(batches):
        encoder = byte_level()
        for batch in batches:
            texts = [encoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, text string")


def codec_digest(docs: DataFrame) -> DataFrame:
    """Encode, decode, and describe both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no ids; null and repeated ids stay, each row on its own; an empty table gives an
    empty result; other columns are ignored."""
    coded = encode_with_lexicon(docs, build_lexicon(docs), decoded=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


