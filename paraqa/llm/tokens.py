"""Token ids in files with a shared zstandard dictionary.

File format, two Parquet tables under one folder, so that any store Spark can write holds it and Spark's commit keeps a
lost executor's half-written files out:

dictionary/  hash string (sha256 of the bytes, hex), bytes binary, width int (bytes of an id: 2 if the vocabulary has at
             most 65,536 ids, else 4). The dictionary is trained on serialized id arrays of a sample of SAMPLE documents.
blocks/      a row for each run of documents in ascending doc_id order: shard int, block int, first long (ids of the
             shard before the block), first_doc long, last_doc long (least and greatest doc_id of the block, by which a
             reader skips the others), hash string, doc_ids array<long>, n_tokens array<long>, offsets array<long> (where
             each document's frame starts, and the end), frames binary. A frame is one document's ids, little-endian,
             compressed by itself with the dictionary; so a short document costs one small read and no neighbours.

A global position is the sum of the shards before, the block's first and the block's documents before.

Nulls: a null text is empty and gives the end id only; null doc_ids come first. Repeated rows and equal doc_ids keep a
frame each, in the order of the text's hash. An empty table gives tables without rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, documents, scratch_dir, staged

END_ID = 1
LEVEL = 3
#: The dictionary is fitted on about so many documents, chosen by hash, with a piece of at most PIECE ids from each.
SAMPLE, PIECE, DICTIONARY_BYTES = 1000, 4096, 1 << 16
#: A block is closed once its frames have so many bytes.
BLOCK_BYTES = 1 << 22
#: Distinct words whose ids a worker keeps at hand; beyond, it starts anew. Bytes of text that it encodes together, about.
MOST_WORDS, AT_ONCE = 500_000, 1 << 23
#: ASCII marks that are split off a word, the end of the Latin letters that take the short way, and the one that doesn't
#: get one letter when lowered.
MARKS, LATIN, DOTTED = b".,;:!?", chr(0x250), chr(0x130)


def byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others in turn from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


#: The parts of a tokenizer, as its file has them, that the short way relies on.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


class Encoder:
    """Ids of whole texts from the tokenizers library.

    Its pre-tokenizer never joins across ASCII white space, letters and marks, and its normalizer lowers letters one by one.
    So the ids of a text are those of its words in a row, those of a word of letters with marks behind it are the letters'
    and the marks', and each distinct word is encoded once. Words of ASCII and Latin letters are already what the library's
    normalizer and pre-tokenizer make of them, once lowered, and go straight to its model; all others go through all of it.
    This holds for tokenizers with the PARTS below; with any other one, whole texts go through all of it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = all(parts.get(k) == v for k, v in PARTS.items()) and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.end = END_ID.to_bytes(self.width, "little")
        self.letters = byte_letters()
        self.cores: dict[bytes, bytes] = {}  # lowered ASCII letters, and Latin letters as they are
        self.wholes: dict[bytes, bytes] = {b"": b""}  # other words, and marks

    def _core(self, text: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _whole(self, word: bytes) -> bytes:
        if (got := self.wholes.get(word)) is None:
            got = array(self.kind, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            self.wholes[word] = got
        return got

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.cores) > MOST_WORDS:
            self.cores.clear()
        if len(self.wholes) > MOST_WORDS:
            self.wholes = {b"": b""}
        cores, out = self.cores, []
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha():  # bytes: ASCII
                key = core.lower()
                if (got := cores.get(key)) is None:
                    got = cores[key] = self._core(key.decode())
            elif (got := cores.get(core)) is None:
                if core.isascii() or not (text := core.decode("utf-8", "replace")).isalpha() or max(text) >= LATIN or DOTTED in text:
                    out.append(self._whole(word))
                    continue
                got = cores[core] = self._core(text.lower().encode().decode("latin-1").translate(self.letters))
            out.append(got + self._whole(word[len(core) :]) if len(core) < len(word) else got)
        return out

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each of the texts (binary, UTF-8) the ids, serialized, with the end id. Arrow finds the distinct words of
        slices of about AT_ONCE bytes, and numpy lays their ids out."""
        if not self.by_words:
            for text in texts:
                yield array(self.kind, self.tokenizer.encode(text.as_py().decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() + self.end
            return
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.binary() else np.int64)[texts.offset : texts.offset + len(texts) + 1])
        slices = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE, prepend=0)).tolist() if len(size) else []
        for a, z in zip([0, *slices], [*slices, len(texts)], strict=True):
            if a < z:
                yield from self._slice(texts.slice(a, z - a))

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))  # x20 and x09 to x0D
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        ids = self._words(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.kind)
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        tokens = flat[np.repeat((np.cumsum(sizes) - sizes)[word] - (ends - n), n) + np.arange(len(n) and ends[-1])].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))] * self.width
        for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield tokens[a:z] + self.end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out = []
            for ids, h in zip(encode(b.column("text")), b.column("h"), strict=True):
                at = h.as_py() % max(1, len(ids) // encode.width - PIECE) * encode.width
                out.append(ids[at : at + PIECE * encode.width])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def train(docs: DataFrame, path: str, sample: int = SAMPLE) -> bytes:
    """The dictionary's bytes; none if there is too little to learn from. At most 2 * sample pieces reach the driver."""
    step = max(1, docs.count() // sample)
    h = F.xxhash64(F.col("doc_id").cast("long"), F.octet_length("text"))
    picked = as_bytes(docs.where(F.pmod(h, F.lit(step)) == 0), h.alias("h")).limit(2 * sample)
    pieces = sorted(bytes(r.ids) for r in picked.mapInArrow(_pieces(path), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _compress(path: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        for b in batches:
            n, frames = [], []
            for ids in encode(b.column("text")):
                n.append(len(ids) // encode.width)
                frames.append(pack.compress(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "tie", "n", "frame"])

    return run


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])
BLOCKS_DDL = "shard int, block int, first long, first_doc long, last_doc long, hash string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"


def _blocks(hash_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, n, offsets, frames = [], [], [0], []

        def row() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            ends = {"first_doc": min(known, default=None), "last_doc": max(known, default=None)}
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, **ends, "hash": hash_, "doc_ids": ids, "n_tokens": n, "offsets": offsets, "frames": b"".join(frames)}], schema=BLOCKS)

        for b in batches:
            for doc_id, count, frame in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("frame"), strict=True):
                frame = frame.as_py()
                ids.append(doc_id), n.append(count), frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= BLOCK_BYTES:
                    yield row()
                    block, first = block + 1, first + sum(n)
                    ids, n, offsets, frames = [], [], [0], []
        if ids:
            yield row()

    return run


def write(docs: DataFrame, path: str, out: str, shards: int | None = None) -> None:
    """Encodes docs with the tokenizer in the file path and writes the two tables under the folder out.

    Texts are encoded where they are read; only compressed frames are shuffled, by ranges of doc_id.
    """
    spark = docs.sparkSession
    dictionary = train(docs, path)
    hash_ = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(hash_, bytearray(dictionary), Encoder(path).width)], "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{out}/dictionary")
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    frames = staged(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie")).mapInArrow(_compress(path, dictionary), "doc_id long, tie long, n long, frame binary"), "token-frames")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = frames.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.mapInArrow(_blocks(hash_), BLOCKS_DDL).write.parquet(f"{out}/blocks")


def load_dictionary(spark: SparkSession, out: str) -> tuple[bytes, str, int]:
    r = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(r.bytes).hexdigest() != r.hash:
        raise ValueError("the dictionary's bytes don't match its hash")
    return bytes(r.bytes), r.hash, r.width


def blocks_of(spark: SparkSession, out: str, doc_id: int) -> DataFrame:
    """The blocks that may hold a document."""
    return spark.read.schema(BLOCKS_DDL).parquet(f"{out}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))


def fetch(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: the blocks' least and greatest ids, which Parquet's statistics keep too, find
    their blocks, and only their frames are decompressed."""
    dictionary, hash_, width = load_dictionary(spark, out)
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    rows = blocks_of(spark, out, doc_id).where(F.array_contains("doc_ids", F.lit(doc_id)))
    spot = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda k: F.element_at("doc_ids", k + 1) == doc_id))
    cut = rows.select("hash", "shard", "block", spot.alias("k"), "offsets", "frames").selectExpr("hash", "shard", "block", "k", "substring(frames, int(offsets[k] + 1), int(offsets[k + 1] - offsets[k])) AS frame")
    found = []
    for r in cut.orderBy("shard", "block", "k").collect():
        if r.hash != hash_:
            raise ValueError("a block names another dictionary")
        found.append(np.frombuffer(unpack.decompress(bytes(r.frame)), dtype=f"<u{width}"))
    return found


def _read(dictionary: bytes, hash_: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for b in batches:
            for r in b.to_pylist():
                if r["hash"] != hash_:
                    raise ValueError("a block names another dictionary")
                frames, offsets = memoryview(r["frames"]), r["offsets"]
                starts, counts, sums = [], [], []
                at = r["first"]
                for a, z in zip(offsets, offsets[1:], strict=False):
                    ids = np.frombuffer(unpack.decompress(frames[a:z]), dtype=f"<u{width}").astype("<u4")
                    starts.append(at), counts.append(len(ids)), sums.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                if counts != r["n_tokens"]:
                    raise ValueError("the index doesn't match the frames")
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(counts), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{out}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))  # one row for each shard written
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    rows = blocks.mapInArrow(_read(*load_dictionary(spark, out)), "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out)
    return read(spark, out)
