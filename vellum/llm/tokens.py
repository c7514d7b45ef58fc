"""Token ids in blocks of raw payload, with a minimal perfect hash index from document keys to offsets.

A block file is a Parquet file of blocks, so that any Hadoop file system holds it and a commit is atomic.  One
row is one block:

    block        which part of the key order, and place in it
    first, last  smallest and largest key
    start        ids in all blocks before (set when read)
    documents    number of documents, ids of their ids
    keys         little-endian int64 keys in order, for scans; documents of null key come before them
    payload      little-endian ids, 2 bytes each if the vocabulary allows, else 4
    ends         little-endian int64: where each document's ids end, in ids from the block's start
    levels       int32: bits in each level of the index
    bits         the levels' bits, packed
    fingerprints uint32 per key, in the index's order
    places       int32 per key, in the index's order: the key's first document within the block

The index is a cascade of bit arrays (Limasset et al., 2017): on each level a key hashes to one bit; keys that
are alone on theirs stay, the others go to the next level.  A key's number is the rank of its bit; the
fingerprint stored under that number tells strangers.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import documents, pick, shared_dir

#: A block ends with the document that reaches one of these.
BLOCK_IDS = 1 << 20
BLOCK_DOCUMENTS = 20_000
#: Pieces of text whose ids a worker remembers.
MEMORY = 700_000
#: Bytes of text encoded at once, and bytes of text in a range of keys (one task), about.
PORTION, PART = 8 << 20, 32 << 20
#: Blocks whose starts are broadcast (24 bytes each); beyond it blocks are shuffled.
BROADCAST_BLOCKS = 1_000_000
# fixed values: punctuation that may follow a word; apostrophes begin tokens of their own
MARKS = ".,;:!?|*#$%&+-=_/()[]{}<>~^@"
PAIRS = [f" {chr(c)}" for c in range(128) if chr(c).isspace()]
#: Longer pieces are not remembered.
LONG = 64
SCHEMA = "part int, place int, first long, last long, documents long, ids long, keys binary, payload binary, ends binary, levels binary, bits binary, fingerprints binary, places binary"


def mixed_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (the finaliser of splitmix64)."""
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, all bits packed, number of each key); keys have to be distinct."""
    levels, bits, number = [], [], np.full(len(keys), -1, np.int64)
    left, taken = np.arange(len(keys)), 0
    while left.size:
        size = 2 * len(left)
        at = (mixed_hash(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        ranks = np.cumsum(alone) - 1
        stays = alone[at]
        number[left[stays]] = taken + ranks[at[stays]]
        taken += int(stays.sum())
        levels.append(size), bits.append(alone)
        left = left[~stays]
    return np.array(levels, np.int32), np.packbits(np.concatenate(bits)) if bits else np.empty(0, np.uint8), number


class Index:
    """Looks keys up; -1 for a key that is not there (but for a chance of 1 in 2**32)."""

    def __init__(self, levels: bytes, bits: bytes, fingerprints: bytes, places: bytes):
        self.levels = np.frombuffer(levels, np.int32)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(self.levels.sum())].astype(bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.fingerprints, self.places = np.frombuffer(fingerprints, np.uint32), np.frombuffer(places, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        found, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for k, size in enumerate(self.levels):
            at = base + (mixed_hash(keys[left], k) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            number = self.ranks[at[hit]]
            same = self.fingerprints[number] == fingerprint(keys[left[hit]])
            found[left[hit][same]] = self.places[number[same]]
            left, base = left[~hit], base + int(size)
        return found


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class Known(dict):
    """Ids of pieces without white space at their ends, as bytes; pieces met for the first time are encoded.

    ``lead`` is what comes before each piece: a space, or nothing.  The splitter of byte-level BPE takes letters as one
    token, punctuation after them as another, and a line break between other characters as a third, so such
    pieces are put together from their parts, and letters go straight to the merges.
    """

    def __init__(self, tokenizer, kind: np.dtype, lead: str = " "):
        self.tokenizer, self.model, self.kind, self.lead = tokenizer, tokenizer.model, kind, lead
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.mark, self.code = lead.translate(self.alphabet), "H" if kind.itemsize == 2 else "I"
        self.bare = Known(tokenizer, kind, "") if lead else self
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def clear(self) -> None:
        super().clear()
        if self.bare is not self:
            self.bare.clear()

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            # letters of ASCII stand for themselves
            word = self.mark + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))
            ids = array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            line, found, rest = piece.partition("\n")
            if found and line and rest and not line[-1].isspace() and not rest[0].isspace():
                return self[line] + self.line_break + self.bare[rest]
            word = piece.rstrip(MARKS)
            if word != piece and word.isalpha():
                ids = self[word] + self.bare[piece[len(word) :]]
            else:
                ids = self.whole(self.lead + piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts, as bytes.  A single space before a character that is not white space always begins a token
    of byte-level BPE, so a text is cut there, and the ids of the pieces, most of them met before, are put together."""

    def __init__(self, path: str, cut: bool, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_file(path), cut
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tail = b"" if end is None else np.array([end], self.kind).tobytes()
        self.known = Known(self.tokenizer, self.kind) if cut else None
        self.before_word, self.odd_space = re.compile(r" (?=\S)"), re.compile(r" \s|^\s")

    def is_odd(self, text: str) -> bool:
        """Whether white space follows a space or begins the text."""
        if not text.isascii():
            return bool(self.odd_space.search(text))
        return text[0].isspace() or any(pair in text for pair in PAIRS)

    def encode(self, text: str) -> bytes:
        if not text:
            return self.tail
        if not self.cut:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.tail
        pieces = self.before_word.split(text) if self.is_odd(text) else text.split(" ")
        first = pieces.pop(0)
        if len(self.known) + len(self.known.bare) > MEMORY:
            self.known.clear()
        return (self.known.bare[first] if first else b"") + b"".join(map(self.known.__getitem__, pieces)) + self.tail


    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text.  Of all pieces of the texts each distinct one is looked up once; numpy puts their ids in order."""
        out: list[bytes] = [self.tail] * len(texts)
        even = []
        for i, text in enumerate(texts):
            if text and self.cut and not self.is_odd(text):
                even.append(i)
            elif text:
                out[i] = self.encode(text)
        if not even:
            return out
        if len(self.known) + len(self.known.bare) > MEMORY:
            self.known.clear()
        pieces = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        bounds, coded = pieces.offsets.to_numpy(), pieces.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        ids = [self.known[p] for p in distinct]
        codes[bounds[:-1]] = len(distinct) + np.arange(len(even))  # no space before the first pieces
        ids += [self.known.bare[p] for p in pieces.values.take(pa.array(bounds[:-1])).to_pylist()]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        pool, start = np.frombuffer(b"".join(ids), self.kind), np.cumsum(length) - length
        n = length[codes]
        until = np.cumsum(n)
        flat = pool[np.repeat(start[codes] - until + n, n) + np.arange(until[-1])]
        ends = until[bounds[1:] - 1]
        for i, s, e in zip(even, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = flat[s:e].tobytes() + self.tail
        return out


def encoder_of(path: str, cut: bool, end: int | None) -> Encoder:
    """A worker process keeps its encoder from task to task, in a module of its own: functions come anew with each task."""
    kept = sys.modules.setdefault("_vellum_encoders", types.ModuleType("_vellum_encoders")).__dict__
    if (path, cut, end) not in kept:
        kept[path, cut, end] = Encoder(path, cut, end)
    return kept[path, cut, end]


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have PORTION bytes, or a single text has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
        yield batch.slice(at, to - at)
        at = to


def block_row(part: int, place: int, keys: list, encoded: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(e) // width for e in encoded], dtype=np.int64)
    real = [k for k in keys if k is not None]
    distinct, first = np.unique(np.array(real, np.int64), return_index=True)
    levels, bits, number = build_index(distinct)
    prints, places = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int32)
    prints[number], places[number] = fingerprint(distinct), first + len(keys) - len(real)
    values = [part, place, min(real, default=None), max(real, default=None), len(keys), int(ends[-1]), np.array(real, np.int64).tobytes(), b"".join(encoded), ends.tobytes(), levels.tobytes(), bits.tobytes(), prints.tobytes(), places.tobytes()]
    kinds = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def blocks(docs: DataFrame, tokenizer: str, end: int | None = 2, cut: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all documents in ascending order of key (null first).  ``cut``: the tokenizer is byte-level BPE without prefix space.

    Each whole text is encoded without special tokens (null as empty) and ``end`` appended.  Rows that repeat a
    key follow one another; the index leads to the first of them.  Keys are integers.
    """
    flat = pick(docs, key=key, text=text).select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = flat.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // PART + 1)
    # repeated keys may span parts: the text's hash goes with the key
    ordered = flat.repartitionByRange(parts, F.col("key"), F.xxhash64("text")).sortWithinPartitions(F.col("key"), F.xxhash64("text"))
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, cut, end)
        width, place, part, keys, encoded, ids = encoder.kind.itemsize, 0, 0, [], [], 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for some in portions(batch.select(["key", "text"])):
                for k, e in zip(some.column("key").to_pylist(), encoder.encode_many(some.column("text").to_pylist()), strict=True):
                    keys.append(k), encoded.append(e)
                    ids += len(e) // width
                    if ids >= BLOCK_IDS or len(keys) >= BLOCK_DOCUMENTS:
                        yield block_row(part, place, keys, encoded, width)
                        place, keys, encoded, ids = place + 1, [], [], 0
        if keys:
            yield block_row(part, place, keys, encoded, width)

    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Writes the block files; payloads of integers compress little, so they stay raw."""
    blocks(docs, tokenizer, **options).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with start, the number of ids before each.  Only a few numbers a block are sorted."""
    kept = spark.read.schema(SCHEMA).parquet(path)
    before = W.orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    starts = kept.select("part", "place", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return kept.join(F.broadcast(starts) if kept.count() <= BROADCAST_BLOCKS else starts, ["part", "place"])


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, np.ndarray]:
    """Ids of each key's first document.  Reads only the blocks whose range holds a key, and of these goes straight to the offset."""
    wanted = np.array(sorted(set(keys)), np.int64)
    found: dict[int, np.ndarray] = {}
    if not len(wanted):
        return found
    near = None
    for k in wanted.tolist():
        here = (F.col("first") <= k) & (F.col("last") >= k)
        near = here if near is None else near | here
    for b in spark.read.schema(SCHEMA).parquet(path).filter(near).orderBy("part", "place").toLocalIterator():
        ends = np.frombuffer(b["ends"], np.int64)
        ids = np.frombuffer(b["payload"], f"<u{len(b['payload']) // int(ends[-1])}" if ends[-1] else "<u2")
        for k, d in zip(wanted.tolist(), Index(b["levels"], b["bits"], b["fingerprints"], b["places"]).find(wanted).tolist(), strict=True):
            if d >= 0 and k not in found:
                found[k] = ids[ends[d - 1] if d else 0 : ends[d]].astype(np.int64)
    return found


def read_documents(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the blocks that read() gives.

    Each key is looked up in the index; a key that leads elsewhere than to its first document fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # the batch's own memory: a block is not copied
                b = {c: batch.column(c)[i].as_buffer() for c in ("keys", "payload", "ends", "levels", "bits", "fingerprints", "places")}
                ends, keys = np.frombuffer(b["ends"], np.int64), np.frombuffer(b["keys"], np.int64)
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                ids = np.frombuffer(b["payload"], f"<u{b['payload'].size // int(ends[-1])}" if ends[-1] else "<u2")
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends, strict=True)]
                nulls = len(ends) - len(keys)
                distinct, first = np.unique(keys, return_index=True)
                if (Index(b["levels"], b["bits"], b["fingerprints"], b["places"]).find(distinct) != first + nulls).any():
                    raise ValueError("the index does not lead to the documents of its keys")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * nulls + keys.tolist(), pa.int64()), pa.array(batch.column("start")[i].as_py() + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(read(spark, path))
