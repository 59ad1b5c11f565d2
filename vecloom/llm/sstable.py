"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    blocks | block index | Bloom filter | footer

Keys are the identifier as 8 bytes, big-endian with the sign bit flipped, so that byte
order is number order; a row without one has the empty key, which comes first. A block holds entries, each: shared prefix length with the
key before (1 byte), rest length (1 byte), value length (u32), rest of the key, value;
the first entry of a block shares nothing. A value is the ids as little-endian u16, or
as u32 where the first bit of the value's header byte is set. Blocks are compressed with
Zstandard. The sparse index has a row for each block: first key (8 bytes), offset (u64), stored
size, size and entries (u32 each), ids before it in the shard (u64). The footer has, as little-
endian u64: entries, ids, index offset, blocks, filter offset, filter bits, filter
hashes, then the 8 bytes of MAGIC.
"""

from __future__ import annotations

import array
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, worker_store

MAGIC = b"VLSST\x00\x00\x01"
FOOTER, INDEX, ENTRY = "<7Q8s", "<8sQIIIQ", "<BBI"
#: A block is closed when its entries reach so many bytes.
BLOCK_BYTES = 64 << 10
#: Bits of the Bloom filter for each entry, and its hashes.
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of text of a shard: no more than the first, about, and no fewer than the second to have as many shards as tasks.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
#: Chunks that a worker remembers; beyond them it forgets all and starts anew.
MAX_WORDS = 1_000_000
#: Characters outside the Latin blocks, or of which Python's lower case may differ from the library's.
FOREIGN = re.compile("[^\x00-\u012f\u0131-\u017e]")


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", (key + (1 << 63)) & (2**64 - 1))


def key_number(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def pack_ids(ids: np.ndarray) -> bytes:
    """ids: little-endian u32."""
    if len(ids) and ids.max() > 0xFFFF:
        return b"\x01" + ids.astype("<u4").tobytes()
    return b"\x00" + ids.astype("<u2").tobytes()


def packed(ids: list[int]) -> bytes:
    """ids as little-endian u32."""
    held = array.array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] else "<u2", offset=1).astype("<u4")


def bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bits [hash, key] of keys given as u64: double hashing by two multiplications."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    one = x ^ (x >> np.uint64(29))
    two = (one * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return (one + np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None] * (two >> np.uint64(7))) % np.uint64(bits)


class Writer:
    """Writes a shard's blocks as they fill; memory holds one block, the index and the keys."""

    def __init__(self, out):
        self.out, self.offset, self.index, self.keys = out, 0, [], []
        self.block, self.size, self.entries, self.last, self.first = [], 0, 0, b"", b""
        self.ids = self.before = self.count = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        raw, value = key_bytes(key), pack_ids(ids)
        if not self.block:
            self.first, self.last = raw, b""
        shared = next((i for i, (a, b) in enumerate(zip(raw, self.last)) if a != b), min(len(raw), len(self.last)))
        self.block.append(struct.pack(ENTRY, shared, len(raw) - shared, len(value)) + raw[shared:] + value)
        self.size += len(self.block[-1])
        self.entries, self.ids, self.last = self.entries + 1, self.ids + len(ids), raw
        if key is not None:
            self.keys.append(key)
        self.count += 1
        if self.size >= BLOCK_BYTES:
            self.flush()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            stored = pa.compress(raw, codec="zstd", asbytes=True)
            self.index.append(struct.pack(INDEX, self.first, self.offset, len(stored), len(raw), self.entries, self.before))
            self.put(stored)
            self.block, self.size, self.entries, self.before = [], 0, 0, self.ids

    def close(self) -> None:
        self.flush()
        at = self.offset
        self.put(b"".join(self.index))
        keys = np.array(self.keys, np.int64).astype(np.uint64)
        bits = max(64, BLOOM_BITS * len(keys))
        bloom = np.zeros(bits, np.uint8)
        if len(keys):
            bloom[bloom_bits(keys, bits).ravel().astype(np.int64)] = 1
        bloom_at = self.offset
        self.put(np.packbits(bloom).tobytes())
        self.put(struct.pack(FOOTER, self.count, self.ids, at, len(self.index), bloom_at, bits, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads a shard: in order, or one key by filter, binary search of the index, and one block."""

    def __init__(self, source):
        self.source = source
        total = source.size()
        self.entries, self.ids, at, blocks, bloom_at, self.bits, _, magic = struct.unpack(FOOTER, self.part(total - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = list(struct.iter_unpack(INDEX, self.part(at, blocks * struct.calcsize(INDEX))))
        self.bloom = np.frombuffer(self.part(bloom_at, -(-self.bits // 8)), np.uint8)

    def part(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, row: tuple) -> Iterator[tuple[int | None, np.ndarray]]:
        data, at, key = pa.decompress(self.part(row[1], row[2]), decompressed_size=row[3], codec="zstd", asbytes=True), 0, b""
        while at < len(data):
            shared, rest, size = struct.unpack_from(ENTRY, data, at)
            at += struct.calcsize(ENTRY)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key_number(key), unpack_ids(data[at : at + size])
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for row in self.index:
            yield from self.block(row)

    def may_hold(self, key: int) -> bool:
        at = bloom_bits(np.array([key], np.int64).astype(np.uint64), self.bits).ravel().astype(np.int64)
        return bool(np.all(self.bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1))

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document of this key."""
        if not self.index or (key is not None and not self.may_hold(key)):
            return []
        raw = key_bytes(key).ljust(8, b"\0")  # as the index has it
        low, high = 0, len(self.index)  # the last block that begins before the key; the key may begin there or later
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < raw else (low, mid)
        found = []
        for row in self.index[max(0, low - 1) :]:
            if row[0] > raw:
                break
            found += [ids for k, ids in self.block(row) if k == key]
        return found


def open_shard(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path))


def lowered(text: str) -> str:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if FOREIGN.search(text):
            return text
    return text.lower()


class Words(dict):
    """Ids of chunks between spaces or newlines as little-endian u32 bytes.

    Normalisation and pre-tokenisation drop white space and look at nothing across it, so
    a text's ids are those of its chunks in order. A word that ends in a Latin letter and the commas or full stops
    after it are pre-tokens of their own, so these are cut off (normalisation leaves a mark at the end of
    some other words, which would be joined with them), and Latin text is put in
    lower case first; both make fewer distinct chunks. Only special strings are looked
    for in whole texts; such texts go to the library whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        #: Characters that byte-level pre-tokenisation gives bytes: printable ones stand for themselves, the others follow 255 in order.
        self.byte_chars = {}
        for b in range(256):
            if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174):
                self.byte_chars[b] = 256 + len(self.byte_chars)
        #: Whether words of letters may go straight to the library's model: tried on words of its own vocabulary.
        self.direct = False
        tried = [w for w in sorted({p.replace("</w>", "") for p in list(vocabulary)[:: max(1, len(vocabulary) // 300)]}) if w.isascii() and w.isalpha() and w == w.lower()] + ["straße", "élève", "čtyři", "naïveté"]
        self.direct = all([t.id for t in self.model_ids(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in tried)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def model_ids(self, word: str) -> list:
        return self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars))

    def learn(self, new: set[str]) -> None:
        """Encodes chunks that are new. Words of lower-case Latin letters, composed as they are, are
        their own normal form and one pre-token: they go straight to the library's model."""
        cores = {c: core for c in new if c[-1:] in (".", ",") and (core := c.rstrip(".,")) and core[-1].isalpha() and not FOREIGN.search(core[-1])}
        if cores:
            new.difference_update(cores)
            new.update(cores.values(), (c[len(core) :] for c, core in cores.items()))
            new -= self.keys()
        rest, tokenize, chars = [], self.tokenizer.model.tokenize, self.byte_chars
        for c in new:
            if not (self.direct and c.isalpha()):
                rest.append(c)
            elif c.isascii() and c.islower():
                self[c] = packed([t.id for t in tokenize(c)])
            elif c == c.lower() and not FOREIGN.search(c):
                self[c] = packed([t.id for t in tokenize(c.encode().decode("latin-1").translate(chars))])
            else:
                rest.append(c)
        for chunk, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[chunk] = packed(e.ids)
        for chunk, core in cores.items():
            self[chunk] = self[core] + self[chunk[len(core) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        found, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > 2_000_000:
                found += self.encode_group(group)
                group, size = [], 0
        return found + self.encode_group(group)

    def encode_group(self, texts: list[str]) -> list[bytes]:
        if len(self) > MAX_WORDS:
            self.clear()
        split = [None if any(s in t for s in self.special) else lowered(t).replace("\n", " ").split(" ") for t in texts]
        get = self.get
        parts = [s and list(map(get, s)) for s in split]
        gaps = [[i for i, ids in enumerate(p) if ids is None] if p else () for p in parts]
        new = {s[i] for s, missing in zip(split, gaps) for i in missing}
        if new:
            self.learn(new)
            for p, s, missing in zip(parts, split, gaps):
                for i in missing:
                    p[i] = self[s[i]]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(p) for t, p in zip(texts, parts)]


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of df's size, or, where it has none, the bytes of its first column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(F.octet_length(F.col(f"`{df.columns[0]}`")))).first()[0] or 0


def write_shards(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, key_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes each whole text, appends end_id, and writes ids to shards in ascending key order.

    Returns a row for each shard: shard (its number in key order), path, entries, ids. A
    null text counts as empty: its ids are the end id alone. Equal keys stay separate
    entries, by order of text; rows without a key are written first, under the empty key, and read back without one.
    How many shards there are follows from the size of the texts. An empty table gives no shard. folder is a URI that all executors reach. A task
    writes under a name of its own and renames it when whole, so that tries that were lost leave no half shard.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())
    if not shards:
        size = estimated_bytes(df.select(F.col(f"`{text_col}`")))
        shards = max(1, -(-size // SHARD_BYTES), min(-(-size // LEAST_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(F.col(f"`{key_col}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange(shards, "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store = worker_store("sstable")
        if tokenizer_path not in store:
            store[tokenizer_path] = Words(held.value)
        words, writer, number = store[tokenizer_path], None, TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(root, recursive=True)
                path = f"{root}/.{number}-{uuid.uuid4().hex}"
                writer = Writer(fs.open_output_stream(path))
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                writer.add(key, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            writer.out.close()
            name = f"{number:08d}-{path.rpartition('-')[2]}.sst"
            fs.move(path, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"], "entries": pa.array([writer.count], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return dealt.mapInArrow(tidy(run, "sstable"), "shard int, path string, entries long, ids long")


def scan_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards: key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian u32).

    shards is what write_shards returned, cut from its lineage: it must not be computed
    twice. Starts come from the shards' totals; there is one row a shard, so that sum is small."""
    from pyspark.sql import Window

    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("shard", "path", F.coalesce(before, F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, shards.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                reader = open_shard(row["path"])
                for key, ids in reader:
                    out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 20_000:
                        yield rows_of(out)
                        out = []
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(tidy(run), "key long, start long, n_tokens long, ids_crc32 long")
