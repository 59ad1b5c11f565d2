"""Byte-level BPE: encoding by ranked merges of distinct words, decoding by joining pieces.

The distinct words of all texts are counted, and Spark's higher-order functions fold the merges
over the bytes of the most frequent ones, with the ranks as a literal. These words' ids
are broadcast, a table of bounded size; words beyond it, and words too long for a fold that looks at
all pairs again at each merge, are merged by the workers that meet them. All words get the same ids
either way.
"""

from __future__ import annotations

import array
import base64
import heapq
import json
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, remove, shared_folder, tidy, with_computed, without, worker_store

#: Chunks that a worker remembers: beyond half as many it forgets those that it has not met since the last time.
MAX_CHUNKS = 250_000
#: Bytes of a word up to which words are merged side by side; new chunks, and their characters, that a worker lets wait for that.
SIDE_BYTES, WAITING, WAITING_CHARS = 64, 16_384, 1_000_000
#: Distinct chunks, and characters of chunks that are whole texts, that a worker counts before it hands them on.
COUNTED, COUNTED_CHARS = 150_000, 10_000_000
#: Above all ranks, and above all in 32 bits.
NEVER, NONE = 1 << 60, 2**31 - 1
#: Words that are folded and broadcast: the most frequent ones of at most so many bytes. With ids of up to 6 digits that is at most 50 MB.
VOCABULARY, WORD_BYTES = 200_000, 32
#: Slots of the literal rank map: a literal map is searched from its beginning, so it is an array of slots, each with about one piece.
SLOTS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as array<string>: a piece is in the slot that its CRC names, as ;digits=rank; with hexadecimal digits.
    A split literal, which the optimizer folds to one; strings are a fifth of what maps would take in a task's code."""
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        slots[zlib.crc32(piece) % SLOTS].append(f"{piece.hex().upper()}={rank}")
    return F.split(F.lit("|".join(f";{';'.join(slot)};" if slot else "" for slot in slots)), r"\|")


def fold_merges(word: Column, ranks: Column) -> Column:
    """The ids (array<int>) of a word (binary, not empty): its bytes, of which again and again the adjacent pair of lowest rank, the leftmost of equals, becomes one piece."""
    return let(ranks, lambda slots: _folded(word, slots))


def _folded(word: Column, slots: Column) -> Column:
    def rank_in(slot: Column, mark: Column) -> Column:
        return F.when(F.instr(slot, mark) > 0, F.substring_index(F.call_function("substring_index", slot, mark, F.lit(-1)), ";", 1).cast("int"))

    def ranks_of(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: let(F.element_at(slots, (F.crc32(p) % SLOTS + 1).cast("int")), lambda slot: F.when(slot != "", let(F.concat(F.lit(";"), F.hex(p), F.lit("=")), lambda mark: rank_in(slot, mark)))))

    def merge_at(pieces: Column, pairs: Column, at: Column) -> Column:
        return F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(F.element_at(pairs, at)), F.slice(pieces, at + 2, F.size(pieces)))

    def merge_best(pieces: Column, pairs: Column, found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        return let(at, lambda i: F.when(i.isNull(), pieces).otherwise(merge_at(pieces, pairs, i)))

    def merged(pieces: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1)))
        return let(pairs, lambda p: let(ranks_of(p), lambda found: merge_best(pieces, p, found)))

    def step(state: Column, _: Column) -> Column:
        """Pieces, and whether the last merge found nothing to do."""
        after = let(merged(state["pieces"]), lambda p: F.struct(p.alias("pieces"), (F.size(p) == F.size(state["pieces"])).alias("done")))
        return F.when(state["done"] | (F.size(state["pieces"]) < 2), state).otherwise(after)

    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    start = F.struct(single.alias("pieces"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: ranks_of(s["pieces"]))
    return let(ranks_of(F.array(word)), lambda whole: F.when(F.element_at(whole, 1).isNotNull(), whole).otherwise(folded))


def count_words(df: DataFrame, pattern: str, text_col: str) -> DataFrame:
    """(word, n): how often each distinct word of at most WORD_BYTES bytes occurs in the texts. Workers count before Spark shuffles."""

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        chunks = ChunkCounts()
        for batch in batches:
            for value in batch.column(0):
                chunks.add(value.as_py() or "")
                if len(chunks.spaced) > COUNTED or chunks.chars > COUNTED_CHARS:
                    yield chunks.words(find)
                    chunks = ChunkCounts()
        yield chunks.words(find)

    return df.select(F.col(f"`{text_col}`")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fold_vocabulary(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str) -> dict[str, bytes]:
    """The comma-joined decimal ids of the most frequent words, at most VOCABULARY of them.

    The words taken are those that occur at least 2^k times, for the least k that keeps to the bound;
    with more words than the bound that occur equally often to within a factor of 2, fewer are taken.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    count_words(df, pattern, text_col).write.parquet(folder)
    counted = spark.read.parquet(folder).withColumn("k", F.floor(F.log2("n")).cast("int"))
    least, room = 99, VOCABULARY
    for row in sorted(counted.groupBy("k").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.k):
        if row.n > room:
            break
        least, room = row.k, room - row.n
    ids = fold_merges(F.col("word").cast("binary"), rank_literal(ranks))
    folded = counted.filter(F.col("k") >= least).select("word", F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    # By the plan's own rows: a SQL execution would print the plan, with the literal's megabytes, into each of its events on the driver.
    rows = folded.rdd.map(tuple).collect()
    remove(spark, folder)
    return {word: ids.encode() for word, ids in rows}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: its bytes, of which again and again the adjacent pair of lowest rank, the leftmost of equals, becomes one piece."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) <= 48:
        rank = ranks.get
        pairs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [ranks[p] for p in parts]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(a + b + parts[k])) is not None:
                heapq.heappush(heap, (r, i, a + b, parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + a + b)) is not None:
            heapq.heappush(heap, (r, h, parts[h], a + b))
    return [ranks[p] for p in parts if p]


def packed(ids: list[int]) -> bytes:
    """ids as little-endian 32-bit integers."""
    held = array.array("i", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of pieces that are pieces when joined, as sorted numbers of the two ranks, and the ranks of what they give."""
    found = [(a << 32 | b, r) for p, r in ranks.items() for i in range(1, len(p)) if (a := ranks.get(p[:i])) is not None and (b := ranks.get(p[i:])) is not None]
    pairs, merged = np.array([*sorted(found), (NEVER, NONE)], np.int64).T
    return pairs.copy(), merged.astype(np.int32)


class Pairs:
    """Merges many words side by side, with the pairs of pair_table."""

    def __init__(self, ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        #: Else pieces can't be told by their ranks, and words are merged one by one.
        self.named = all(bytes([i]) in ranks for i in range(256)) and len(set(ranks.values())) == len(ranks)
        self.pairs, self.merged = table or pair_table(ranks)
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)
        self.singles = self.of(self.single.repeat(256), np.tile(self.single, 256)).reshape(256, 256)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pieces a + b, NONE where there is no such piece."""
        pairs = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.merged[at], np.int32(NONE))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of the words, as merge_word has them."""
        out: list[bytes] = [b""] * len(words)
        long: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if word in self.ranks or len(word) > SIDE_BYTES or not self.named:
                out[i] = packed(merge_word(word, self.ranks))
            else:
                long.setdefault(len(word), []).append(i)
        # From the longest on: a merge makes all of them a piece shorter, and the words of so many bytes join them.
        which, pieces, found = np.empty(0, np.int64), np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for width in range(max(long, default=0), 0, -1):
            if joining := long.get(width):
                raw = np.frombuffer(b"".join([words[i] for i in joining]), np.uint8).reshape(-1, width)
                which = np.append(which, joining)
                pieces = np.concatenate([pieces.reshape(-1, width), self.single[raw]])
                found = np.concatenate([found.reshape(-1, width - 1), self.singles[raw[:, :-1], raw[:, 1:]]])
            done = found.min(axis=1, initial=NONE) == NONE
            ids = pieces[done].astype("<i4").tobytes()
            for k, i in enumerate(which[done].tolist()):
                out[i] = ids[k * 4 * width : (k + 1) * 4 * width]
            which, pieces, found = which[~done], *self._merge_least(pieces[~done], found[~done])
        return out

    def _merge_least(self, pieces: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the pair of lowest rank, the leftmost of equals, in each row."""
        n, width = pieces.shape
        if not n:
            return pieces[:, 1:], found[:, 1:]
        rows, at = np.arange(n), found.argmin(axis=1)
        pieces[rows, at] = found[rows, at]
        kept = np.ones((n, width), bool)
        kept[rows, at + 1] = False
        pieces = pieces[kept].reshape(n, width - 1)
        kept = np.ones((n, width - 1), bool)
        kept[rows, at] = False
        found = found[kept].reshape(n, width - 2)
        for left, here in ((at - 1, at > 0), (at, at < width - 2)):
            r, i = rows[here], left[here]
            found[r, i] = self.of(pieces[r, i], pieces[r, i + 1])
        return pieces, found


def key_of(chunk: str) -> str:
    """What a chunk or word is kept by: itself without the space that it begins with, or behind a space if it begins with none. Of a key, it gives the chunk."""
    return chunk[1:] if chunk[:1] == " " else " " + chunk


def portions(keys: Iterable[str]) -> Iterator[list[str]]:
    """keys, by WAITING of them or WAITING_CHARS characters."""
    some: list[str] = []
    chars = 0
    for key in keys:
        some.append(key)
        chars += len(key)
        if len(some) >= WAITING or chars >= WAITING_CHARS:
            yield some
            some, chars = [], 0
    yield some


def words_of(keys: list[str], find: Callable[[str], list[str]]) -> tuple[list[int], list[str], list[int]]:
    """An order of keys of chunks, the words of all these chunks in that order, and where each chunk's words end.

    Chunks that begin with their only space next to none are matched in one text, in which each space begins a chunk."""
    joined = [i for i, key in enumerate(keys) if key and not key[0].isspace() and not key[-1].isspace()]
    words = find(" " + " ".join([keys[i] for i in joined])) if joined else []
    ends = [i for i, word in enumerate(words) if word[:1] == " "][1:]
    ends += [len(words)] if joined else []
    if len(ends) != len(joined):  # a pattern of another kind
        joined, words, ends = [], [], []
    if len(joined) < len(keys):
        apart = set(joined)
        apart = [i for i in range(len(keys)) if i not in apart]
        joined += apart
        for i in apart:
            words += find(key_of(keys[i]))
            ends.append(len(words))
    return joined, words, ends


class Chunks(dict):
    """Packed ids of chunks, by key_of: a space and what follows it up to the next space. What a new chunk gives is empty until the next call of settle."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, folded: dict[str, bytes] | None = None, table: tuple[np.ndarray, np.ndarray] | None = None):
        import regex

        self.find, self.folded, self.pairs = regex.compile(pattern).findall, folded or {}, Pairs(ranks, table)
        self.words: dict[str, bytes] = {}  # the chunks of before
        self.new: dict[str, bytearray] = {}
        self.chars = 0

    def __missing__(self, key: str) -> bytes | bytearray:
        ids = self.words.get(key)
        if ids is not None or (ids := self.folded.get(key)) is not None:
            self.remember(key, ids)
        elif (ids := self.new.get(key)) is None:
            ids = self.new[key] = bytearray()
            self.chars += len(key)
        return ids

    def remember(self, key: str, ids: bytes) -> None:
        if len(key) < 256:
            if len(self) >= MAX_CHUNKS // 2:
                self.words = self.copy()
                self.clear()
            self[key] = ids

    def settle(self) -> None:
        """Fills in what new chunks gave. Their words that are in no table yet are merged side by side."""
        keys, holes = list(self.new), list(self.new.values())
        order, words, ends = words_of(keys, self.find)
        met = dict.fromkeys(words)
        for word in met:
            met[word] = self.folded.get(key_of(word))
        unknown = [w for w, ids in met.items() if ids is None]
        for at in range(0, len(unknown), WAITING):
            some = unknown[at : at + WAITING]
            met.update(zip(some, self.pairs.merge([w.encode() for w in some])))
        ids, start = [met[w] for w in words], 0
        for i, end in zip(order, ends):
            whole = ids[start] if end - start == 1 else b"".join(ids[start:end])
            holes[i] += whole
            self.remember(keys[i], whole)
            start = end
        self.new, self.chars = {}, 0


#: White space: before a space, the pattern's matches may cross a cut at that space.
WHITE = tuple(chr(c) for c in range(0x3001) if chr(c).isspace())


def crossing(text: str) -> bool:
    """Whether white space is before a space. One character is found much faster than two, and most are in no text."""
    return any([c + " " in text for c in WHITE if c in text])


def encode_text(text: str, chunks: Chunks) -> bytes:
    return encode_all([text], chunks)[0]


def encode_all(texts: Iterable[str], chunks: Chunks) -> list[bytes]:
    """Packed ids of each text."""
    out: list[bytes] = []
    parts: list[list[bytes | bytearray]] = []
    held = 0

    def settle() -> None:
        chunks.settle()
        out.extend(map(b"".join, parts))
        parts.clear()

    for text in texts:
        if crossing(text):
            parts.append([chunks[" " + text]])
        else:
            first, *rest = text.split(" ")
            parts.append([chunks[" " + first], *map(chunks.__getitem__, rest)])
        held += len(parts[-1])
        if len(chunks.new) > WAITING or max(chunks.chars, held) > WAITING_CHARS:
            settle()
            held = 0
    settle()
    return out


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The pieces in order of their ids, as hexadecimal digits: a literal array, in which one is found at once."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece.hex()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The joined pieces (binary) of ids (array<int>); an id beyond the last piece is an error. Spark joins their digits, in time that follows their number."""
    return let(piece_literal(ranks), lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), "")))


class ChunkCounts:
    """Counts of the chunks that encode_text takes texts apart into."""

    def __init__(self):
        self.spaced: Counter[str] = Counter()  # chunks that begin with a space, without it
        self.others: Counter[str] = Counter()
        self.chars = 0

    def add(self, text: str) -> None:
        if not text:
            return
        if crossing(text):
            self.others[text] += 1
            self.chars += len(text)
            return
        parts = text.split(" ")
        self.spaced.update(parts)
        self.spaced[parts[0]] -= 1
        if parts[0]:
            self.others[parts[0]] += 1

    def words(self, find: Callable[[str], list[str]]) -> pa.RecordBatch:
        """(word, n) of the words of at most WORD_BYTES bytes."""
        words: dict[str, int] = {}
        for counts, space in ((self.spaced, ""), (self.others, " ")):
            for some in portions(chunk for chunk, n in counts.items() if n):
                order, found, ends = words_of([space + chunk for chunk in some] if space else some, find)
                start = 0
                for i, end in zip(order, ends):
                    n = counts[some[i]]
                    for word in found[start:end]:
                        words[word] = words.get(word, 0) + n
                    start = end
        kept = [w for w in words if len(w) <= WORD_BYTES and len(w.encode()) <= WORD_BYTES]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with the columns token_ids (array<int>) of each whole text and decoded (binary), the joined pieces of those ids.

    Each match of the pattern is encoded separately; there are no special tokens. A
    null text counts as empty and has no ids. Columns of these names are replaced;
    every row is kept, repeated rows too; an empty table gives an empty one. Words of more
    than WORD_BYTES bytes are merged with a heap, so a text without spaces takes time in
    proportion to n log n. df is read twice: its words are counted and folded in this call.
    """
    ranks = read_ranks(ranks_path)
    encoded = _encoded(df.select(*(F.col(f"`{c}`") for c in without(df, ["decoded"]))), ranks, pattern, text_col)
    return encoded.withColumn("decoded", decode_ids(F.col("token_ids"), ranks))


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """As encode_texts, but with n_tokens and the digests of ids and decoded bytes instead."""
    ranks = read_ranks(ranks_path)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    encoded = _encoded(df.select(*(F.col(f"`{c}`") for c in without(df, names))), ranks, pattern, text_col)
    kept = [F.col(f"`{c}`") for c in without(df, [*names, "token_ids"])]
    ids = F.col("token_ids")
    written = F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
    return encoded.select(*kept, F.size(ids).cast("long").alias("n_tokens"), written.alias("ids_sha256"), F.sha2(decode_ids(ids, ranks), 256).alias("decoded_sha256"))


def _encoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str) -> DataFrame:
    import regex

    find = regex.compile(pattern).findall
    vocabulary = fold_vocabulary(df, ranks, pattern, text_col)
    folded = {key_of(word): packed(list(map(int, ids.split(b",")))) for word, ids in vocabulary.items() if find(word) == [word]}
    held = df.sparkSession.sparkContext.broadcast((ranks, folded, pair_table(ranks)))
    run = uuid.uuid4().hex

    def make():
        store = worker_store("byte_bpe")
        if run not in store:
            store.clear()
            store[run] = Chunks(held.value[0], pattern, *held.value[1:])
        chunks = store[run]

        def kernel(texts):
            joined = encode_all((value.as_py() or "" for value in texts), chunks)
            ends = np.cumsum([0, *map(len, joined)]) // 4
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(joined), "<i4").astype(np.int32, copy=False)))]

        return kernel

    return with_computed(df, [text_col], "token_ids array<int>", make, "byte_bpe")
