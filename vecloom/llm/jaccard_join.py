"""Exact n-gram Jaccard self-join by PartEnum signatures, and its connected components.

Sets of word shingles are put in bands of size. Within a band the domain of shingle hashes
is dealt into partitions, and each partition into cells. Of the partitions there are so
many that sets of the band which link differ in few elements on one of them at least, in no more
than DIFFER; there they agree on all but DIFFER of its cells. So every subset of that many cells
is enumerated, and its content is a signature: sets that link share one.

Equal sets are one class. Sets that share a signature are candidates. Candidates are
dropped by a bound, the distance of their parity sketches, which the difference of the
sets is never below, and the others are verified on their whole texts. A group of one
signature is never paired out at first: its members are held against one of them, what is
linked becomes one component, and only members of different components are compared, in
tiles of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy, with_computed

SHINGLE, PERCENT = 5, 80
#: Largest size of the first band, and what a band's is of that of the one before.
FIRST_BAND, BAND_NUMERATOR, BAND_DENOMINATOR = 3, 8, 5
#: Rows of a batch that a kernel takes at once.
STEP = 512
#: Characters that a kernel hashes at once, about; a longer text is hashed alone.
GROUP_BYTES = 1 << 20
#: Bytes of a sketch: two bits to an element at least, up to the most.
LEAST_SKETCH, MOST_SKETCH = 8, 4_096
#: Members of a group that one tile of the comparison holds of each side; members that are compared at once with others, and others.
TILE, ROWS, BLOCK = 2_048, 32, 512
#: Words of sketches that are compared at once, about.
WORDS = 1 << 19
#: Nearest pairs of two components that a tile gives in the rounds before the last; those rounds.
FEW, ROUNDS = 4, 1
#: Members of one signature that a task holds; a larger group is handed on in parts.
HELD = 2_000_000
#: Pairs of one class that a task verifies; with more they are dealt to several.
PAIRS = 256
#: Class numbers or groups that a task remembers, to give each once; forgetting repeats some.
SEEN = 200_000
#: Classes whose number and key, 16 bytes a row, are broadcast to fetch their texts; with more the texts are shuffled.
BROADCAST_ROWS = 500_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


class Shingler:
    """Sorted distinct shingle hashes of texts, words hashed by polynomials of their bytes."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        numbers = mix(np.arange(1, 1025, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
        self.bytes = numbers[:256].copy()
        self.bytes[65:91] = self.bytes[97:123]
        self.places = numbers[256 : 256 + size]
        self.lengths = numbers[512 : 512 + size]
        self.base = int(numbers[900])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * U(pow(self.base, k, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * U(pow(self.inverse, k, 1 << 64))])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > GROUP_BYTES:
                out += self.group(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        return out + (self.group(group) if group else [])

    def group(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = self.space[data]
        before = np.concatenate(([True], gap[:-1]))
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        self.grow(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bytes[data] * self.powers[: len(data)], dtype=np.uint64)))
        words = mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        n, k = len(words), self.size
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k if len(rolled) else 0):
            rolled += words[j : n - k + 1 + j] * self.places[j]
        rolled = mix(rolled)
        tops = np.cumsum([len(t) + 1 for t in texts])
        stops = np.searchsorted(starts, tops)
        out, first = [], 0
        for stop in stops.tolist():
            if stop - first >= k:
                part = np.sort(rolled[first : stop - k + 1])
                out.append(part if len(part) < 2 else part[np.concatenate(([True], part[1:] != part[:-1]))])
            elif stop > first:
                m = stop - first
                out.append(mix((words[first:stop] * self.places[:m]).sum(dtype=np.uint64, keepdims=True) + self.lengths[m]))
            else:
                out.append(np.zeros(0, np.uint64))
            first = stop
        return out


def class_of(shingles: np.ndarray) -> int:
    """A number for a set; equal sets have equal ones."""
    total = mix(shingles + U(0x51ED270B)).sum(dtype=np.uint64, keepdims=True)
    return int((total + np.array([len(shingles)], np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)[0])


def difference(a, b):
    """The most elements that sets of these sizes can differ in when they link."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def bands() -> list[int]:
    """The largest size of each band."""
    out = [FIRST_BAND]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * BAND_NUMERATOR // BAND_DENOMINATOR))
    return out


BANDS = np.array(bands())


class Scheme:
    """Partitions of a band: their number, cells of each, and the subsets of cells, all but `differ`, that are enumerated."""

    def __init__(self, level: int):
        most = difference(int(BANDS[level]), int(BANDS[level]))
        if most <= 4:  # small sets: one partition, many cells
            self.parts, self.cells, self.differ = 1, 7, most
        elif most <= 7:
            self.parts, self.cells, self.differ = 2, 6, 3
        elif most <= 15:
            self.parts, self.cells, self.differ = most // 3 + 3, 4, 2
        else:
            self.parts, self.cells, self.differ = most // 2 + 3 + most // 32, 3, 1
        subsets = list(itertools.combinations(range(self.cells), self.cells - self.differ))
        self.take = np.zeros((self.cells, len(subsets)), np.uint64)
        for i, subset in enumerate(subsets):
            self.take[list(subset), i] = 1
        self.names = mix(np.arange(self.parts * len(subsets), dtype=np.uint64) * U(0xD6E8FEB86659FD93) + U(level + 1)).reshape(self.parts, -1)
        n = self.parts * self.cells
        self.edges = np.array([(i << 64) // n for i in range(n)], np.uint64)


def signatures(shingles: np.ndarray, schemes: dict[int, Scheme] | None = None) -> np.ndarray:
    """PartEnum signatures of a sorted set in its band, and in the next where a similar set may lie in that.

    Partitions are taken in order. One on which every enumerated subset holds something is full. Of
    two sets that link, differing in at most `most`, at most most // (differ + 1) differ too
    much on a full partition, so a set stops after one more full ones: the first partition on
    which the sets agree on a subset that holds something is among those of both. If there is none,
    neither set comes to its stop, and sets that don't give signatures of empty subsets too. Sets of
    up to three elements link with equal ones only and have one, of all their content.
    """
    size, out, schemes = len(shingles), [], {} if schemes is None else schemes
    band = int(np.searchsorted(BANDS, size))
    for level in (band, band + 1):
        low, high = int(BANDS[level - 1]) if level else 0, int(BANDS[level])
        if not level or (level > band and 100 * size < PERCENT * (low + 1)):
            continue
        most = difference(size, min(size * 100 // PERCENT, high))
        if not most:
            continue
        if level not in schemes:
            schemes[level] = Scheme(level)
        s = schemes[level]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles + U(0x2545F491)), dtype=np.uint64)))
        at = np.append(np.searchsorted(shingles, s.edges), size)
        counts = np.diff(at).reshape(s.parts, s.cells)
        full = np.cumsum((counts == 0).sum(axis=1) < s.cells - s.differ)
        stop = int(np.searchsorted(full, most // (s.differ + 1) + 1)) + 1  # beyond all of them where there are too few full ones
        content = np.diff(sums[at]).reshape(s.parts, s.cells)[:stop]
        keys = mix(mix(content @ s.take + s.names[:stop]))
        out.append(keys[(counts[:stop] > 0) @ (s.take > 0)] if stop <= s.parts else keys.ravel())
    return np.concatenate(out) if out else mix(mix(shingles + U(0x2545F491)).sum(dtype=np.uint64, keepdims=True))[: size]


def sketch(shingles: np.ndarray) -> bytes:
    """For each place whether an odd number of elements falls on it: places are twice as many bits as elements, or more, up to a bound."""
    size = min(max(LEAST_SKETCH, 1 << (len(shingles) - 1).bit_length() >> 2), MOST_SKETCH)
    at = (shingles * U(0x9FB21C651E98DF25) >> U(40)).astype(np.int64) & (8 * size - 1)
    return np.packbits(np.bincount(at, minlength=8 * size).astype(np.uint8) & 1, bitorder="little").tobytes()


class Sketches:
    """The sketches of a binary column, as words. Halves of a longer one folded on each other make a shorter one."""

    def __init__(self, sizes: np.ndarray, raw: pa.BinaryArray):
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        self.n, self.at, self.bytes = sizes, offsets[:-1], np.diff(offsets)
        self.data = np.frombuffer(raw.buffers()[2], np.uint8)

    def words(self, rows: np.ndarray, size: int) -> np.ndarray:
        """[row, word] of sketches of at least size bytes, folded to that."""
        out = np.empty((len(rows), size // 8), np.uint64)
        for own in np.unique(self.bytes[rows]).tolist():
            some = np.flatnonzero(self.bytes[rows] == own)
            data = self.data[self.at[rows[some]][:, None] + np.arange(own)].view(np.uint64)
            out[some] = np.bitwise_xor.reduce(data.reshape(len(some), own // size, size // 8), axis=1)
        return out


def may_link(one: Sketches, two: Sketches) -> np.ndarray:
    """Rows of which the two sets may link. Places whose parity differs are no more than elements in which sets differ, so what is passed over doesn't link."""
    most = difference(one.n, two.n)
    rows = np.flatnonzero(np.abs(one.n - two.n) <= most)
    size = np.minimum(one.bytes[rows], two.bytes[rows])
    keep = []
    for own in np.unique(size).tolist():
        some = rows[size == own]
        gap = np.bitwise_count(one.words(some, own) ^ two.words(some, own)).sum(axis=1, dtype=np.int64)
        keep.append(some[gap <= most[some]])
    return np.sort(np.concatenate(keep)) if keep else rows


def class_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, cls (null for the empty set) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in in_steps(batches):
            sets = shingler.sets([(t.as_py() or "").encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["key", "n", "cls", "sketch"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), f"key {kind}, n long, cls long, sketch binary")


def class_texts(df: DataFrame, text: str) -> DataFrame:
    """cls and text: a task gives a text of each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in in_steps(batches):
            classes, places = [], []
            for i, s in enumerate(shingler.sets([(t.as_py() or "").encode() for t in batch.column(0)])):
                if len(s) and (c := class_of(s)) not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(c)
                    classes.append(c)
                    places.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), batch.column(0).take(pa.array(places, pa.int64()))], names=["cls", "text"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "cls long, text string")


def signature_rows(df: DataFrame, text: str) -> DataFrame:
    """sig and cls: a task gives those of each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, schemes, seen = Shingler(), {}, set()
        for batch in in_steps(batches):
            keys, classes, held = [], [], 0
            for s in shingler.sets([(t.as_py() or "").encode() for t in batch.column(0)]):
                if len(s) and (c := class_of(s)) not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(c)
                    keys.append(signatures(s, schemes).view(np.int64))
                    classes.append(np.full(len(keys[-1]), c, np.int64))
                    held += len(keys[-1])
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes))], names=["sig", "cls"])
                        keys, classes, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes))], names=["sig", "cls"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "sig long, cls long")


def group_rows(signed: DataFrame) -> DataFrame:
    """g, a, b: for each signature that several classes have, its least class a and each other b. g numbers
    the set of its classes, so that signatures with the same classes are one group; a group of more
    than HELD members has a number of its own and is given out as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sig, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large: tuple[int, int] | None = None  # signature and least class of a group that was given out in part

        def record(g: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (g, a, b)], names=["g", "a", "b"])

        def part_of_large(number: int, least: int, others: np.ndarray) -> Iterator[pa.RecordBatch]:
            others = others[others != least]
            g = int(mix(np.array([number], np.int64).view(np.uint64)).view(np.int64)[0])
            yield from record([np.full(len(others), g)], [np.full(len(others), least)], [others])

        def emit(sig: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
            if large and len(sig) and sig[0] == large[0]:
                mine = int(np.searchsorted(sig, large[0], side="right"))
                yield from part_of_large(*large, cls[:mine])
                sig, cls = sig[mine:], cls[mine:]
            if not len(sig):
                return
            fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
            sig, cls = sig[fresh], cls[fresh]
            first = np.concatenate(([0], np.flatnonzero(sig[1:] != sig[:-1]) + 1))
            sizes = np.diff(np.append(first, len(sig)))
            numbers = np.add.reduceat(mix(cls.view(np.uint64)), first).view(np.int64)
            g, a, b = [], [], []
            for i in np.flatnonzero(sizes > 1).tolist():
                number = int(numbers[i])
                if number not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(number)
                    members = cls[first[i] : first[i] + sizes[i]]
                    g.append(np.full(len(members) - 1, number))
                    a.append(np.full(len(members) - 1, members[0]))
                    b.append(members[1:])
            yield from record(g, a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.concatenate([sig, batch.column(0).to_numpy()])
            cls = np.concatenate([cls, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on
            yield from emit(sig[:whole], cls[:whole])
            sig, cls = sig[whole:].copy(), cls[whole:].copy()
            if len(sig) > HELD:
                if not large or large[0] != sig[0]:
                    large = int(sig[0]), int(cls[0])
                yield from part_of_large(*large, cls)
                sig, cls = sig[:0], cls[:0]
        yield from emit(sig, cls)

    dealt = signed.repartition("sig").sortWithinPartitions("sig", "cls")
    return dealt.mapInArrow(tidy(run), "g long, a long, b long").distinct()


def filter_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b that the bound leaves."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(at, 4 * BLOCK)
                one, two = (Sketches(part.column(n).to_numpy(), part.column(s)) for n, s in (("na", "sa"), ("nb", "sb")))
                yield part.select(["a", "b"]).take(pa.array(may_link(one, two)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def tiles_of(members: DataFrame) -> DataFrame:
    """members (g, cls, c) of groups that hold several components, once for each tile of their
    group: i and j number a tile's two parts of the group, side is that which the member is in. A group of up to TILE
    members is one tile."""
    sized = members.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("parts")).filter("lo <> hi").select("g", "parts")
    dealt = members.join(sized, "g").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("g", "cls", "c", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")


def compare_components(tiles: DataFrame, few: bool = False) -> DataFrame:
    """Pairs a, b (a < b) of a group's members in different components that the bound leaves. tiles: g, i, j, side, cls, c, n, sketch.

    Members' sketches are compared in blocks; only what the bound leaves is given out, and if few is set, of the
    pairs of two components in a tile no more than the FEW nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
            i, j, side, cls, c, n = (part.column(x).to_numpy() for x in ("i", "j", "side", "cls", "c", "n"))
            if c.min() == c.max():
                return
            sketches = Sketches(n, part.column("sketch").combine_chunks())
            words = sketches.words(np.arange(len(n)), int(sketches.bytes.min()))
            order = np.argsort(n, kind="stable")
            cls, c, n, side, words = cls[order], c[order], n[order], side[order], words[order]
            apart, block = i[0] != j[0], max(16, min(BLOCK, WORDS // (ROWS * words.shape[1])))
            a, b, gaps = [], [], []
            for top in range(0, len(cls) - 1, ROWS):
                rows = np.arange(top, min(top + ROWS, len(cls)))
                last = int(np.searchsorted(n, n[rows[-1]] * 100 // PERCENT, side="right"))
                for at in range(top, last, block):
                    x = np.arange(at, min(at + block, last))
                    wanted = (c[x][None, :] != c[rows][:, None]) & (x[None, :] > rows[:, None])
                    if apart:
                        wanted &= side[x][None, :] != side[rows][:, None]
                    if not wanted.any():
                        continue
                    gap = np.bitwise_count(words[x][None, :, :] ^ words[rows][:, None, :]).sum(axis=2, dtype=np.int32)
                    y, z = np.nonzero(wanted & (gap <= difference(n[x][None, :], n[rows][:, None])))
                    a.append(rows[y])
                    b.append(x[z])
                    gaps.append(gap[y, z])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                if few:
                    one, two = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
                    order = np.lexsort((np.concatenate(gaps), two, one))
                    same = np.concatenate(([False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])))
                    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                    a, b = a[order[rank < FEW]], b[order[rank < FEW]]
                a, b = cls[a], cls[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def whole(table: pa.Table, last: bool) -> Iterator[pa.Table]:
            """The tiles of table, but for the last, which may go on."""
            keys = np.stack([table.column(x).to_numpy() for x in ("g", "i", "j")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            for first, stop in zip(edges[:-2].tolist(), edges[1:-1].tolist()):
                yield table.slice(first, stop - first)
            held[:] = table.slice(int(edges[-2])).to_batches()
            if last:
                yield table.slice(int(edges[-2]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) > 2 * TILE:
                    for tile in whole(pa.Table.from_batches(held), False):
                        yield from pairs(tile)
        if held:
            for tile in whole(pa.Table.from_batches(held), True):
                yield from pairs(tile)

    dealt = tiles.select("g", "i", "j", "side", "cls", "c", "n", "sketch").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b that link, by their whole texts. texts: cls, text; a text that isn't its class's is passed over.

    The text of a goes once to each task that has pairs of it; a with very many pairs is dealt to several."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts"))
    firsts = salts.join(texts, F.col("a") == F.col("cls")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    seconds = pairs.join(texts, F.col("b") == F.col("cls")).join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        last, last_set = None, None
        for batch in batches:
            for top in range(0, batch.num_rows, PAIRS):
                part = batch.slice(top, PAIRS)
                keep = []
                for a, b, one in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingler.sets([t.as_py().encode() for t in part.column("text")])):
                    if b is None:
                        if class_of(one) == a:
                            last, last_set = a, one
                        keep.append(False)
                    else:
                        keep.append(last == a and class_of(one) == b and links(last_set, one))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = firsts.unionByName(seconds).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """cls and c, the least class of its component, for all classes in edges a, b.

    Labels go along edges, and from the fourth round on also to their label's label, until none
    changes; each round is cut from its lineage."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("c")))
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.cls).select(F.col("a").alias("cls"), "c", F.lit(None).cast("long").alias("old"))
        moved = near.union(labels.select("cls", "c", F.col("c").alias("old"))).groupBy("cls").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        if turn > 3:  # long chains
            moved = cut(moved)
            to = moved.select(F.col("cls").alias("k"), F.col("c").alias("far"))
            moved = moved.join(to, F.col("c") == F.col("k")).select("cls", F.least("c", "far").alias("c"), "old")
        labels = cut(moved)
        if not labels.filter("c <> old").head(1):
            return labels.select("cls", "c")


def jaccard_components(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: its key, n_shingles (size of the set of distinct five-word
    shingles), component_id (least key reachable by links, its own included) and cls (the
    number of its set).

    Words are what stands between ASCII white space, A-Z lower-cased. A text of fewer than
    five words has its whole sequence as one shingle; without words, or null, its set is
    empty, its cls null, and it links with nothing. Two rows link when 100 * intersection >=
    80 * union. Rows with equal sets are linked, whatever their keys. A null key is passed
    over when the least is taken; a component without any other has a null component_id. Rows
    that share a key each keep their own set and component. An empty table gives an empty one.
    """
    rows = cut(class_rows(df, key_col, text_col))
    classes = cut(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    unnamed = bool(classes.filter("rep IS NULL").head(1))
    groups = cut(group_rows(signature_rows(df, text_col)))

    def check(pairs: DataFrame, bounded: bool = False) -> DataFrame:
        pairs = cut(pairs if bounded else filter_pairs(pairs, classes))
        wanted = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes, "cls").select("cls", "rep"))
        named = wanted.filter("rep IS NOT NULL")
        small = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
        texts = df.select(F.col(f"`{key_col}`").alias("rep"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(small, "rep").select("cls", "text")
        if unnamed:  # classes whose only keys are null: their texts are found by their sets
            rest = class_texts(df.filter(F.col(f"`{key_col}`").isNull()), text_col)
            texts = texts.union(rest.join(wanted.filter("rep IS NULL").select("cls"), "cls").select("cls", "text").dropDuplicates(["cls"]))
        return cut(verify(pairs, texts))

    edges = check(groups.select("a", "b").distinct())
    found = components(edges)
    members = groups.select("g", F.col("a").alias("cls")).distinct().union(groups.select("g", "b"))
    turn = ROUNDS
    while True:  # large components that link by many pairs become one by few of them; the last round, 0, leaves no pair out
        tiles = cut(tiles_of(members.join(found, "cls", "left").select("g", "cls", F.coalesce("c", "cls").alias("c"))))
        if not tiles.head(1):
            break
        new = check(compare_components(tiles.join(classes.select("cls", "n", "sketch"), "cls"), few=turn > 0), bounded=True)
        merged = bool(new.head(1))
        if merged:
            edges = cut(edges.union(new))
            found = components(edges)
        if turn == 0:
            break
        turn = turn - 1 if merged else 0
    labelled = classes.join(found, "cls", "left").select("cls", "rep", F.coalesce("c", "cls").alias("c"))
    least = labelled.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_class = labelled.join(least, "c").select("cls", "component_id")
    out = rows.select("key", "n", "cls").join(by_class, "cls", "left")
    return out.select(F.col("key").alias(key_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), "cls")


def drop_near_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: the one whose key is the component's. Rows with a null key,
    or without words, stay; repeated rows (key and text alike) become one. Rows that share a key go or stay
    each by its own text."""
    found = cut(jaccard_components(df, key_col, text_col).select(key_col, "component_id", "cls"))
    gone = found.filter(F.col(key_col) != F.col("component_id")).select(key_col, F.col("cls").alias("__cls")).distinct()
    twice = found.filter(F.col(key_col).isNotNull()).groupBy(key_col).count().filter("count > 1").head(1)
    if not twice:
        return df.join(gone.select(key_col), key_col, "left_anti").select(df.columns)

    def make_kernel():
        shingler = Shingler()
        return lambda texts: [pa.array([class_of(s) if len(s) else None for s in shingler.sets([(t.as_py() or "").encode() for t in texts])], pa.int64())]

    own = with_computed(df, [text_col], "__cls long", make_kernel)
    return own.join(gone, [key_col, "__cls"], "left_anti").select(df.columns).dropDuplicates([key_col, text_col])
