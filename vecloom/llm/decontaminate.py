"""Benchmark decontamination with DataFrame functions only.

The windows of a benchmark's items are a hash set that goes to the tasks as a literal; every
token window of every document is looked up in it by hash, hits are verified by their
words, and what they cover is counted and can be removed. Nothing is shuffled. Of a benchmark
whose windows exceed a bound the literal is a bitmap of their hashes, of bounded size: only positions that
it marks leave their row, to be joined by their words.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, let, without

#: Words in a window; an item of fewer has one window of all its words.
WINDOW = 10
#: What separates words: ASCII but for digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A set of windows of at most so many, and of so many characters, is sent as a literal.
LITERAL_WINDOWS, LITERAL_CHARS = 100_000, 16 << 20
#: Least and most bits of a bitmap of hashes; between these it has 16 for each window.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Separate the parts of the literal table: buckets, entries, a window's words from its items. No word holds them.
BUCKET, ENTRY, ITEMS = "\x02", "\x01", "\x03"
#: Stands for the id of items without one.
UNNAMED = "\x04"
OUTPUTS = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def once(col: Column) -> Column:
    """col, always; the condition, which holds for every row, keeps the optimiser from moving col
    into filters or lambdas above, where it would be computed again for each word."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, unnamed: bool = False) -> DataFrame:
    """A row for each distinct window: length, gram (its words, joined by spaces), ids (sorted as strings). Items without an id have UNNAMED, if unnamed is set, or else no window."""
    split = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(UNNAMED if unnamed else None)).alias("id"), words_of(F.col(f"`{text_col}`")).alias("w"))
    sized = split.filter((F.size("w") > 0) & F.col("id").isNotNull()).withColumn("length", F.least(F.size("w"), F.lit(window)))
    grams = sized.select("id", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"), "w")
    joined = grams.select("id", "length", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("length"))).alias("gram"))
    return joined.groupBy("length", "gram").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _spans_covered(spans: Column) -> Column:
    """Words covered by spans (at, length) in order of at."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = (s["at"] + s["length"]).cast("long")
        first = F.greatest(acc["end"], s["at"].cast("long"))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - first)).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def find_contamination(df: DataFrame, items: DataFrame, text_col: str | Column = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, literal_windows: int = LITERAL_WINDOWS, unnamed: bool = False) -> DataFrame:
    """df with n_words, n_hit (words inside any occurrence of a window), n_items, item_ids
    (string ids of items with occurring windows, sorted), hit_spans (array of struct at
    (word number from 1), length) and contaminated (n_hit > 0).

    A null or empty text has no words and no hits. Items without a word have no window; nor
    have items without an id, unless unnamed is set: their windows then count for n_hit, hit_spans and
    contaminated, all such items count as one in n_items, and none is in item_ids. With no window at all
    nothing is contaminated. Items of the same window are all named. Columns of these names are replaced; every row is kept, repeated
    rows too.
    """
    held = windows_of(items, item_id_col, item_text_col, window, unnamed)
    sizes = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("gram") + F.size("ids") * 20), F.lit(0)).alias("chars"), F.array_sort(F.collect_set("length")).alias("lengths")).first()
    base = df.select(*(F.col(f"`{c}`") for c in without(df, OUTPUTS)), once(words_of(column(text_col))).alias("__found_w"))
    if sizes.n <= literal_windows and sizes.chars <= LITERAL_CHARS:
        found = _by_literal(base, held, sizes)
    else:
        found = _by_join(base, held, sizes)
    kept = [F.col(f"`{c}`") for c in without(df, OUTPUTS)]
    return found.select(*kept, F.size("__found_w").cast("long").alias("n_words"), _spans_covered(F.col("__found_spans")).alias("n_hit"), F.size("__found_ids").cast("long").alias("n_items"), F.filter("__found_ids", lambda i: i != UNNAMED).alias("item_ids"), F.col("__found_spans").alias("hit_spans"), (F.size("__found_spans") > 0).alias("contaminated"))


def _by_literal(base: DataFrame, held: DataFrame, sizes) -> DataFrame:
    """Windows as literals: their hashes as a hash set, and buckets of a hash table as an array of strings to verify hits in."""
    buckets = max(1, 2 * sizes.n)
    rows = held.select("gram", "length", F.array_join("ids", ",").alias("ids"), F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(F.split("gram", " ")).alias("hash")).collect()  # bounded by literal_windows
    table = [ENTRY] * buckets
    hashes: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.gram, r.length)):
        table[r.bucket] += f"{r.gram}{ITEMS}{r.ids}{ENTRY}"
        hashes.setdefault(r.length, []).append(r.hash)
    lookup = F.split(F.lit(BUCKET.join(table)), BUCKET)  # foldable: made once, when the plan is optimised

    def bucket(gram: Column) -> Column:
        return F.element_at(lookup, (F.pmod(F.xxhash64(gram), F.lit(buckets)) + 1).cast("int"))

    def before(tail: Column) -> Column:
        return F.substring_index(tail, ENTRY, 1)

    def verifier(length: int) -> Callable[[Column], Column]:
        def verify(i: Column) -> Column:
            gram = F.concat_ws(" ", F.slice(w, i, F.lit(length)))
            mark = F.concat(F.lit(ENTRY), gram, F.lit(ITEMS))
            found = let(bucket(gram), lambda b: F.when(F.instr(b, mark) > 0, before(F.call_function("substring_index", b, mark, F.lit(-1)))))
            return F.struct(i.alias("at"), F.lit(length).alias("length"), found.alias("ids"))

        return verify

    hits = F.array().cast("array<struct<at:int,length:int,ids:string>>")
    w = F.col("__found_w")
    for length, known in sorted(hashes.items()):
        ids_in = ",".join(f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)" for h in known)
        at = F.expr(f"filter(CASE WHEN size(__found_w) >= {length} THEN sequence(1, size(__found_w) - {length - 1}) ELSE array() END, i -> xxhash64(slice(__found_w, i, {length})) IN ({ids_in}))")

        hits = F.concat(hits, F.filter(F.transform(at, verifier(length)), lambda h: h["ids"].isNotNull()))
    step = base.withColumn("__found_hits", once(F.array_sort(hits)))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform("__found_hits", lambda h: h["ids"])), lambda s: F.split(s, ",")))))
    return step.withColumn("__found_ids", ids).withColumn("__found_spans", F.transform("__found_hits", lambda h: F.struct(h["at"].alias("at"), h["length"].alias("length")))).drop("__found_hits")


def _bitmap(held: DataFrame, windows: int) -> tuple[Column, int]:
    """The hashes of windows as a literal array of 64-bit words, and its bits: bounded, however many windows there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * windows).bit_length()))
    at = F.pmod(F.xxhash64(F.split("gram", " ")), F.lit(bits))
    marked = held.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("marks"))
    words = [0] * (bits // 64)
    for r in marked.collect():  # at most MOST_BITS / 64 rows
        words[r.word] = r.marks
    return F.from_json(F.lit(json.dumps(words)), "array<long>"), bits


def _by_join(base: DataFrame, held: DataFrame, sizes) -> DataFrame:
    """Windows as a table: positions whose hash the bitmap marks are exploded and joined by their words; hits alone are gathered, by row.

    Rows are numbered by monotonically_increasing_id over a table cut from its lineage, so that a task run again numbers them alike."""
    from .common import cut

    numbered = cut(base.withColumn("__found_row", F.monotonically_increasing_id()))
    words, bits = _bitmap(held, sizes.n)
    spots = None
    for length in sizes.lengths:
        every = F.when(F.size("__found_w") >= length, F.sequence(F.lit(1), F.size("__found_w") - length + 1)).otherwise(F.array().cast("array<int>"))

        def marked(i: Column, length: int = length) -> Column:
            return let(F.pmod(F.xxhash64(F.slice("__found_w", i, F.lit(length))), F.lit(bits)), lambda at: F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0)

        at = F.filter(every, lambda i: marked(i))
        one = numbered.select("__found_row", "__found_w", F.explode(at).alias("at")).select("__found_row", "at", F.lit(length).alias("length"), F.concat_ws(" ", F.slice("__found_w", F.col("at"), F.lit(length))).alias("gram"))
        spots = one if spots is None else spots.unionByName(one)
    hits = spots.join(held, ["length", "gram"])
    spans = hits.groupBy("__found_row").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("__found_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("__found_ids"))
    none = F.array().cast("array<struct<at:int,length:int>>"), F.array().cast("array<string>")
    joined = numbered.join(spans, "__found_row", "left")
    return joined.withColumn("__found_spans", F.coalesce("__found_spans", none[0])).withColumn("__found_ids", F.coalesce("__found_ids", none[1])).drop("__found_row")


def remove_contamination(found: DataFrame, text_col: str = "text", mode: str = "documents") -> DataFrame:
    """What find_contamination returned, without its hits: mode `documents` drops contaminated rows;
    mode `spans` cuts the hit words, each with the separator before it, out of their texts and keeps all rows."""
    if mode == "documents":
        return found.filter(~F.col("contaminated"))
    if mode != "spans":
        raise ValueError("mode must be documents or spans")
    text = F.col(f"`{text_col}`")
    words = F.filter(F.split(text, SEPARATOR), lambda w: w != "")
    gaps = F.split(text, WORD, -1)  # one more than there are words

    def kept(gap: Column) -> Column:
        return let(words, lambda w: F.concat(
            F.array_join(F.transform(w, lambda x, i: F.when(F.exists("hit_spans", lambda s: (s["at"] <= i + 1) & (i + 1 < s["at"] + s["length"])), F.lit("")).otherwise(F.concat(F.element_at(gap, i + 1), x))), ""),
            F.element_at(gap, -1),
        ))

    return found.withColumn(text_col, F.when(F.col("contaminated"), let(gaps, kept)).otherwise(text))
