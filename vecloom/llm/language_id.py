"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text, over the bytes of its letters. A text is
parsed against it greedily: each phrase is the longest match that the automaton allows from
where the last one ended. The language that needs the fewest phrases for each byte wins.

Texts are parsed in blocks, all blocks in lockstep, each as if a phrase began there. What a block
before really leaves open is then carried in, until both parses begin a phrase at the same
place; from there they are one. So a text of any length is parsed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_computed

#: The bounded sample that is learned from, for each language: rows, and characters of those of them that are taken, each whole.
TRAIN_DOCS, TRAIN_CHARS = 64, 32_000
#: Symbols of a block, and of the texts that are parsed at once (a longer text is parsed alone).
BLOCK, GROUP = 512, 1_500_000
UNKNOWN = "und"
#: The symbol of what stands between letters, and the first of bytes.
GAP = 32
#: Places that are looked through at once for one where a state's transitions fit.
WINDOW = 256


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings. State 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def packed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse transitions in one array: that of a state by symbol c stands c beyond the state's place, as
    state << 32 | target. Also the places, and the target of each symbol from the start: where there
    is none, the last state, which has no transitions. States with several transitions are placed first
    where they fit, those with one then fill the gaps."""
    dead = len(moves)
    place = np.zeros(dead + 1, np.int64)
    used = np.zeros(2 * sum(map(len, moves)) + 8 * WINDOW + 8 * width, bool)
    used[:width] = True
    low = width
    several = sorted((s for s in range(dead) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    for s in several:
        symbols, at = np.fromiter(moves[s], np.int64, len(moves[s])), low
        while True:
            if at + 2 * WINDOW + width > len(used):
                used = np.append(used, np.zeros(len(used), bool))
            free = np.flatnonzero(~used[np.arange(at, at + WINDOW)[:, None] + symbols].any(axis=1))
            if len(free):
                break
            at += WINDOW
        place[s] = at + free[0]
        used[place[s] + symbols] = True
        if at > low + 4 * WINDOW:
            low = at - 4 * WINDOW
    gaps = iter(np.flatnonzero(~used).tolist())
    for s in range(dead):
        if len(moves[s]) == 1:
            place[s] = next(gaps, 0) - next(iter(moves[s]))
    place[dead] = 0
    table = np.full(int(place.max()) + width, -1, np.int64)
    for s, out in enumerate(moves):
        for c, to in out.items():
            table[place[s] + c] = s << 32 | to
    again = np.full(width, dead, np.int64)
    for c, to in moves[0].items():
        again[c] = to
    return table, place, again


class Model:
    """Parsers of all languages."""

    def __init__(self, samples: dict[str, str]):
        """Symbols are the bytes of learned texts, numbered; a byte that none of them has is the last symbol, which matches nowhere."""
        self.langs, self.classes, self.tables = sorted(samples), np.zeros(256, np.uint8), []
        self.letter = np.zeros(0x110000, np.uint8)  # 1: a letter, 2: none, 0: not seen yet
        texts = {lang: self.letters_of(samples[lang])[0] for lang in self.langs}
        known = sorted(set(b"".join(texts.values())))
        self.classes[:] = len(known)
        self.classes[known] = np.arange(len(known))
        for lang in self.langs:
            self.tables.append(packed(suffix_automaton(self.classes[np.frombuffer(texts[lang], np.uint8)].tolist()), len(known) + 1))

    @classmethod
    def of(cls, langs: list[str], classes: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        model = cls.__new__(cls)
        model.langs, model.classes, model.tables = langs, classes, tables
        model.letter = np.zeros(0x110000, np.uint8)
        return model

    def arrays(self) -> tuple:
        """What makes this model: plain data, so that tasks need nothing of this package to read it."""
        return self.langs, self.classes, self.tables

    def letters_of(self, text: str) -> tuple[bytes, int]:
        """The letters of a text in lower case as UTF-8, runs of anything else as one GAP, and the number of letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.letter[codes]
        for code in np.unique(codes[kind == 0]).tolist():
            self.letter[code] = 1 if chr(code).isalpha() else 2
        gap = self.letter[codes] == 2
        out = np.where(gap, np.uint32(GAP), codes)
        if len(out) > 1:
            keep = ~gap
            keep[1:] |= ~gap[:-1]
            keep[0] = True
            out = out[keep]
        return out.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), int(len(codes) - gap.sum())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases [language, text] of texts in symbols, none of them empty."""
        lengths = np.array([len(t) for t in texts])
        blocks = -(-lengths // BLOCK)
        firsts = np.cumsum(blocks) - blocks
        data, sizes = np.zeros((int(blocks.sum()), BLOCK), np.uint8), np.full(int(blocks.sum()), BLOCK)
        flat = data.ravel()
        for t, first in zip(texts, firsts.tolist()):
            flat[first * BLOCK : first * BLOCK + len(t)] = t
        sizes[firsts + blocks - 1] = lengths - (blocks - 1) * BLOCK
        order = np.argsort(-sizes, kind="stable")
        columns, sizes = np.ascontiguousarray(data[order].T), sizes[order]
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        follower = np.full(len(order), -1)  # of each block in this order: the next one of its text
        follows = np.setdiff1d(np.arange(len(order)), firsts)
        follower[where[follows - 1]] = where[follows]
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), side="right")
        counts = np.empty((len(self.langs), len(texts)), np.int64)
        for k, parser in enumerate(self.tables):
            dead = len(parser[1]) - 1
            begins = np.zeros((len(alive), len(sizes)), bool)  # [place, block]: a phrase begins there, in the block's own parse
            state = np.full(len(sizes), dead, np.int64)
            for at, n in enumerate(alive.tolist()):
                state[:n], begins[at, :n] = step(parser, state[:n], columns[at, :n])
            total, ends = begins.sum(axis=0, dtype=np.int64), state.copy()
            own = total.copy()
            carried = np.flatnonzero(follower >= 0)
            while len(carried):  # blocks whose end is new: their followers are parsed from it
                block = follower[carried]
                now, more = ends[carried], np.zeros(len(block), np.int64)
                reached = np.empty(len(block), np.int64)
                active = np.arange(len(block))
                for at in range(BLOCK):
                    now[active], new = step(parser, now[active], columns[at, block[active]])
                    mine = begins[at, block[active]]
                    more[active] += new.astype(np.int64) - mine
                    both, last = new & mine, sizes[block[active]] == at + 1
                    reached[active] = np.where(both, state[block[active]], now[active])
                    active = active[~(both | last)]
                    if not len(active):
                        break
                total[block] = own[block] + more
                changed = ends[block] != reached
                ends[block] = reached
                carried = block[changed & (follower[block] >= 0)]
            counts[k] = np.add.reduceat(total[where], firsts)
        return counts

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """For each text its language, score, and the winner's phrases for each symbol."""
        rates = np.full((len(self.langs), len(texts)), np.inf)
        group, owner, size = [], [], 0

        def parse() -> None:
            if group and self.langs:
                rates[:, owner] = self.phrases(group) / np.array([len(g) for g in group])

        for i, text in enumerate(texts):
            raw, letters = self.letters_of(text)
            if letters:
                if group and size + len(raw) > GROUP:
                    parse()
                    group, owner, size = [], [], 0
                group.append(self.classes[np.frombuffer(raw, np.uint8)])
                owner.append(i)
                size += len(raw)
        parse()
        out = []
        for i in range(len(texts)):
            if not self.langs or not np.isfinite(rates[0, i]):
                out.append((UNKNOWN, 0.0, 1.0))
                continue
            order = np.argsort(rates[:, i], kind="stable")
            best = rates[order[0], i]
            weights = np.exp(-12.0 * (rates[:, i] / best - 1))
            out.append((self.langs[order[0]], float(1 / weights.sum()), float(best)))
        return out


def step(parser: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a symbol, and whether a phrase begins with it."""
    table, place, again = parser
    entry = table.take(place.take(state) + symbols)
    new = (entry >> 32) != state
    return np.where(new, again.take(symbols), entry & 0xFFFFFFFF), new


def sample_languages(df: DataFrame, trained: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, str]:
    """A bounded sample of labelled texts for each language, each text whole: of the TRAIN_DOCS rows of least
    hash those that fit into TRAIN_CHARS characters together, or the shortest where none does.

    Rows without a label or without a letter teach nothing; repeated rows teach once. Only hashes and lengths are
    shuffled, of each task at most TRAIN_DOCS a language; the texts are then fetched by their hashes.
    """
    key = F.xxhash64(F.col(f"`{key_col}`").cast("string"), F.col(f"`{text_col}`"), F.lit("language"))
    rows = df.filter(trained).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), key.alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    some = rows.select("lang", "h", F.length("text").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= TRAIN_DOCS)
    chosen: dict[str, dict[int, int]] = {}
    shortest: dict[str, tuple[int, int]] = {}
    for row in sorted(some.collect(), key=lambda r: (r.lang, r.h)):
        taken = chosen.setdefault(row.lang, {})
        shortest[row.lang] = min(shortest.get(row.lang, (row.n, row.h)), (row.n, row.h))
        if row.h not in taken and sum(taken.values()) + row.n <= TRAIN_CHARS:
            taken[row.h] = row.n
    wanted = [(lang, h) for lang, taken in chosen.items() for h in taken or [shortest[lang][1]]]
    if not wanted:
        return {}
    names = df.sparkSession.createDataFrame(wanted, "lang string, h long")
    found = rows.join(F.broadcast(names), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: (r.lang, r.h)):
        texts.setdefault(row.lang, []).append(row.text)
    return {lang: " ".join(parts) for lang, parts in texts.items()}


def identify(df: DataFrame, samples: dict[str, str], text_col: str | Column = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1; 1: no other language comes near) and phrase_rate (phrases for each symbol).

    Text that is null, empty or without a letter: `und`, score 0, rate 1. Ties go to the
    name first in order. With no samples at all, every text is `und`. Columns of these names are
    replaced; every row is kept. Letters of any script count: symbols are bytes, and a byte that no learned text
    has ends a phrase, as it would in each automaton.
    """
    held = df.sparkSession.sparkContext.broadcast(Model(samples).arrays())

    def make():
        m = Model.of(*held.value)

        def kernel(texts):
            rows, group, size = [], [], 0
            for value in texts:
                group.append(value.as_py() or "")
                size += len(group[-1])
                if size > GROUP:
                    rows += m.predict(group)
                    group, size = [], 0
            rows += m.predict(group) if group else []
            langs, scores, rates = zip(*rows)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]

        return kernel

    return with_computed(df, [text_col], "lang_pred string, score double, phrase_rate double", make)
