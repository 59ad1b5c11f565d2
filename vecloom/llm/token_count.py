"""Token counts by a compiled finite-state transducer for a piece vocabulary with scores."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_computed, worker_store

SPACE = "▁"
#: Entries of a worker's tables; beyond them they are emptied and built anew.
MAX_STATES, MAX_WORDS = 600_000, 1_000_000
#: Longest prefix of a word that is kept as a state.
MAX_PREFIX = 24
LIMIT = 4096


def read_pieces(path: str) -> dict[str, float]:
    """The pieces that merges can make, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space after another character: the transducer can't reset between words")
    return pieces


def merge(text: str, pieces: dict[str, float]) -> list[str]:
    """The pieces of text: again and again the adjacent pair of the best score, the leftmost of equals, becomes one."""
    parts, n = list(text), len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-pieces[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (s := pieces.get(a + b + parts[k])) is not None:
                heapq.heappush(heap, (-s, i, a + b, parts[k]))
        if (h := before[i]) >= 0 and (s := pieces.get(parts[h] + a + b)) is not None:
            heapq.heappush(heap, (-s, h, parts[h], a + b))
    return [p for p in parts if p]


class Transducer:
    """Deterministic, compiled as it is used; transitions carry emitted-token counts.

    A state is what has been read of a word; with it goes, for each position, the
    piece that ends the tokens of the text up to there. A transition's count is the
    growth of the number of tokens; it may be negative, where a character makes earlier
    pieces merge. Which piece ends the tokens after a character is settled by pairs:
    tokens are right if and only if each adjacent pair merges to just itself. No state
    is kept for what is longer than MAX_PREFIX; there only the last positions matter,
    as many as the longest piece has characters.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Lengths of pieces, longest first, by their last two characters.
        self.sizes: dict[str, tuple[int, ...]] = {}
        for p in pieces:
            if len(p) > 1:
                self.sizes[p[-2:]] = tuple(sorted({len(p), *self.sizes.get(p[-2:], ())}, reverse=True))
        #: By what has been read, its last character included: the piece that ends the tokens, and the count of the transition to here.
        self.moves: dict[str, tuple[str, int]] = {}

    def follows(self, a: str, b: str) -> bool:
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[a, b] = right = merge(a + b, self.pieces) == ([a, b] if a else [b])
        return right

    def count(self, word: str) -> int:
        """Tokens of a word from the start state. A word has at most one space mark, at its start."""
        moves, pairs, pieces = self.moves, self.pairs, self.pieces
        if len(moves) > MAX_STATES:
            moves.clear()
        ends, counts = [""], [0]  # by position
        for i, ch in enumerate(word, 1):
            state = word[:i] if i <= MAX_PREFIX else None
            if (move := moves.get(state)) is None:
                for size in self.sizes.get(word[i - 2 : i], ()) if i > 1 else ():
                    if size <= i and (piece := word[i - size : i]) in pieces:
                        last = ends[i - size]
                        if (right := pairs.get((last, piece))) is None:
                            right = self.follows(last, piece)
                        if right:
                            break
                else:
                    piece, size = ch, 1
                emitted = 1 if piece in pieces else len(ch.encode())
                move = piece, counts[i - size] + emitted - counts[-1]
                if state:
                    moves[state] = move
            ends.append(move[0])
            counts.append(counts[-1] + move[1])
        return counts[-1]


class Chunks(dict):
    """Counts of chunks between spaces, each from the start state; a newline at a chunk's start means that no space mark precedes it."""

    def __init__(self, pieces: dict[str, float]):
        self.transducer = Transducer(pieces)
        #: Characters that no piece holds right before a comma or full stop: between these, too, the transducer is in its start state.
        self.joined = {p[i] for p in pieces for i in range(len(p) - 1) if p[i + 1] in ".,"}

    def segment(self, text: str) -> int:
        """Tokens of space marks followed by other characters."""
        if text.startswith(SPACE * 2):
            return sum(1 if p in self.transducer.pieces else len(p.encode()) for p in merge(text, self.transducer.pieces))
        return self.transducer.count(text)

    def __missing__(self, chunk: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        core = chunk.rstrip(".,")
        if core and core != chunk and core[-1] not in self.joined:
            n = self[core] + self.transducer.count(chunk[len(core) :])
        else:
            n = self.segment(chunk if chunk[0] == "\n" else SPACE + chunk)
        if len(chunk) < 256:
            self[chunk] = n
        return n


SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def chunk_counts(text: str, chunks: Chunks) -> list[int]:
    """Token counts of a text's chunks. Pieces hold space marks at their start only,
    so at a space after another character the transducer is in its start state
    whatever came before: a chunk's map of states is constant, and maps compose by adding counts."""
    if not text:
        return []
    if "  " in text or " \n" in text or SPACE in text or text[0] in " \n" or text[-1] == " ":
        return [chunks.segment(s) for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
    return [chunks[c] for c in text.replace("\n", " \n").split(" ") if c]


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text.

    Counts are those of the vocabulary's own library without begin or end tokens. A
    null text counts as empty: 0 bytes, 0 tokens. Columns of these names are
    replaced; every row is kept, repeated rows too.
    """
    held = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def make():
        store = worker_store("token_count")
        if model_path not in store:
            store[model_path] = Chunks(held.value)
        chunks = store[model_path]

        def kernel(texts):
            counts, ends, sizes = [], [], []
            for value in texts:
                text = value.as_py() or ""
                counts += chunk_counts(text, chunks)
                ends.append(len(counts))
                sizes.append(len(text.encode()))
            scan = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))  # the prefix scan of the composed maps
            tokens = np.diff(scan[ends], prepend=0)
            return [pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

        return kernel

    return with_computed(df, [text_col], "n_bytes long, n_tokens long, over_limit boolean", make, "token_count")
