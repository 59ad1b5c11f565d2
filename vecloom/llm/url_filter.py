"""URL filters by a bit-parallel wildcard automaton (Shift-And over multiword masks)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, with_computed

#: What a url gets that no rule fits.
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that start with path.

    Both may hold `*`: in the host it stands for any run without `/`, in the path for any run.
    """

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


class Automaton:
    """All rules' patterns packed one after another into 64-bit words.

    A pattern is a start state, then one state for each literal byte. A star after a
    state is a loop on that state. A step for byte c over all patterns at once:
    D = ((D << 1) & into[c]) | (D & loop[c]). Canonical urls are `.host/path`, so the
    leading start state, which loops on all bytes but `/`, makes a rule fit subdomains.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        into: list[set[int]] = []
        loops: list[set[int]] = []
        self.start, self.final = [], []
        not_slash, anything = set(range(256)) - {47}, set(range(256))
        for rule in rules:
            self.start.append(len(into))
            into.append(set())
            loops.append(set(not_slash))
            in_host = True
            for ch in f".{rule.host}{rule.path}".encode():
                if ch == 42:
                    loops[-1] |= not_slash if in_host else anything
                else:
                    in_host = in_host and ch != 47
                    into.append({ch})
                    loops.append(set())
            loops[-1] |= anything  # the path needs only to start so
            self.final.append(len(into) - 1)
        self.words = max(1, -(-len(into) // 64))
        self.into = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for masks, sets in ((self.into, into), (self.loop, loops)):
            for bit, chars in enumerate(sets):
                for c in chars:
                    masks[c, bit // 64] |= np.uint64(1 << (bit % 64))
        self.begin = np.zeros(self.words, np.uint64)
        for bit in self.start:
            self.begin[bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, urls: list[bytes]) -> np.ndarray:
        """For each url the patterns that fit, as booleans [url, rule]. Urls go in
        lockstep, longest first, so that those that have ended drop off the end."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.begin[None, :], len(urls), axis=0)
        flat = np.frombuffer(b"".join(urls), np.uint8)
        ends = np.cumsum(lengths)
        first, sizes = (ends - lengths)[order], lengths[order]
        ascending = sizes[::-1]
        for at in range(int(sizes[0]) if len(urls) else 0):
            alive = len(urls) - int(np.searchsorted(ascending, at, side="right"))
            d, c = state[:alive], flat[first[:alive] + at]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.into[c]) | (d & self.loop[c])
        fits = np.empty((len(urls), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            fits[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return fits


def judge_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """df with host, path, rule and verdict of each url.

    The longest rule that fits gives rule and verdict; of equally long ones block
    wins, then the one first in order of text. No rule: rule is null and verdict the
    default. A null url or one without `://` has empty host and path, and fits none.
    Columns of df of these names are replaced; rows are never dropped or merged.
    """
    ranked = tuple(sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text)))
    host = ascii_lower(F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url_col, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    split = df.withColumn("__host", F.coalesce(host, F.lit(""))).withColumn("__path", F.coalesce(path, F.lit("")))
    names = pa.array([r.text for r in ranked] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in ranked] + [default], pa.string())

    def make():
        automaton = Automaton(ranked)

        def kernel(hosts, paths):
            urls = [f".{h}{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            fits = np.ones((len(urls), len(ranked) + 1), bool)
            if ranked:
                fits[:, :-1] = automaton.run(urls)
            best = pa.array(fits.argmax(axis=1))
            return [hosts, paths, names.take(best), verdicts.take(best)]

        return kernel

    return with_computed(split, ["__host", "__path"], "host string, path string, rule string, verdict string", make).drop("__host", "__path")
