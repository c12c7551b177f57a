"""URL filter by a bit-parallel wildcard automaton.

Glob rules over ``host + path`` are packed, one after another, into Shift-And masks of as many 64-bit words as
they need: a bit per literal, advanced by one shift and one mask per URL byte for all patterns together, and a
loop mask per byte for the wildcards (``*``: any run without ``/``, ``**``: any run, ``?``: one byte but ``/``).
A batch of URLs advances in step, byte by byte.

A null url, or one without ``://``, has an empty host and path.  Rows are judged alone: equal urls get equal
verdicts, empty tables give empty results, other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, utf8_lists


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule that fits wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


@dataclass(frozen=True)
class GlobRule:
    """The method's own verdict for urls that no host rule fits; the first that matches wins."""

    verdict: str
    glob: str


class Automaton:
    def __init__(self, globs: list[str]):
        steps: list[tuple[list[int | None], dict[int, str]]] = []
        for g in globs:  # a pattern: its literals (None: any but /), and the wildcard that may loop before each
            literals, loops, raw, i = [], {}, g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[len(literals)], i = "**", i + 2
                elif raw[i : i + 1] == b"*":
                    loops.setdefault(len(literals), "*")
                    i += 1
                else:
                    literals.append(None if raw[i : i + 1] == b"?" else raw[i])
                    i += 1
            steps.append((literals, loops))
        bits = sum(len(s[0]) + 1 for s in steps)
        self.words = max(1, -(-bits // 64))
        self.move = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        at = 0
        for literals, loops in steps:
            self.start[at // 64] |= self.bit(at)
            for state in range(len(literals) + 1):
                where, bit = (at + state) // 64, self.bit(at + state)
                if state:
                    c = literals[state - 1]
                    self.move[[x for x in range(256) if x != 47] if c is None else [c], where] |= bit
                if state in loops:
                    self.loop[[x for x in range(256) if x != 47 or loops[state] == "**"], where] |= bit
            self.accept.append(((at + len(literals)) // 64, self.bit(at + len(literals))))
            at += len(literals) + 1

    @staticmethod
    def bit(i: int) -> np.uint64:
        return np.uint64(1 << i % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A boolean per url and glob."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        d = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(urls)
        for p in range(int(lengths[0]) if len(urls) else 0):
            while lengths[live - 1] <= p:
                live = int(np.searchsorted(-lengths, -p, "left"))
            c = data[begins[:live] + p]
            now = d[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:live] = moved & self.move[c] | now & self.loop[c]
        out = np.zeros((len(urls), len(self.accept)), bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = d[:, word] & bit != 0
        return out


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    _, sep, rest = (url or b"").partition(b"://")
    if not sep:
        return b"", b""
    cut = min((i for i in map(rest.find, (b"/", b"?", b"#")) if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, (b"?", b"#")) if i >= 0), default=len(tail))
    return rest[:cut].lower(), tail[:end]  # bytes.lower changes A-Z alone


def judge_urls(df: DataFrame, rules: list[HostRule], globs: list[GlobRule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
        automaton = Automaton([g for r in ranked for g in r.globs()] + [g.glob for g in globs])
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                parts = [split_url(u) for u in utf8_lists(part, url)]
                hits = automaton.match([h + p for h, p in parts])
                names, verdicts = [], []
                for row in hits:
                    rule = next((r for i, r in enumerate(ranked) if row[2 * i] or row[2 * i + 1]), None)
                    own = next((g.verdict for i, g in enumerate(globs) if row[2 * len(ranked) + i]), default)
                    names.append(rule and rule.name)
                    verdicts.append(rule.verdict if rule else own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index(key)),
                        pa.array([h.decode() for h, _ in parts], pa.string()),
                        pa.array([p.decode() for _, p in parts], pa.string()),
                        pa.array(names, pa.string()),
                        pa.array(verdicts, pa.string()),
                    ],
                    names=[key, "host", "path", "rule", "verdict"],
                )

    return df.select(key, url).mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")
