"""Byte-level BPE by prefix dynamic programming.

For a merge list, every byte string has one encoding, and a token sequence is that encoding exactly when each
neighbouring pair of tokens encodes to itself.  So each prefix of a piece has one valid last token: the token
``t`` that ends there and whose left neighbour, the last token of the prefix before ``t``, stays apart from it.
``PrefixTable`` stores just that token per prefix: appending bytes extends the table, dropping a tail truncates
it, and the encoding is read by walking back from the end.  ``TextEncoder`` keeps the pieces of a whole text
and re-splits only near an edit.

Null texts encode as empty ones.  Rows are handled alone, so repeated rows, ties and empty tables need no rule.  Only
the key and the text are read, so other columns may have any name.  A text is encoded by one task, however long; its
table of prefixes takes a few bytes per byte of the longest piece alone.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import Memo, kept, map_rows


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with the two facts the dynamic programme needs: which tokens stand alone, which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 500_000):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.sizes = {r: len(b) for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()  # bytes stand for the first 256 characters
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()
        self.apart = Memo(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair], memo)
        self.alone = Memo(lambda token: self.merge(self.bytes_of[token]) == [token], len(ranks) + 1)

    def merge(self, data: bytes) -> list[int]:
        """The defining procedure: join the leftmost lowest-ranked neighbours until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]


    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Complete ``last``, the valid last token of each prefix of ``data``, from prefix ``start + 1`` on.

        ``last[0]`` is the empty prefix's -1.  The automaton names all tokens that end at each byte; of these just
        one stays apart from the last token of the prefix before it.
        """
        apart, alone = self.apart, self.alone
        base = max(0, start - self.longest + 1)
        last.extend([-1] * (len(data) + 1 - len(last)))
        for at, (t, size) in self.automaton.iter(data[base:].decode("latin-1")):
            end = base + at + 1
            if end > start and last[end] < 0:
                before = last[end - size]
                if (end == size or before >= 0 and apart[before, t]) and alone[t]:
                    last[end] = t

    def read_back(self, last: list[int], at: int) -> list[int]:
        out, sizes = [], self.sizes
        while at:
            t = last[at]
            out.append(t)
            at -= sizes[t]
        out.reverse()
        return out

    def tokens(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)  # a piece that is a token stays whole
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, 0)
        return self.read_back(last, len(data))


class PrefixTable:
    """The unique last token of every prefix of one piece, kept for edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> "PrefixTable":
        start = len(self.data)
        self.data += more
        self.v.extend(self.data, self.last, start)
        return self

    def truncate(self, length: int) -> "PrefixTable":
        self.data = self.data[:length]
        del self.last[length + 1 :]
        return self

    def tokens(self) -> list[int]:
        whole = self.v.ranks.get(self.data)
        return [whole] if whole is not None else self.v.read_back(self.last, len(self.data))


class TextEncoder:
    """A text under edits: pieces with their prefix tables; an edit re-splits from some pieces before it until the
    old cuts recur.

    How far before: the pattern looks at no more than the two characters behind an apostrophe, or the one character
    behind the white space that it doesn't take whole.  So a piece from ``p`` to ``e`` hangs on characters before
    ``max(p + 3, e + 2)`` alone.  Of the pieces that start at or before an edit, the last holds or touches it, and the
    two before that may end where the edit begins or one character earlier; the fourth from the end ends two before
    it, starts three before it, and stays.  Matching never looks back, so once a cut behind the edit recurs, all do.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        self.text = text
        self.pieces = [(m.start(), PrefixTable(vocabulary, m.group().encode())) for m in self.pattern.finditer(text)]

    def append(self, more: str) -> "TextEncoder":
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> "TextEncoder":
        """Replace ``text[start:end]``; tables of untouched pieces are kept, a grown last piece is extended."""
        shift = len(new) - (end - start)
        text = self.text = self.text[:start] + new + self.text[end:]
        first = max(0, sum(1 for at, _ in self.pieces if at <= start) - 3)
        kept, old = self.pieces[:first], self.pieces[first:]
        resume = {at + shift: i for i, (at, _) in enumerate(old) if at >= end + 1}
        at, fresh = (old[0][0] if old else 0), []
        reuse = {p: table for p, table in old if p < start}
        while at < len(text):
            if at > start + len(new) and at in resume:
                fresh += [(p + shift, t) for p, t in old[resume[at] :]]
                break
            m = self.pattern.match(text, at)
            data, known = m.group().encode(), reuse.get(at)
            if known is not None and data.startswith(known.data):
                table = known.append(data[len(known.data) :])
            elif known is not None and known.data.startswith(data):
                table = known.truncate(len(data))
            else:
                table = PrefixTable(self.v, data)
            fresh.append((at, table))
            at = m.end()
        self.pieces = kept + fresh
        return self

    def tokens(self) -> list[int]:
        return [t for _, table in self.pieces for t in table.tokens()]


class Coder:
    """Whole texts to ids and back, with a bounded memo of pieces."""

    def __init__(self, path: str, pattern: str, memo: int = 300_000):
        self.v = v = Vocabulary(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.memo = Memo(lambda piece: v.tokens(piece.encode()), memo)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Coder":
        return kept(("bytes", path, pattern), lambda: cls(path, pattern))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ids array<int> and the decoded bytes of each text; no shuffle."""

    def make():
        coder = Coder.of(ranks_path, pattern)

        def one(k, raw):
            ids = coder.encode((raw or b"").decode())
            yield k, ids, coder.decode(ids)

        return one

    return map_rows(df, [key, text], f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>, decoded binary", make)


def digest_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same ids and bytes, reduced in place to counts and digests, so that ids need not leave the worker."""

    def make():
        coder = Coder.of(ranks_path, pattern)
        names: dict[int, str] = {i: str(i) for i in coder.v.bytes_of}
        name = names.__getitem__

        def one(k, raw):
            ids = coder.encode((raw or b"").decode())
            yield (
                k,
                len(ids),
                hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest(),
                hashlib.sha256(coder.decode(ids)).hexdigest(),
            )

        return one

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
