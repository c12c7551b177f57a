"""Ids of whole texts by a ``tokenizers`` file, by way of their distinct words.

A batch's texts are split at ASCII white space and dictionary-encoded; each distinct word is parted into marks and
a core of letters in lower case; only cores that a bounded memo lacks are encoded, many at a time, and cut apart at
the tokens that end a word.  The texts' ids are then gathered from those of their words.

This is exact for tokenizers whose pre-tokenizer never joins text across white space, drops it, and parts letters
from ASCII marks.  A probe checks it on construction; if it fails, whole texts are encoded.  Letters that the
normalizer turns into a letter and a sign (a dotted capital I, letters with points) would join the marks behind
them: words with such a letter at the end of their core aren't parted.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

PROBE = "It's a  Test:\tx1 é́.\n\nnaïve 'll don't\r\n12 |endoftext| Ünder\x0bscore _ok_ Σίγμας ΣΑΣ (\"end\") x!!, "
#: Bare ASCII symbols: the pre-tokenizer parts them from letters.  The apostrophe isn't among them ('s, 'll).
MARKS = '.,!?*#$%&|;:"()'


def spread(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[begins[w] : begins[w] + lengths[w]]`` of all ``w`` in ``which``, joined; and their ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    index = np.repeat(begins[which] - (ends - n), n) + np.arange(ends[-1] if n.size else 0)
    return flat[index], ends


def plain(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def unstable_letters(tokenizer) -> list[str] | None:
    """Letters that don't stay letters when ``tokenizer`` normalizes them; None where it joins or splits words."""
    if tokenizer.normalizer is None:
        return []
    letters = [c for c in map(chr, range(1 << 18)) if c.isalpha()]  # Unicode has letters in its first four planes alone
    found = tokenizer.normalizer.normalize_str(" ".join(letters)).split(" ")
    return [c for c, x in zip(letters, found) if not x.isalpha()] if len(found) == len(letters) else None


class WordIds:
    """``ids_many(texts)``: the ids of each text of an Arrow string array, as unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.size = t.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
        self.limit, self.young, self.old = limit, {}, {}
        self.specials = [x.content for x in t.get_added_tokens_decoder().values() if x.content]
        unstable = unstable_letters(t)
        self.unstable = pa.array(unstable or [], pa.string())
        self.by_word = True
        probe = pa.array([PROBE])
        self.by_word = unstable is not None and self.ids_many(probe)[0].tolist() == t.encode(PROBE, add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> "WordIds":
        return kept(("words", path), lambda: cls(path))

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str], joined: bool) -> None:
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            if joined:
                ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):  # each is one run of letters, as expected
                    raw, begins = ids.tobytes(), [0, *(4 * cuts).tolist()]
                    self.young.update(zip(part, [raw[a:b] for a, b in zip(begins, begins[1:])]))
                    continue
            self.young.update(zip(part, self._each(part)))

    def _known(self, words: list[str], letters: list[bool]) -> list[bytes]:
        if len(self.young) + len(words) > self.limit:  # a generation ages, the one before it is dropped
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = set(words).difference(young)
        again = {w: old[w] for w in new if w in old}
        young.update(again)
        new.difference_update(again)
        self._learn([w for w, joined in zip(words, letters) if joined and w in new], True)
        self._learn([w for w, joined in zip(words, letters) if not joined and w in new], False)
        return [*map(young.__getitem__, words)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, joined, with begins and lengths."""
        left = pc.ascii_ltrim(words, characters=MARKS)
        core = pc.ascii_rtrim(left, characters=MARKS)
        letters = pc.and_not(pc.utf8_is_alpha(core), pc.is_in(pc.utf8_slice_codeunits(core, -1), value_set=self.unstable))
        body = pc.if_else(letters, pc.ascii_lower(core), words).dictionary_encode()
        cores = body.dictionary
        units = self._known(plain(cores), plain(pc.utf8_is_alpha(cores)))
        size, cut, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, left, core))
        kept = np.where(letters.to_numpy(zero_copy_only=False), kept, size)
        before = np.where(kept < size, size - cut, 0)
        offsets, text = (np.frombuffer(x, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8)))
        offsets = offsets[words.offset : words.offset + len(words)].astype(np.int64)
        # the marks before all words, then those behind
        begins, lengths = np.concatenate([offsets, offsets + before + kept]), np.concatenate([before, size - before - kept])
        data, ends = spread(text, begins, lengths, np.arange(len(begins)))
        ends = np.concatenate([[0], ends]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        units += self._known(plain(marks.dictionary), [False] * len(marks.dictionary))
        side = marks.indices.to_numpy().astype(np.int64) + len(cores)
        parts = np.stack([side[: len(words)], body.indices.to_numpy(), side[len(words) :]], axis=1)
        flat = np.frombuffer(b"".join(units), "<u4")
        n = np.fromiter(map(len, units), np.int64, len(units)) // 4
        ids, ends = spread(flat, np.cumsum(n) - n, n, parts.ravel())
        ends = ends[2::3]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return ids, begins, ends - begins

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded as they are."""
        whole = np.full(len(texts), not self.by_word)
        for s in self.specials:  # their strings are found before words are split
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return whole

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids by way of their words, one text after another, and each text's end."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, begins, lengths = self._distinct(words.dictionary)
        ids, ends = spread(ids, begins, lengths, words.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text after another, and each text's end."""
        texts = texts.fill_null("")
        if not self._whole(texts).any():
            return self._joined(texts)
        each = self.ids_many(texts)
        return np.concatenate(each), np.cumsum([x.size for x in each])

    def ids_many(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        whole = self._whole(texts)
        out: list = [None] * len(texts)
        if not whole.all():
            ids, cuts = self._joined(texts)
            out = np.split(ids, cuts[:-1]) if len(cuts) else []
        for i in np.flatnonzero(whole):
            out[i] = np.frombuffer(self._each([texts[i].as_py()])[0], "<u4")
        return out
