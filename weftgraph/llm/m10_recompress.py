"""Substring de-duplication by recompression.

A document's words are symbols.  A round first names every maximal run of one symbol, then every pair of a
neighbouring "left" and "right" symbol; sides and names follow from the symbols' own hashes, so equal word
sequences get the same symbols everywhere, apart from a few at their ends.  Each symbol's occurrence carries its
context: the stretch of words that settles that it arises.  A window of words that holds a symbol's context holds
that symbol in every document.

Names are digests of what they name, so all tasks agree on them without exchanging tables of names; what Spark
rounds settle is which symbols several documents share.  The first elects, for each window, one of the symbols that
it settles (the longest, in bytes), and groups elected symbols: a window can only repeat if its elected symbol does,
which leaves few candidates; shared symbols are told by a bitmap, or, where they are too many for one, by joins.  The
second verifies: candidate windows are grouped by 128 bits of their words, in two
lanes that share no intermediate value, and all but those of the smallest document are removed.  Naming stops after
``ROUNDS`` rounds, since contexts widen by each: in windows of 13 words, symbols of a third round fit a third of all
windows, those of a fourth next to none.

Whole copies of a text are found first, by its digest; only the copy of the smallest id goes through the rounds.
Tasks combine what they see before shuffling: a window that a task has met in a smaller document is settled there,
so frequent passages leave a task about once, and settled windows leave as runs.

Ids are integers.  Null and empty texts have no words.  Rows without an id neither remove nor lose words.  Rows of
equal id count as one document, so repeated rows don't remove each other.  Texts shorter than a window keep all words.
An empty table gives an empty result.  Columns of any name and type beside the id and the text are left as they are.
A text is held by one task, which takes some 100 bytes per word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, discard, fresh, map_arrays, map_rows, members_of, numbered, perhaps_inside, rewrite_rows, ship, spread_id, staged, where_number, whole_ids
from .m08_minhash import MIX, mixed

WINDOW, ROUNDS = 13, 2
WHOLE = -1  # as a run of windows: all words, if they make a window
FILL = 8  # bits per repeated symbol, below which a bitmap would let too many others pass
FAR = 1 << 40  # a context that reaches beyond a document's end fits no window
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Symbols:
    """Symbols of several documents side by side: names, extents and contexts in words, document numbers."""

    def __init__(self, names: np.ndarray, document: np.ndarray):
        at = np.arange(len(names))
        self.name, self.document = names, document
        self.begin, self.end, self.from_, self.to = at, at + 1, at, at + 1

    def _pick(self, name, first, last, from_, to):
        self.name, self.begin, self.end, self.from_, self.to, self.document = name, self.begin[first], self.end[last], from_, to, self.document[first]

    def runs(self) -> None:
        """Name maximal runs.  Whether a run ends depends on its neighbours: they are part of its context."""
        n, name, doc = len(self.name), self.name, self.document
        inside = doc[1:] == doc[:-1]
        starts = np.ones(n, bool)
        starts[1:] = ~((name[1:] == name[:-1]) & inside)
        first = np.flatnonzero(starts)
        last = np.append(first[1:], n) - 1
        long = last > first
        new = name[first]
        new[long] = mixed(new[long] * MIX[1] + (last - first + 1)[long].astype(np.uint64) * MIX[2])
        before = np.append(False, inside)[first]
        after = np.append(inside, False)[last]
        from_ = np.where(before, self.from_[first - 1], -FAR)
        to = np.where(after, self.to[np.minimum(last + 1, n - 1)], FAR)
        self._pick(new, first, last, np.minimum(from_, self.from_[first]), np.maximum(to, self.to[last]))

    def pairs(self, turn: int) -> None:
        """Name pairs of a left and a right symbol.  A symbol that stays single depends on the neighbour on the side
        to which it could have joined."""
        n, name, doc = len(self.name), self.name, self.document
        right = mixed(name + np.full(1, turn, np.uint64) * MIX[0]) >> np.uint64(63) == 1
        after = np.append(doc[1:] == doc[:-1], False)
        before = np.append(False, after[:-1])
        joins = after & ~right & np.append(right[1:], False)
        first = np.flatnonzero(~np.append(False, joins[:-1]))
        joined = joins[first]
        last = first + joined
        new = name[first]
        new[joined] = mixed(new[joined] * MIX[1] + mixed(name[last[joined]] + MIX[2]))
        other = np.where(right[first], np.maximum(first - 1, 0), np.minimum(first + 1, n - 1))
        known = np.where(right[first], before[first], after[first])
        edge = np.where(right[first], -FAR, FAR)
        from_ = np.minimum(self.from_[first], np.where(known, self.from_[other], edge))
        to = np.maximum(self.to[first], np.where(known, self.to[other], edge))
        self._pick(new, first, last, from_, to)


def elected(names: np.ndarray, document: np.ndarray, sizes: np.ndarray, window: int, rounds: int) -> np.ndarray:
    """For each word, the key of the symbol that the window starting there elects; ``NONE`` where it settles none.

    ``sizes``: the words' bytes.  Long symbols are rare, so that few windows elect one that repeats by chance.
    """
    best = np.full(len(names), NONE)
    if not len(names):
        return best
    s = Symbols(names, document)
    for turn in range(1, rounds + 1):
        s.runs()
        s.pairs(turn)
    span = s.to - s.from_
    fit = np.flatnonzero((span <= window) & (s.from_ >= 0))
    bytes_before = np.concatenate([[0], np.cumsum(sizes)])
    long = np.minimum((bytes_before[s.end] - bytes_before[s.begin])[fit], 63).astype(np.uint64)
    key = (np.uint64(63) - long) << np.uint64(57) | s.name[fit] >> np.uint64(7)  # of equal length the smaller name
    first, spare = s.to[fit] - window, (window - span)[fit]
    for j in range(window):
        long_enough = spare >= j
        if not long_enough.any():
            break
        use = np.flatnonzero(long_enough & (first + j >= 0))
        np.minimum.at(best, first[use] + j, key[use])
    return best


def window_hashes(lanes: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start ``at``, each from its own hashes of the words."""
    out = []
    for names, factor in zip(lanes, MIX[1:]):
        h = np.zeros(len(at), np.uint64)
        for j in range(window):
            h = mixed(h + names[at + j]) * factor + np.uint64(j)
        out.append(mixed(h).view(np.int64))
    return out[0], out[1]


class Reader:
    """Batches of texts as two lanes of word hashes, document numbers, word sizes, places in the document, and whether a
    window can start there.  Words are split and made distinct in Arrow; only distinct ones are hashed, to 128 bits."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        found = split.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary())
        distinct = words.to_numpy(zero_copy_only=False).tolist()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        which = found.indices.to_numpy()
        document = np.repeat(np.arange(len(n)), n)
        real = np.flatnonzero(size[which] > 0) if (size == 0).any() else None
        if real is not None:  # white space at a text's ends yields empty words
            which, document = which[real], document[real]
            n = np.bincount(document, minlength=len(n))
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return (hashes[which, 0], hashes[which, 1]), document, size[which], place, place + self.window <= n[document]


def other_rows(copied, ids: pa.Array, texts: pa.Array, numbers: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Without the rows that are surely copies.  Copies that stay only cost their work: they lose all words anyway."""
    mask = pa.array(~copied.surely(numbers.to_numpy()))
    return ids.filter(mask), texts.filter(mask)


def repeated_symbols(df: DataFrame, copied, window: int, rounds: int) -> DataFrame:
    """(key) of elected symbols that occur in several documents."""

    def make():
        read = Reader(window)

        def some(ids, texts, numbers):
            ids, texts = other_rows(copied.value, ids, texts, numbers)
            lanes, document, sizes, _, starts = read(texts)
            best = elected(lanes[0], document, sizes, window, rounds)
            use = starts & (best != NONE)
            use[1:] &= ~((best[1:] == best[:-1]) & (document[1:] == document[:-1]) & starts[:-1])  # neighbours elect alike
            key, doc = best[use].view(np.int64), ids.to_numpy()[document[use]]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key))[: len(first)] - 1
            yield key[first], doc[first], doc[last]

        return some

    seen = map_arrays(df, ["doc_id", "text", "n"], "key long, least long, most long", make)
    return seen.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("key")


def listed_windows(df: DataFrame, copied, symbols: DataFrame, window: int, rounds: int) -> DataFrame:
    """``df`` with a column ``runs``: the runs of each document's windows whose elected symbol is in ``symbols``.

    The same choice as by a bitmap, by joins on the symbols and on the documents: for more symbols than a bitmap can
    tell apart.  A row per stretch of windows that elect alike is shuffled, then each text once.
    """

    def make():
        read = Reader(window)

        def some(ids, texts, numbers):
            ids, texts = other_rows(copied.value, ids, texts, numbers)
            lanes, document, sizes, place, starts = read(texts)
            best = elected(lanes[0], document, sizes, window, rounds)
            at = np.flatnonzero(starts & (best != NONE))
            key, doc, start = best[at].view(np.int64), ids.to_numpy()[document[at]], place[at]
            new = np.append(True, (key[1:] != key[:-1]) | (document[at][1:] != document[at][:-1]) | (start[1:] != start[:-1] + 1)) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(at)))
            yield key[first], doc[first], start[first] | many << 32

        return some

    stretches = map_arrays(df, ["doc_id", "text", "n"], "key long, doc long, run long", make)
    chosen = stretches.join(symbols.select("key").hint("merge"), "key").groupBy("doc").agg(F.collect_list("run").alias("runs"))  # a document's own
    return df.join(chosen, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "n", "runs")


class Met:
    """Windows that a task has met in several documents, with the smallest of these; bounded."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.a, self.b, self.doc = limit, *(np.zeros(0, np.int64) for _ in range(3))

    def smaller(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which windows (a, b) were met in a document before ``doc``."""
        if not len(self.a):
            return np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return (self.a[at] == a) & (self.b[at] == b) & (self.doc[at] < doc)

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> None:
        if len(self.a) + len(a) > self.limit:  # those met most lately return at once
            self.a, self.b, self.doc = self.a[:0], self.b[:0], self.doc[:0]
        a, b, doc = np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)  # of windows that agree in a alone, one
        self.a, self.b, self.doc = a[new][: self.limit], b[new][: self.limit], doc[new][: self.limit]


def runs_of(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows: their documents, and first start and number in one long."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first] | (start[last] - start[first] + 1) << 32


def listed_words(runs: pa.Array, words: np.ndarray) -> np.ndarray:
    """Which words, of documents with so many each, start a window of their document's ``runs`` (null: none)."""
    size = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    flat = runs.flatten().to_numpy(zero_copy_only=False)
    base, most = np.repeat(np.cumsum(words) - words, size), np.repeat(words, size)
    start = np.minimum(flat & 0xFFFFFFFF, most)  # rows of equal id share their runs, whatever their lengths
    inside = np.zeros(int(words.sum()) + 1, np.int64)
    np.add.at(inside, base + start, 1)
    np.add.at(inside, base + np.minimum(start + (flat >> 32), most), -1)
    return np.cumsum(inside)[:-1] > 0


def copies(df: DataFrame, rows: int) -> DataFrame:
    """Ids of documents whose whole text a document with a smaller id has."""
    known = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    least = known.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # written before it is joined, so that the join can be split at the digest of a large group
    least = staged(least.select("digest", "least"), "repeat-digests", rows=rows)
    return known.join(least, "digest").where("doc_id > least").select("doc_id").distinct()


def repeats(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, run) of the windows that a document with a smaller id holds too, as ``runs_of`` has them; ``WHOLE`` for
    copies of a text."""
    spark = df.sparkSession
    ship(spark)
    df = whole_ids(df.select("doc_id", "text"), "doc_id").where("doc_id IS NOT NULL")
    n = df.count()
    whole = staged(copies(df, n), "repeat-copies", rows=n)
    copied = members_of(whole, df)
    df = df.withColumn("n", spread_id("doc_id"))
    symbols = staged(repeated_symbols(df, copied, window, rounds), "repeat-symbols", rows=n)
    columns = ["doc_id", "text", "n"]
    by_bitmap = symbols.count() * FILL <= most_bits
    if by_bitmap:
        bits = spark.sparkContext.broadcast(bits_of(symbols, "key", most=most_bits))
        discard(symbols)
    else:
        df = listed_windows(df, copied, symbols, window, rounds)
        columns.append("runs")

    def make():
        read, met = Reader(window), Met()

        def some(ids, texts, numbers, listed=None):
            if listed is not None:
                listed = listed.filter(pa.array(~copied.value.surely(numbers.to_numpy())))
            ids, texts = other_rows(copied.value, ids, texts, numbers)
            lanes, document, sizes, place, starts = read(texts)
            best = elected(lanes[0], document, sizes, window, rounds)
            likely = best == NONE
            if listed is None:
                likely |= bits.value.perhaps(best.view(np.int64))
            else:
                likely |= listed_words(listed, np.bincount(document, minlength=len(ids)))
            at = np.flatnonzero(starts & likely)
            if not len(at):
                return
            a, b = window_hashes(lanes, at, window)
            doc, start = ids.to_numpy()[document[at]], place[at]
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start = a[order], b[order], doc[order], start[order]
            first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            known = (doc > doc[begin][group]) | met.smaller(a, b, doc)
            several = doc[np.append(begin[1:], len(a)) - 1] > doc[begin]
            met.add(a[begin][several], b[begin][several], doc[begin][several])
            # what is settled goes along as runs, marked by a negative number, dealt by their documents
            run_doc, run = runs_of(doc[known], start[known])
            # one word over and over gives equal windows next to each other: these are one row
            same = ~first
            same[1:] &= (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1)
            open_ = np.flatnonzero(~known & ~same)  # a run's windows are known together
            begins = np.append(np.flatnonzero(~same), len(a))
            length = begins[np.searchsorted(begins, open_) + 1] - open_
            yield (
                np.concatenate([mixed(run_doc.view(np.uint64) + MIX[0]).view(np.int64), a[open_]]),
                np.concatenate([np.zeros(len(run), np.int64), b[open_]]),
                np.concatenate([run_doc, doc[open_]]),
                np.concatenate([-1 - run, start[open_] | length << 32]),
            )

        return some

    found = map_arrays(df, columns, "a long, b long, doc_id long, run long", make)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("doc_id long, run long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a = last_b = least = None  # of the group that the batch before ended in
        for batch in batches:
            a, b, doc, runs = (batch.column(i).to_numpy() for i in range(4))
            marks = runs < 0
            open_ = np.flatnonzero(~marks)
            if len(open_):
                x, y, d = a[open_], b[open_], doc[open_]
                first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                mins = d[np.flatnonzero(first)]
                if (x[0], y[0]) == (last_a, last_b):
                    mins[0] = min(mins[0], least)
                marks[open_] = d > mins[np.cumsum(first) - 1]
                last_a, last_b, least = x[-1], y[-1], mins[-1]
            if marks.any():
                runs = np.where(runs < 0, -1 - runs, runs)[marks]
                yield pa.RecordBatch.from_arrays([pa.array(doc[marks], pa.int64()), pa.array(runs, pa.int64())], schema=arrow)

    dealt = found.repartition(F.col("a")).sortWithinPartitions("a", "b", "doc_id")
    return dealt.mapInArrow(run, schema).unionByName(whole.select("doc_id", F.lit(WHOLE).cast("long").alias("run")))


def marked(df: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows surely without marks, other rows with the list of their marks, that list's column).

    Only rows that a bitmap of the marked ids can't clear are shuffled to meet their marks.
    """
    own = marks.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))  # a document's own
    bits = df.sparkSession.sparkContext.broadcast(bits_of(marks.select("doc_id").distinct().select(spread_id("doc_id").alias("n")), "n"))
    rows, n = numbered(df, "doc_id")
    clear = where_number(rows, n, lambda x: ~perhaps_inside(x, bits.value)).drop(n)
    inside = where_number(rows, n, lambda x: perhaps_inside(x, bits.value)).drop(n)
    doc, runs = fresh(df.columns, "_doc"), fresh(df.columns, "_runs")
    joined = inside.join(own.toDF(doc, runs), F.col("doc_id") == F.col(doc), "left").drop(doc)
    return clear, joined, runs


def removed_words(n: int, runs, window: int) -> np.ndarray:
    """Which of ``n`` words are covered by the windows of some runs."""
    runs = np.asarray(runs, np.int64)
    if (runs == WHOLE).any():
        return np.full(n, n >= window)
    start, many = runs & 0xFFFFFFFF, runs >> 32
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, np.minimum(start, n), 1)
    np.add.at(gone, np.minimum(start + many - 1 + window, n), -1)
    return np.cumsum(gone)[:n] > 0


def digest_removals(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by spaces."""
    df = whole_ids(df.select("doc_id", "text"), "doc_id")
    marks = staged(repeats(df, window, rounds, most_bits), "repeats")
    clear, joined, runs = marked(df, marks)

    def make():
        def one(k, raw, held=None):
            words = kept = (raw or b"").split()
            if held is not None and len(held):
                gone = removed_words(len(words), held, window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            yield k, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        return one

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_rows(clear, ["doc_id", "text"], schema, make).unionByName(map_rows(joined, ["doc_id", "text", runs], schema, make))


def strip_repeats(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The documents with repeated words, and the white space behind them, taken out of their texts."""
    marks = staged(repeats(df, window, rounds), "repeats")
    clear, joined, runs = marked(df, marks)
    word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def make():
        def one(raw, held):
            if raw is None or held is None or not len(held):
                return True
            pieces = word.findall(raw)
            gone = removed_words(len(pieces), held, window)
            if not gone.any():
                return True
            return b"".join(w for w, g in zip(pieces, gone.tolist()) if not g).decode()

        return lambda raws, held: list(map(one, raws, held))

    return clear.unionByName(rewrite_rows(joined, "text", make, runs))
