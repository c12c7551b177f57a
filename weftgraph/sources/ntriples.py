"""N-Triples in and out.

A line is parsed by regular expressions inside Spark: blank lines and ``#`` lines are skipped, what follows the
closing dot is ignored, lexical forms and escapes stay as they are, and a literal's ``@lang`` or ``^^<type>`` is kept
as its raw extension.  There are no blank nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import dataset_of_member, fresh, name_part, triple_line

# A statement, in one pass: subject, predicate, then "<" and an IRI, or '"', the lexical form and an extension.  A quote
# closes after an even number of backslashes; repeats are possessive, as others would recurse once per character.  An
# extension runs up to blank, or a dot that ends the statement.
LINE = (
    r'(?s)^[ \t]*<([^>]*+)>[ \t]*<([^>]*+)>[ \t]*(?:(<)([^>]*+)>|(")((?:[^"\\]++|\\.)*+)"(?:(\^\^<[^>]*+)>|(@[^\s.]++(?:\.[^\s.]++)*+))?)'
    r"[ \t]*\.(?:[ \t#].*)?\r?\z"
)
# what can't hold ">" first: subject, predicate, sign of the object's kind, IRI, extension without its end, lexical form
PARTS = "$1>$2>$3$5>$4>$7$8>$6"
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


def parse_lines(lines: DataFrame, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Triples from a column of lines, other columns kept.

    A line that isn't a statement raises (FAILFAST), is dropped (DROPMALFORMED), or is kept in ``_corrupt`` (PERMISSIVE).
    Null lines count as blank.  Lines of any length are taken.
    """
    if mode not in MODES:
        raise ValueError(mode)
    c = F.col(column)
    rest = [x for x in lines.columns if x != column]
    held = fresh(lines.columns, "_parts")
    # a line that doesn't match comes back as it is; one that does never equals its parts
    found = lines.where(c.startswith("<") | ~c.rlike(r"(?s)^[ \t]*(#.*)?\r?\z")).withColumn(held, F.regexp_replace(c, LINE, PARTS))
    ok = F.col(held) != c
    if mode == "DROPMALFORMED":
        found = found.where(ok)
    elif mode == "FAILFAST":
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), c)).cast("boolean"))
    found = found.withColumn(held, F.when(ok, F.split(held, ">", 6)))
    part = lambda i: F.col(held)[i]
    iri = part(2) == "<"
    return found.select(
        *rest,
        part(0).alias("s"),
        part(1).alias("p"),
        F.when(iri, part(3)).otherwise(part(5)).alias("o"),
        F.when(iri, "iri").when(part(2) == '"', "literal").alias("o_kind"),
        F.concat(part(4), F.when(part(4).startswith("^^"), ">").otherwise("")).alias("ext"),
        *([F.when(F.col(held).isNull(), F.regexp_replace(c, r"\r\z", "")).alias("_corrupt")] if mode == "PERMISSIVE" else []),
    )


def read_ntriples(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Plain, ``.gz`` or ``.bz2`` text; bz2 files are split."""
    return parse_lines(spark.read.text(path), "value", mode)


def read_schema_folder(spark: SparkSession, path: str) -> DataFrame:
    """Triples with the two domains that a file's name ``a~b~...`` gives."""
    lines = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    out = parse_lines(lines)
    return out.withColumn("domain_a", name_part(F.col("file"), 0)).withColumn("domain_b", name_part(F.col("file"), 1)).drop("file")


def lang(ext: Column) -> Column:
    return F.regexp_extract(ext, "^@(.+)$", 1)


def datatype(ext: Column) -> Column:
    return F.regexp_extract(ext, r"^\^\^<([^>]*)>$", 1)


def lines_of(triples: DataFrame) -> DataFrame:
    return triples.select(triple_line(*(F.col(c) for c in ("s", "p", "o", "o_kind", "ext"))).alias("value"))


def write_ntriples(triples: DataFrame, path: str, by: str | None = None, compression: str = "none") -> None:
    """Text files, in one folder per value of ``by`` if given."""
    value = lines_of(triples).schema["value"]
    columns = [triple_line(*(F.col(c) for c in ("s", "p", "o", "o_kind", "ext"))).alias(value.name)] + ([F.col(by)] if by else [])
    writer = triples.select(*columns).write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).text(path)


def pax_path(raw: bytes) -> str | None:
    """The path that a tar member's extended header names."""
    while raw.strip(b"\0"):
        size = int(raw.split(b" ", 1)[0])
        key, value = raw[:size].split(b" ", 1)[1][:-1].split(b"=", 1)
        if key == b"path":
            return value.decode()
        raw = raw[size:]
    return None


class Members:
    """The text members of a tar stream that arrives line by line: (name, line) of each line of each member."""

    def __init__(self, wanted):
        self.wanted, self.name, self.long = wanted, None, None
        self.kind, self.flag, self.left, self.pad, self.held = "", b"", 0, 0, b""

    def feed(self, line: bytes):
        """Take the next line, without its end."""
        data = line + b"\n"
        while data:
            if self.left:
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                yield from self._content(part)
            else:
                self.held += data
                data = self._header()

    def _content(self, part: bytes):
        if self.kind == "text":
            self.held += part
            if part.endswith(b"\n") or not self.left:
                yield self.name, self.held.removesuffix(b"\n").decode(errors="replace")
                self.held = b""
        elif self.kind == "name":
            self.held += part
            if not self.left:
                self.long = self.held.rstrip(b"\0").decode() if self.flag == b"L" else pax_path(self.held) or self.long
                self.held = b""
        if not self.left and self.kind != "pad":
            self.kind, self.left = "pad", self.pad

    def _header(self) -> bytes:
        """Read a header off what is held; returns what is behind it."""
        if len(self.held) < 512:
            return b""
        raw, behind, self.held = self.held[:512], self.held[512:], b""
        if not raw.strip(b"\0"):  # the end's empty blocks
            return behind
        self.left = int(raw[124:136].strip(b" \0") or b"0", 8)
        self.pad, self.flag = -self.left % 512, raw[156:157]
        if self.flag in (b"L", b"x"):  # the next member's long name
            self.kind = "name"
            return behind
        text = lambda x: x.split(b"\0", 1)[0].decode()
        prefix = text(raw[345:500]) if raw[257:263] == b"ustar\0" else ""
        self.name, self.long = self.long or "/".join(x for x in (prefix, text(raw[:100])) if x), None
        self.kind = "text" if self.flag in (b"0", b"\0") and self.wanted(self.name) else "skip"
        return behind


def member_lines(spark: SparkSession, path: str | list[str], datasets: list[str] | None = None) -> DataFrame:
    """(file, member, value): the lines of all text members of gzipped tar files.

    Spark decompresses an archive as a stream of lines, and the tar structure is followed along that stream: a task holds
    one line at a time, however large the archive.  A gzip file is one task's work, as it can't be split.
    """
    import pyarrow as pa

    lines = spark.read.option("lineSep", "\n").text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")

    def wanted(name: str) -> bool:
        return name.endswith(".ttl") and (not datasets or "-".join(name.rsplit("/", 1)[-1].split("-")[2:]).removesuffix(".ttl") in datasets)

    def run(batches):
        at, members = None, None
        for batch in batches:
            out = ([], [], [])
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if file != at:
                    at, members = file, Members(wanted)
                for name, value in members.feed(raw):
                    for column, x in zip(out, (file, name, value)):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(("file", "member", "value"), out)))

    return lines.mapInArrow(run, "file string, member string, value string")


def read_wiki_tars(spark: SparkSession, path: str | list[str], datasets: list[str] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Triples of all members of the tar files ``id~lang~name~host.tar.gz``; a missing data set is just absent."""
    out = parse_lines(member_lines(spark, path, datasets), "value", mode)
    base = F.element_at(F.split("member", "/"), -1)
    return out.select(
        *[c for c in out.columns if c not in ("file", "member")],
        name_part(F.col("file"), 0).cast("long").alias("wiki_id"),
        name_part(F.col("file"), 1).alias("lang"),
        name_part(F.col("file"), 2).alias("domain"),
        F.regexp_replace(dataset_of_member(base), r"\.ttl$", "").alias("dataset"),
    )


def write_wiki_tars(dump: DataFrame, path: str, date: str = "20170801") -> DataFrame:
    """One ``id~lang~name~name.host.tar.gz`` per source in ``path``, with a member per data set; (file, members) of each.

    Archives can't be written piecewise, so a source is one task's work, and ``path`` must be a folder that all executors
    have mounted.  Members are collected in scratch files, not in memory; an archive appears under its name when it is
    complete, so that a task can be run again.
    """
    import pyarrow as pa

    file = F.concat_ws("~", F.col("wiki_id").cast("string"), "lang", "domain", F.concat("domain", F.lit(".example.org.tar.gz")))
    member = F.concat("lang", F.lit(f"wiki-{date}-"), "dataset", F.lit(".ttl"))
    line = triple_line(*(F.col(c) for c in ("s", "p", "o", "o_kind", "ext")))
    rows = dump.select(file.alias("file"), member.alias("member"), line.alias("value"))

    def run(batches):
        import os
        import tarfile
        import tempfile
        import uuid

        os.makedirs(path, exist_ok=True)
        at, tar, aside, name, scratch, n = None, None, None, None, None, 0

        def close_member():
            info = tarfile.TarInfo(name)
            info.size = scratch.tell()
            scratch.seek(0)
            tar.addfile(info, scratch)
            scratch.close()

        def close_file():
            tar.close()
            os.replace(aside, os.path.join(path, at))
            return pa.RecordBatch.from_pydict({"file": [at], "members": pa.array([n], pa.int32())})

        for batch in batches:
            for f, m, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (f, m) != (at, name):
                    if name is not None:
                        close_member()
                    if f != at:
                        if at is not None:
                            yield close_file()
                        aside = os.path.join(path, f".{uuid.uuid4().hex}")
                        at, tar, n = f, tarfile.open(aside, "w:gz"), 0
                    name, scratch, n = m, tempfile.TemporaryFile(), n + 1
                scratch.write(value.encode() + b"\n")
        if at is not None:
            close_member()
            yield close_file()

    return rows.repartition("file").sortWithinPartitions("file", "member").mapInArrow(run, "file string, members int")
