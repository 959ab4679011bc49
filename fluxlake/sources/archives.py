"""ZIP archives of text and XML files.

Reading an archive's directory, and unpacking a member, are the steps that need a Python worker. Members are rows of their own, so the members of
one large archive are unpacked in many tasks, each as a stream: neither a member's contents nor an XML document's tree is ever whole
in memory. Layouts, duplicates and bad values are then handled by ordinary column expressions.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.operators.clean import clean_flux, dedup_keep_first
from fluxlake.session import stage
from fluxlake.sources.folders import open_folder
from fluxlake.sources.text_layouts import parse_text

BATCH_ROWS = 50_000
BATCH_BYTES = 16 << 20
CHUNK_BYTES = 1 << 16
MEMBERS = "archive string, member string, member_no bigint, kind string, method int, crc bigint, size bigint, data binary, reason string"
SKIPPED = "skipped"

# Sent along with the tasks, so that workers do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What reading a damaged, encrypted or oddly packed member can raise.
_DAMAGE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, NotImplementedError, RuntimeError, struct.error, OSError)
_UNPACKERS = {zipfile.ZIP_DEFLATED: lambda: zlib.decompressobj(-15), zipfile.ZIP_BZIP2: bz2.BZ2Decompressor, zipfile.ZIP_LZMA: zipfile.LZMADecompressor}


class _Fields:
    """Parser target that gives ``(path, value)`` of an element's text and attributes as soon as its first child begins or it ends."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str]] = []
        self._path: list[str] = []
        self._open: tuple[dict, list[str]] | None = None

    def _flush(self) -> None:
        if self._open is not None:
            (attributes, parts), path = self._open, self._path[-1]
            text = "".join(parts).strip()
            if text:
                self.found.append((path, text))
            self.found.extend((f"{path}@{name}", value) for name, value in attributes.items())
            self._open = None

    def start(self, tag: str, attributes: dict) -> None:
        self._flush()
        self._path.append(f"{self._path[-1]}/{tag}" if self._path else tag)
        self._open = (attributes, [])

    def data(self, text: str) -> None:
        # Text after a child is nobody's value.
        if self._open is not None:
            self._open[1].append(text)

    def end(self, tag: str) -> None:
        self._flush()
        self._path.pop()

    def close(self) -> None:
        pass


def _parsed(chunks: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    target = _Fields()
    parser = ElementTree.XMLParser(target=target)
    for chunk in chunks:
        parser.feed(chunk)
        found, target.found = target.found, []
        yield from found
    parser.close()
    yield from target.found


def xml_fields(read: Callable[[], Iterable[bytes]]) -> Iterator[tuple[str, str]]:
    """``(path, value)`` of every element with text and of every attribute, in document order; none if the document is malformed.

    ``read`` gives the document's bytes in chunks and is called twice: to see that all of it is well formed, and for the fields.
    """
    try:
        for _ in _parsed(read()):
            pass
    except ElementTree.ParseError:
        return
    yield from _parsed(read())


def _directory(archive: str, content: bytes) -> Iterator[tuple]:
    """A row per member with its packed bytes; if a header is damaged, one with the reason and no other."""
    rows = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            for number, member in enumerate(packed.infolist()):
                # Opening compares the headers and refuses what is encrypted or packed in an unknown way.
                packed.open(member).close()
                names = struct.unpack_from("<HH", content, member.header_offset + 26)
                start = member.header_offset + 30 + sum(names)
                kind = member.filename.lower().rpartition(".")[2]
                rows.append((archive, member.filename, number, kind, member.compress_type, member.CRC, member.file_size, start, start + member.compress_size))
    except _DAMAGE as error:
        yield archive, None, 0, SKIPPED, 0, 0, 0, None, f"{type(error).__name__}: {error}"
        return
    for *row, start, end in rows:
        yield *row, content[start:end], None


def _unpacked(data: bytes, method: int) -> Iterator[bytes]:
    """A member's contents in chunks."""
    if method == zipfile.ZIP_STORED:
        for at in range(0, len(data), CHUNK_BYTES):
            yield data[at:at + CHUNK_BYTES]
        return
    unpacker = _UNPACKERS[method]()
    for at in range(0, len(data), CHUNK_BYTES):
        piece = data[at:at + CHUNK_BYTES]
        if method == zipfile.ZIP_DEFLATED:
            # Few packed bytes can hold very many others: no more than a chunk comes out at once.
            while piece:
                yield unpacker.decompress(piece, CHUNK_BYTES)
                piece = unpacker.unconsumed_tail
        elif not unpacker.eof:
            yield unpacker.decompress(piece)
    if method == zipfile.ZIP_DEFLATED:
        yield unpacker.flush()


def _damage(member: str, data: bytes, method: int, crc: int, size: int) -> str | None:
    """Why a member's contents are not what its archive says, or None."""
    found, length = 0, 0
    try:
        for chunk in _unpacked(data, method):
            found, length = zlib.crc32(chunk, found), length + len(chunk)
        if length < size:
            raise EOFError(f"file {member!r} ends early")
        if found != crc or length > size:
            raise zipfile.BadZipFile(f"Bad CRC-32 for file {member!r}")
    except _DAMAGE as error:
        return f"{type(error).__name__}: {error}"
    return None


class _Chunks(io.RawIOBase):
    """Chunks as a file."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self._chunks, self._rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self._rest:
            chunk = next(self._chunks, None)
            if chunk is None:
                return 0
            self._rest = chunk
        count = min(len(buffer), len(self._rest))
        buffer[:count], self._rest = self._rest[:count], self._rest[count:]
        return count


def _lines(data: bytes, method: int) -> Iterator[str]:
    reader = io.TextIOWrapper(io.BufferedReader(_Chunks(_unpacked(data, method)), CHUNK_BYTES), "utf-8", errors="replace", newline="\n")
    return (line.rstrip("\r\n") for line in reader)


def _batches(rows: Iterable[tuple], columns: list[str], weight: Callable[[tuple], int] = lambda row: 0) -> Iterator[pd.DataFrame]:
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += weight(row)
        if len(batch) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pd.DataFrame(batch, columns=columns)
            batch, held = [], 0
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for frame in frames:
            for archive, member, number, kind, method, data in frame[["archive", "member", "member_no", "kind", "method", "data"]].itertuples(index=False, name=None):
                if kind == "txt":
                    for line_no, line in enumerate(_lines(data, method)):
                        yield archive, member, number, kind, line_no, None, line
                else:
                    for field_no, (path, value) in enumerate(xml_fields(lambda: _unpacked(data, method))):
                        yield archive, member, number, kind, field_no, path, value

    return _batches(rows(), list(schemas.MEMBER_LINES.names))


def list_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Archives of a folder as ``(path, content)``; an error if there are none. In a folder laid out as ``archive=..`` that is the archive's name."""
    files = open_folder(spark, path, pattern)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no archives matching {pattern!r} in {path}")
    return files.select(F.col("archive").cast("string").alias("path") if "archive" in files.columns else F.col("path"), "content")


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per member with its packed bytes, dealt to tasks by member; an unreadable archive gives one row with the reason.

    The table is written once: it is read to check all members and to unpack the wanted ones.
    """

    def directories(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for path, content in zip(frame["path"], frame["content"]) for row in _directory(path.rpartition("/")[2], content))
        return _batches(rows, [field.split()[0] for field in MEMBERS.split(", ")], lambda row: len(row[7] or b""))

    return stage(archives.select("path", "content").mapInPandas(directories, MEMBERS).repartition("archive", "member_no"), "archive_members")


def damaged_archives(members: DataFrame) -> DataFrame:
    """``(archive, reason)`` of the archives that can't be read or of which a member fails its checksum: the first such member's reason."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [_damage(*row) for row in frame[["member", "data", "method", "crc", "size"]].itertuples(index=False, name=None)]
            yield frame[["archive", "member_no"]].assign(reason=pd.Series(told, dtype=object))

    whole = members.where("reason IS NULL").mapInPandas(check, "archive string, member_no bigint, reason string")
    found = whole.unionByName(members.select("archive", "member_no", "reason")).where("reason IS NOT NULL")
    return found.groupBy("archive").agg(F.min_by("reason", "member_no").alias("reason"))


def expand_archives(archives: DataFrame, kinds: tuple[str, ...] = ("txt", "xml")) -> DataFrame:
    """Text lines, and XML fields as ``(path, line)``, of the members of the wanted ``kinds``.

    An archive with a damaged member is left out whole and gives one row of kind ``skipped`` with the reason as its line. Members of the
    same name are members of their own.
    """
    members = archive_members(archives)
    damaged = stage(damaged_archives(members), "damaged_archives")
    skipped = damaged.select(
        "archive", F.lit(None).cast("string").alias("member"), F.lit(0).cast("bigint").alias("member_no"), F.lit(SKIPPED).alias("kind"),
        F.lit(0).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("path"), F.col("reason").alias("line"),
    )
    wanted = members.where(F.col("reason").isNull() & F.col("kind").isin(*kinds)).join(damaged, "archive", "left_anti")
    return wanted.mapInPandas(_expand, schemas.MEMBER_LINES).unionByName(skipped)


def skipped_archives(members: DataFrame) -> DataFrame:
    """``(archive, reason)`` of the archives that could not be read."""
    return members.where(F.col("kind") == SKIPPED).select("archive", F.col("line").alias("reason"))


def archive_flux(members: DataFrame) -> DataFrame:
    """``(archive, ts, electron_flux)``, one row per archive and stamp.

    Duplicates inside an archive are dropped before bad values are nulled, in member and line order.
    """
    parsed = parse_text(members.where("kind = 'txt'"))
    flux = parsed.select("archive", "ts", "electron_flux", "member_no", "line_no")
    first = dedup_keep_first(flux, ["member_no", "line_no"], keys=["archive"])
    return clean_flux(first.select("archive", "ts", "electron_flux"))


def archive_metadata(members: DataFrame) -> DataFrame:
    """``(archive, path, value)``: flattened XML, where a later field replaces an earlier one."""
    fields = members.where("kind = 'xml'").select(
        "archive", F.struct("member_no", "line_no").alias("place"), "path", F.col("line").alias("value")
    )
    return fields.groupBy("archive", "path").agg(F.max_by("value", "place").alias("value"))


def metadata_maps(metadata: DataFrame) -> DataFrame:
    """One map per archive."""
    return metadata.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("metadata"))


def combine_archives(flux: DataFrame) -> DataFrame:
    """The signal of all archives: per stamp the row of the first archive by name."""
    return dedup_keep_first(flux, ["archive"]).select("ts", "electron_flux")


def scan_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """A folder of archives as one signal ``(ts, electron_flux)``."""
    combined = combine_archives(archive_flux(expand_archives(list_archives(spark, path, pattern), ("txt",))))
    if combined.isEmpty():
        raise ValueError("no flux data in any archive")
    return combined
