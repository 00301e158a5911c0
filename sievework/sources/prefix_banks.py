"""Compressed record banks: a source that stops reading at a bound, and the sink that writes such banks.

A bank is a text file, plain or compressed with zstd or gzip by its suffix; one partition reads one file. The reader
decompresses as a stream and stops as soon as the file's bound of records or bytes is reached, so that a slice of a month
costs what the slice costs, whatever the month holds. Files are found and opened by pyarrow's file systems, so a bank may
lie in any store that these know.

Two kinds of records are cut from a stream: `games`, of which each begins at a line that starts with a header, and
`lines`. Records are whole: one is read if there is still room before it, so the last may pass the bound of bytes. What
stands before the first header is a record of its own.

Defined cases: a file without bytes has no records; an empty folder gives no rows; a last line without an end counts; bytes
that are not UTF-8 become replacement characters; files whose name starts with `_` or `.` are no banks.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: What begins a game.
HEADER = b"[Event "
#: Bytes asked of the store at once, and of records handed on at once.
READ, HAND = 1 << 18, 1 << 22
#: Bytes of text in a compressed frame of a written bank.
FRAME = 1 << 24


def open_store(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


class _Counted(io.RawIOBase):
    """A stream that knows how many bytes were taken from it."""

    def __init__(self, raw: pa.NativeFile):
        self.raw, self.taken = raw, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        got = self.raw.read(min(len(into), READ))
        into[: len(got)] = got
        self.taken += len(got)
        return len(got)


def _plain(source: _Counted, path: str) -> io.BufferedIOBase:
    if path.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(source, read_size=READ, read_across_frames=True), READ)
    return gzip.open(io.BufferedReader(source, READ)) if path.endswith(".gz") else io.BufferedReader(source, READ)


def records(stream: io.BufferedIOBase, kind: str, max_records: int, max_bytes: int) -> Iterator[bytes]:
    """Whole records while fewer than max_records were given and they hold less than max_bytes."""
    n = size = 0
    if kind == "lines":
        while n < max_records and size < max_bytes and (line := stream.readline()):
            n, size = n + 1, size + len(line)
            yield line
        return
    held: list[bytes] = []
    while n < max_records and size < max_bytes:
        line = stream.readline()
        if held and (not line or line.startswith(HEADER)):
            record = b"".join(held)
            held.clear()
            n, size = n + 1, size + len(record)
            yield record
        if not line:
            return
        held.append(line)


@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class BankReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "games")
        if self.kind not in ("games", "lines"):
            raise ValueError(f"no such kind of bank: {self.kind}")
        self.most, self.bytes = int(options.get("maxrecords", 1 << 62)), int(options.get("maxbytes", 1 << 62))

    def partitions(self) -> list[OneFile]:
        fs, inner = open_store(self.path)
        if fs.get_file_info(inner).type == pfs.FileType.File:
            return [OneFile(self.path)]
        found = fs.get_file_info(pfs.FileSelector(inner, recursive=True))
        names = sorted(x.path for x in found if x.type == pfs.FileType.File and not x.base_name.startswith(("_", ".")))
        root = self.path.rstrip("/")
        return [OneFile(root + name[len(inner.rstrip("/")) :]) for name in names]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands on where there are no partitions
            return
        fs, inner = open_store(partition.path)
        with fs.open_input_stream(inner, compression=None, buffer_size=READ) as raw:
            source = _Counted(raw)
            rows: list[tuple] = []
            held = 0
            for i, record in enumerate(records(_plain(source, inner), self.kind, self.most, self.bytes)):
                rows.append((partition.path, i + 1, record.decode("utf-8", "replace"), len(record), source.taken))
                held += len(record)
                if held >= HAND:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "record_no", "text", "bytes", "bytes_read"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class BankWriter(DataSourceArrowWriter):
    """Each task writes hidden files, and the commit gives those of the tasks that succeeded their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ".pgn.zst"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        seen: set[str] = set()
        name, out = None, None
        for batch in batches:
            for own, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                if out is None or own != name:
                    if out is not None:
                        out.close()
                    if own is None or "/" in own or own in seen:
                        raise ValueError(f"no name of a file, or its rows do not come together: {own}")
                    seen.add(own)
                    name, hidden = own, f"_{self.run}-{uuid.uuid4().hex}"
                    done.append((hidden, f"{own}{self.suffix}"))
                    out = _Framed(fs.open_output_stream(f"{root}/{hidden}", compression=None), self.suffix)
                out.write((text or "").encode())
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_store(self.path)
        files = [pair for m in messages if m for pair in m.files]
        finals = [final for _, final in files]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("rows of one file lie in several partitions: deal them by the column file first")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pfs.FileSelector(root, recursive=True)):
                if x.type == pfs.FileType.File and not x.base_name.startswith(f"_{self.run}-"):
                    fs.delete_file(x.path)
        for hidden, final in files:
            fs.move(f"{root}/{hidden}", f"{root}/{final}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_store(self.path)
        for hidden in (h for m in messages if m for h, _ in m.files):
            fs.delete_file(f"{root}/{hidden}")


class _Framed:
    """Text compressed in frames of bounded size, or as it is."""

    def __init__(self, raw: pa.NativeFile, suffix: str):
        self.raw, self.frame, self.size = raw, None, 0
        self.zst, self.gz = suffix.endswith(".zst"), suffix.endswith(".gz")

    def write(self, data: bytes) -> None:
        if self.frame is None and self.zst:
            import zstandard

            self.frame = zstandard.ZstdCompressor().compressobj()
        elif self.frame is None and self.gz:
            import zlib

            self.frame = zlib.compressobj(wbits=31)
        self.raw.write(self.frame.compress(data) if self.frame else data)
        self.size += len(data)
        if self.size >= FRAME:
            self._end()

    def _end(self) -> None:
        if self.frame:
            self.raw.write(self.frame.flush())
        self.frame, self.size = None, 0

    def close(self) -> None:
        self._end()
        self.raw.close()


class RecordBank(DataSource):
    """Read: options path, kind (games or lines), maxRecords and maxBytes for each file. Write: columns file and text."""

    @classmethod
    def name(cls) -> str:
        return "record_bank"

    def schema(self) -> str:
        return "file string, record_no long, text string, bytes long, bytes_read long"

    def reader(self, schema) -> BankReader:
        return BankReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> BankWriter:
        return BankWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_bank(spark: SparkSession, path: str, kind: str = "games", max_records: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(file, record_no, text, bytes, bytes_read): the first whole records of each file within both bounds.

    bytes_read is what had been taken from the (compressed) file by then.
    """
    spark.dataSource.register(RecordBank)
    reader = spark.read.format("record_bank").option("kind", kind)
    for name, value in (("maxRecords", max_records), ("maxBytes", max_bytes)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def write_bank(rows: DataFrame, path: str, order: list[str], suffix: str = ".pgn.zst") -> None:
    """Writes rows (with file, text) as one bank for each file, its records in order; replaces what was there."""
    rows.sparkSession.dataSource.register(RecordBank)
    dealt = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "text")
    dealt.write.format("record_bank").option("suffix", suffix).mode("overwrite").save(path)


def with_elo(games: DataFrame) -> DataFrame:
    """games (with text) and white_elo, black_elo, has_eval."""
    elo = lambda side: F.regexp_extract("text", rf'\[{side}Elo "(\d+)"\]', 1).try_cast("int")
    return games.withColumns({"white_elo": elo("White"), "black_elo": elo("Black"), "has_eval": F.contains("text", F.lit("%eval"))})


def read_puzzle_prefix(spark: SparkSession, path: str, columns: tuple[str, ...], max_records: int | None = None) -> DataFrame:
    """The first lines of each bank of comma-separated lines, under the bank's columns; a file's first line is its header."""
    most = None if max_records is None else max_records + 1
    lines = read_bank(spark, path, "lines", max_records=most).where(F.col("record_no") > 1)
    parsed = lines.select("file", (F.col("record_no") - 1).alias("record_no"), F.from_csv(F.regexp_replace("text", r"[\r\n]+$", ""), ", ".join(f"{c} string" for c in columns), {"escape": '"'}).alias("r"))
    numbers = {c: F.col(c).try_cast("int") for c in ("Rating", "RatingDeviation", "Popularity", "NbPlays") if c in columns}
    return parsed.select("file", "record_no", "r.*").withColumns(numbers).where(F.col("Rating").isNotNull())
