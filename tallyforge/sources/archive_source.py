"""An archive of raw documents as a Spark data source, to read and to write, in batch and in stream.

    spark.dataSource.register(ArchiveSource)
    docs.write.format("tallyforge_archive").mode("append").save(folder)
    spark.read.format("tallyforge_archive").load(folder).filter("source = 'feed'")
    spark.readStream.format("tallyforge_archive").load(folder)

Each task writes a Parquet file of its own and tells the driver its name, rows, and ranges of source and time. A commit writes one small
entry with these into the archive's log, by renaming it into place, so all files of a write appear together or not at all; files that
no entry names don't count. A stream's batch number is part of its entry: a batch that is committed again changes nothing.

A read plans its partitions from the log. Conditions on the source are applied in the files, conditions on the time leave out files
whose range can't match. A stream's offset is the number of entries read, and its rows go from tasks to Spark, not through the driver.
The folder is any that pyarrow opens by address, shared by the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "source string, external string, ts timestamp, payload string"
ARROW = pa.schema([("source", pa.string()), ("external", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("payload", pa.string())])
#: Rows that a partition of a read has at most, but for a single larger file.
PIECE_ROWS = 1_000_000


class Archive:
    """The files and the log of one archive folder."""

    def __init__(self, address: str):
        self.files, self.root = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)

    def names(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return sorted(x.path for x in found if x.base_name.endswith(".json"))

    def entries(self, begin: int = 0, end: int | None = None) -> list[dict]:
        out = []
        for path in self.names()[begin:end]:
            with self.files.open_input_stream(path) as f:
                out.append(json.loads(f.read()))
        return out

    def commit(self, files: list[dict], stream: str | None = None, batch: int | None = None) -> None:
        if stream is not None and any((e["stream"], e["batch"]) == (stream, batch) for e in self.entries()):
            return
        self.files.create_dir(f"{self.root}/_log")
        draft = f"{self.root}/_log/{uuid.uuid4().hex}.draft"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps({"stream": stream, "batch": batch, "files": files}).encode())
        self.files.move(draft, f"{self.root}/_log/{len(self.names()):012d}.json")

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[dict]:
        """One file with the rows of a task; none without rows."""
        name, writer, rows, sources, times = f"data/{uuid.uuid4().hex}.parquet", None, 0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(ARROW.names).cast(ARROW)
            if writer is None:
                self.files.create_dir(f"{self.root}/data")
                writer = pq.ParquetWriter(f"{self.root}/{name}", ARROW, filesystem=self.files, compression="zstd")
            writer.write_table(table)
            rows += table.num_rows
            for column, ends in (("source", sources), ("ts", times)):
                known = table[column].drop_null()
                if len(known):
                    found = pc.min_max(known).as_py()
                    ends += [found["min"], found["max"]]
        if writer is None:
            return []
        writer.close()
        stamp = lambda t: t.timestamp()
        return [{"path": name, "rows": rows, "source": [min(sources), max(sources)] if sources else None, "ts": [stamp(min(times)), stamp(max(times))] if times else None}]


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _pieces(files: list[dict]) -> list[Files]:
    out, rows = [Files([])], 0
    for f in files:
        if out[-1].paths and rows + f["rows"] > PIECE_ROWS:
            out.append(Files([]))
            rows = 0
        out[-1].paths.append(f["path"])
        rows += f["rows"]
    return out


def _seconds(t: datetime) -> float:
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()


class ArchiveReader(DataSourceReader):
    def __init__(self, address: str):
        self.address, self.sources, self.low, self.high = address, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("source",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = wanted if self.sources is None else self.sources & wanted
                continue
            if column == ("ts",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(x for x in (self.low, _seconds(f.value)) if x is not None)
            if column == ("ts",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(x for x in (self.high, _seconds(f.value)) if x is not None)
            yield f

    def _could(self, f: dict) -> bool:
        if self.sources is not None and not (f["source"] and any(f["source"][0] <= s <= f["source"][1] for s in self.sources if s is not None)):
            return False
        if self.low is None and self.high is None:
            return True
        return bool(f["ts"]) and (self.low is None or f["ts"][1] >= self.low) and (self.high is None or f["ts"][0] <= self.high)

    def partitions(self) -> list[Files]:
        return _pieces([f for e in Archive(self.address).entries() for f in e["files"] if self._could(f)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_files(self.address, partition.paths, self.sources)


def read_files(address: str, paths: list[str], sources: set | None = None) -> Iterator[pa.RecordBatch]:
    archive = Archive(address)
    chosen = None if sources is None else [("source", "in", [s for s in sources if s is not None])]
    for path in paths:
        if chosen:
            yield from pq.read_table(f"{archive.root}/{path}", filesystem=archive.files, filters=chosen).to_batches()
        else:
            with archive.files.open_input_file(f"{archive.root}/{path}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, address: str):
        self.address = address

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(Archive(self.address).names())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _pieces([f for e in Archive(self.address).entries(start["entries"], end["entries"]) for f in e["files"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_files(self.address, partition.paths)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, address: str):
        self.address = address

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Archive(self.address).write(iterator))

    def commit(self, messages: list[Written]) -> None:
        Archive(self.address).commit([f for m in messages if m for f in m.files])

    def abort(self, messages: list[Written]) -> None:
        archive = Archive(self.address)
        for f in [f for m in messages if m for f in m.files]:
            archive.files.delete_file(f"{archive.root}/{f['path']}")


class ArchiveStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, address: str, stream: str):
        self.address, self.stream = address, stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Archive(self.address).write(iterator))

    def commit(self, messages: list[Written], batchId: int) -> None:
        Archive(self.address).commit([f for m in messages if m for f in m.files], self.stream, batchId)

    def abort(self, messages: list[Written], batchId: int) -> None:
        ArchiveWriter(self.address).abort(messages)


class ArchiveSource(DataSource):
    """Format ``tallyforge_archive``; a stream that writes names itself by the option ``stream``."""

    @classmethod
    def name(cls) -> str:
        return "tallyforge_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("an archive is only appended to")
        return ArchiveWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> ArchiveStreamWriter:
        return ArchiveStreamWriter(self.options["path"], self.options.get("stream", "stream"))


def register(spark) -> None:
    """Make the format known, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
