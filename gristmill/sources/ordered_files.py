"""Text files in a stated order: a Python data source whose writer commits.

``write_ordered`` deals rows out by range of (file, order), so each task writes neighbouring pieces of a file. A file that
fits one task is one part, a larger one a numbered set of parts in order. A write goes to a folder of its own run:
a task writes its parts under the name of its attempt and moves them to their final names when they are complete, so a
repeated or second attempt replaces the same parts. The driver's commit lists the tasks in a manifest, which is moved
into place last; readers see only what the manifest lists. A write that was killed leaves no manifest, and the next
commit removes its folder. Beside each part stands an index of where its pieces end, so that pieces can be read back
whatever they contain.

Paths are URIs of any store that pyarrow opens (local and network folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gristmill.session import byte_batches

FORMAT = "ordered_files"
MANIFEST = "_manifest.json"
SCHEMA = "file string, part int, position bigint, piece string"
#: Bytes of parts that one reading task takes on.
READ_BYTES = 64 << 20
#: Pieces that a writing task holds as text at a time, and bytes of pieces that a reading task hands over at a time.
PIECES, HAND_BYTES = 100, 4 << 20


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path inside it."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:"):]
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def _put(store: stores.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


def _get(store: stores.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as file:
        return file.read()


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: where the list of its parts is."""

    partition: int
    parts: int
    listed: str


@dataclass
class Parts(InputPartition):
    """Parts to read: (file, part number, position of the first piece, path)."""

    parts: list[tuple[str, int, int, str]]


class OrderedFiles(DataSource):
    """``format("ordered_files")`` with ``path`` and, for writing, ``separator``, ``header``, ``end`` and ``extension``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Batches(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options))


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], f"run-{uuid.uuid4().hex[:12]}"
        self.separator, self.header, self.end = (options.get(k, d).encode() for k, d in (("separator", "\n"), ("header", ""), ("end", "\n")))
        self.extension = options.get("extension", "txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        return self.write_task(iterator, context.partitionId(), context.taskAttemptId())

    def write_task(self, batches: Iterator[pa.RecordBatch], partition: int, attempt: int) -> WriterCommitMessage:
        """The parts of one partition; pieces of a file must stand together."""
        store, root = opened(self.path)
        work = f"{root}/{self.run}/_attempts/{partition}-{attempt}"
        store.create_dir(work, recursive=True)
        out, name, ends, size, parts = None, None, [], 0, []

        def close() -> None:
            if out is not None:
                out.write(self.end)
                out.close()
                _put(store, f"{work}/{len(parts)}.index", np.array(ends, np.int64).tobytes())
                parts.append({"file": name, "pieces": len(ends), "bytes": size + len(self.end)})

        try:
            for batch in (b.slice(at, PIECES) for b in batches for at in range(0, b.num_rows, PIECES)):
                for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if file != name or out is None:
                        close()
                        name, ends, size = file, [], len(self.header)
                        out = store.open_output_stream(f"{work}/{len(parts)}.part")
                        out.write(self.header)
                    elif ends:
                        out.write(self.separator)
                        size += len(self.separator)
                    piece = b"" if piece is None else piece if isinstance(piece, bytes) else piece.encode()
                    out.write(piece)
                    ends += [size, size + len(piece)]
                    size += len(piece)
            close()
        except BaseException:
            if out is not None:
                out.close()
            store.delete_dir(work)
            raise
        for i, part in enumerate(parts):
            part["pieces"] //= 2
            folder = f"{root}/{self.run}/files/{quote(part['file'] or '', safe='') or '_none'}"
            store.create_dir(folder, recursive=True)
            store.move(f"{work}/{i}.index", f"{folder}/.part-{partition:05d}.index")
            store.move(f"{work}/{i}.part", f"{folder}/part-{partition:05d}.{self.extension}")
            part["path"] = f"{folder[len(root) + 1:]}/part-{partition:05d}.{self.extension}"
        listed = f"{self.run}/_tasks/{partition}.json"
        store.create_dir(f"{root}/{self.run}/_tasks", recursive=True)
        _put(store, f"{work}/tasks.json", json.dumps(parts).encode())
        store.move(f"{work}/tasks.json", f"{root}/{listed}")
        store.delete_dir(work)
        return Written(partition, len(parts), listed)

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        body = {"run": self.run, "tasks": [m.listed for m in done if m.parts]}
        store.create_dir(root, recursive=True)
        _put(store, f"{root}/.{MANIFEST}.{self.run}", json.dumps(body).encode())
        store.move(f"{root}/.{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")
        for info in store.get_file_info(stores.FileSelector(root)):
            # earlier runs and those that never committed
            if info.type == stores.FileType.Directory and info.base_name.startswith("run-") and info.base_name != self.run:
                store.delete_dir(info.path)

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == stores.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class Reader(DataSourceReader):
    """Pieces of the committed write: (file, part, position in the file, piece)."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        tasks = json.loads(_get(store, f"{root}/{MANIFEST}"))["tasks"]
        out, run, size, at, last = [], [], 0, 0, None
        for number, listed in enumerate(tasks):
            for part in json.loads(_get(store, f"{root}/{listed}")):
                at = at if part["file"] == last else 0
                run.append((part["file"], number, at, part["path"]))
                size, at, last = size + part["bytes"], at + part["pieces"], part["file"]
                if size >= READ_BYTES:
                    out.append(Parts(run))
                    run, size = [], 0
        return [*out, Parts(run)] if run else out

    def read(self, partition: Parts) -> Iterator[tuple]:
        store, root = opened(self.path)
        for file, number, at, path in partition.parts if partition else []:
            folder, name = path.rsplit("/", 1)
            ends = np.frombuffer(_get(store, f"{root}/{folder}/.{name.rsplit('.', 1)[0]}.index"), np.int64).reshape(-1, 2)
            with store.open_input_stream(f"{root}/{path}") as stream:
                done = 0
                for i, (lo, hi) in enumerate(ends.tolist()):
                    stream.read(lo - done)
                    yield file, number, at + i, stream.read(hi - lo).decode("utf-8", "replace")
                    done = hi


class Batches(Reader):
    """The same pieces as Spark takes them: in batches bounded by bytes."""

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in super().read(partition):
            rows.append(row)
            size += len(row[3])
            if size >= HAND_BYTES or len(rows) >= 10_000:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "part", "position", "piece"])


def write_ordered(rows: DataFrame, path: str, file: Column, order: list[str], piece: Column, separator: str = "\n", header: str = "", end: str = "\n", extension: str = "txt") -> None:
    """Write ``piece`` of every row to the file named by ``file`` (null: ``_none``), in the order of ``order``."""
    byte_batches(rows.sparkSession)
    rows.sparkSession.dataSource.register(OrderedFiles)
    named = rows.select(file.cast("string").alias("_file"), piece.alias("_piece"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    keys = ["_file", *[f"_order{i}" for i in range(len(order))]]
    dealt = named.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_file", "_piece")
    dealt.write.format(FORMAT).mode("append").options(path=path, separator=separator, header=header, end=end, extension=extension).save()


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, position, piece) of the last committed write."""
    spark.dataSource.register(OrderedFiles)
    return spark.read.format(FORMAT).option("path", path).load()


def committed(path: str) -> str:
    """Folder of the last committed write; its sub-folders are the files, for readers of other formats."""
    store, root = opened(path)
    return f"{path}/{json.loads(_get(store, f'{root}/{MANIFEST}'))['run']}/files"


def file_of(path: Column) -> Column:
    """The file that a part with this path belongs to."""
    return F.url_decode(F.url_decode(F.regexp_extract(path, r"([^/]+)/part-\d+\.[^/]*$", 1)))


