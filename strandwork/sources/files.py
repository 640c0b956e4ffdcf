"""Files as data sources: folders listed page by page, and documents that change from one whole version to the next.

Both are sources for ``spark.read.format`` and ``write.format`` once ``register`` has been called. Files are reached through
Arrow's file systems, whatever store a folder's address names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandwork.session import spread

PIECE = 1 << 20
PAGE = 1000
#: Names that one task reads, where pages are smaller.
NAMES = 250


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Pages(InputPartition):
    """Pages as ``folder, after, names``: the names of a folder that come behind ``after``."""

    pages: list[tuple[str, str, list[str]]]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.size = int(options.get("page_size", PAGE))

    def _names(self, folder: str) -> list[str]:
        """The files of a folder itself, in the order of their names."""
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_")))

    def partitions(self) -> list[Pages]:
        store, root = opened(self.path)
        below = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        folders = ["", *sorted(f.path[len(root.rstrip("/")) + 1 :] for f in below if f.type == fs.FileType.Directory)]
        found, held = [Pages([])], 0
        for folder in folders:
            names = self._names(folder)
            for at in range(0, len(names), self.size):
                page = names[at : at + self.size]
                if held and held + len(page) > NAMES:
                    found.append(Pages([]))
                    held = 0
                found[-1].pages.append((folder, names[at - 1] if at else "", page))
                held += len(page)
        return found

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, root = opened(self.path)
        for folder, after, names in partition.pages:
            for name in names:
                key, digest, size = f"{folder}/{name}".lstrip("/"), hashlib.md5(usedforsecurity=False), 0
                try:
                    body = store.open_input_stream(f"{root}/{key}", compression=None)
                except FileNotFoundError:  # it has gone since
                    continue
                with body:
                    while piece := body.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                yield key, size, digest.hexdigest(), f"{folder}>{after}"


class Listing(DataSource):
    """``key, size, md5, token`` of the files under ``path``, recursively, in pages of ``page_size`` names of a folder.

    A page is named by its folder and the last name before it, its token. A folder is listed once, whatever the number of
    its pages, and a task reads as many small pages as come to ``NAMES`` names. ``suffix`` keeps names that end so; hidden ones are not listed; a file of any size is hashed in
    pieces.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "key string, size long, md5 string, token string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str


def versions(path: str) -> list[str]:
    """The versions of a document that are whole, oldest first."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and re.fullmatch(r"v\d{8}", f.base_name))


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.draft = path.rstrip("/"), f".draft-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = opened(f"{self.path}/{self.draft}")
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.json"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                out.write((row[0] + "\n").encode())
        return Written(name)

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        with store.open_output_stream(f"{root}/{self.draft}/files", compression=None) as out:
            out.write(json.dumps(sorted(m.file for m in messages if m)).encode())
        now = versions(self.path)
        target = f"{root}/v{int(now[-1][1:]) + 1 if now else 1:08d}"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            raise RuntimeError(f"{target} was written by somebody else meanwhile")
        store.move(f"{root}/{self.draft}", target)

    def abort(self, messages) -> None:
        store, root = opened(f"{self.path}/{self.draft}")
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


@dataclass
class Part(InputPartition):
    file: str


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.version = options["path"].rstrip("/"), options.get("version")

    def partitions(self) -> list[Part]:
        known = versions(self.path)
        which = f"v{int(self.version):08d}" if self.version else (known[-1] if known else None)
        if which is None:
            return [Part("")]
        store, root = opened(f"{self.path}/{which}")
        with store.open_input_stream(f"{root}/files", compression=None) as body:
            return [Part(f"{root}/{name}") for name in json.loads(body.read())] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file:
            store, _ = opened(self.path)
            rest = b""
            with store.open_input_stream(partition.file, compression=None) as body:
                while piece := body.read(PIECE):
                    *lines, rest = (rest + piece).split(b"\n")
                    yield from ((line.decode(),) for line in lines)


class Document(DataSource):
    """Lines (``value``, JSON without line ends) of a document under ``path`` that is replaced as a whole.

    A write makes a draft, which becomes the next version in one move when all of its tasks have ended well, and is thrown
    away otherwise; a reader sees the last whole version, or the ``version`` that it asks for.
    """

    @classmethod
    def name(cls) -> str:
        return "versioned_document"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes ``paged_listing`` and ``versioned_document`` known to a session."""
    for source in (Listing, Document):
        spark.dataSource.register(source)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes ``rows`` (``key, content``) as a file each under ``folder``, whole or not at all; gives how many. A file is work
    whatever its bytes are, so rows are dealt over all cores."""

    def run(batches):
        store, root = opened(folder)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, body in zip(keys, batch.column(1), strict=True):
                at = f"{root}/{key}"
                parent, _, name = at.rpartition("/")
                store.create_dir(parent, recursive=True)
                draft = f"{parent}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(body.as_py() or b"")
                store.move(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], ["n"])

    return sum(r.n for r in spread(rows.select("key", "content"), "key").mapInArrow(run, "n long").collect())
