"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

Archives in the wild are often one gzip stream over the whole file, which can only be read from its start. The normaliser
inflates such a file once, in pieces, writes every record again as a gzip member of its own, and beside the archive a
sidecar index with one JSON line per record. With the index, any slice of an archive is a task of its own.

Files go through Arrow's file systems, so a folder can be local or in a store. A task writes to a name of its own and
moves the file into place when it is whole; only files that a finished task has reported are used.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import spare
from strandwork.session import broadcast_if_small, settled, shared_dir

PIECE = 1 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has the HTTP header of the page (with its length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a header block, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


class Inflated:
    """What a gzip file holds, whether of one member or many, read in pieces."""

    def __init__(self, raw):
        self.raw, self.gz, self.buffer, self.done = raw, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        data = self.gz.unconsumed_tail or self.gz.unused_data or self.raw.read(PIECE)
        if not data:
            if not self.gz.eof:
                raise EOFError("the gzip stream ends early")
            return False
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.buffer += self.gz.decompress(data, PIECE)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Through the next ``mark``; None at the end of the file."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("a record ends early")
                return None
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("a record ends early")
            out = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(out)
            if out:
                yield out


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def write_monolithic(records: DataFrame, folder: str, level: int = 6, roll_bytes: int = 1 << 26) -> DataFrame:
    """Writes ``page_id, url, payload (binary), refers_to, revisit`` as archives of one gzip stream each.

    A task begins another archive after ``roll_bytes`` of records. Gives ``archive, records`` for each.
    """

    def run(batches):
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        out, name, squeeze, held, count = None, "", None, 0, 0

        def close():
            out.write(squeeze.flush())
            out.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["archive", "records"])

        for batch in batches:
            for row in zip(*[c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)], strict=True):
                if out is None:
                    name, squeeze, held, count = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, wbits=31), 0, 0
                    out = store.open_output_stream(f"{root}/.{name}", compression=None)
                data = record(row[0], row[1], row[2].as_py(), row[3], row[4])
                out.write(squeeze.compress(data))
                held, count = held + len(data), count + 1
                if held >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = records.select(F.col("page_id").cast("long"), "url", "payload", F.col("refers_to").cast("long"), "revisit")
    return rows.mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites the archives named in ``archives`` (column ``archive``), found in ``source``, to ``target``.

    Each file is inflated once from its start to its end; every record becomes a member of its own; ``<archive>.idx``
    gets a line per record. Target names follow from source names, so a repeated task writes the same files again.
    """

    def run(batches):
        store, root = _file_system(source)
        to_store, to = _file_system(target)
        to_store.create_dir(to, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                tag, at, count = uuid.uuid4().hex, 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, to_store.open_output_stream(f"{to}/.{tag}", compression=None) as out, to_store.open_output_stream(f"{to}/.{tag}.idx") as index:
                    stream = Inflated(raw)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        head = head.lstrip(b"\r\n")
                        if not head:  # what ends the record before
                            continue
                        named = headers(head)
                        squeeze, length = zlib.compressobj(level, wbits=31), 0
                        for piece in chain([head], stream.pieces(int(named["content-length"])), [b"\r\n\r\n"]):
                            data = squeeze.compress(piece)
                            out.write(data)
                            length += len(data)
                        data = squeeze.flush()
                        out.write(data)
                        length += len(data)
                        line = {"archive": name, "offset": at, "length": length, "record_id": named.get("warc-record-id"), "record_type": named.get("warc-type"), "target_uri": named.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, count = at + length, count + 1
                for end in (".idx", ""):
                    to_store.move(f"{to}/.{tag}{end}", f"{to}/{name}{end}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["archive", "records"])

    return archives.select("archive").mapInArrow(run, "archive string, records long")


def read_index(spark, folder: str) -> DataFrame:
    """All sidecar indexes of a folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, folder: str, slice_bytes: int = 1 << 23, payloads: bool = False) -> DataFrame:
    """Reads the records that ``index`` lists, by offset; with ``payloads`` also the payload (null for a revisit).

    An archive is read in slices of about ``slice_bytes``. A response whose payload differs from its digest is an error.
    """

    def run(batches):
        store, root = _file_system(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                head, _, block = zlib.decompress(file.read(length), 31).partition(b"\r\n\r\n")
                named = headers(head)
                http, _, payload = block[: int(named["content-length"])].partition(b"\r\n\r\n")
                digest, kind = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"]
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
                row = (_page(named["warc-record-id"]), int(headers(http)["content-length"]), digest, kind, _page(named.get("warc-refers-to")))
                rows.append((*row, payload if kind == "response" else None) if payloads else row)
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if payloads else 5]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    # rows of the index are small, what they stand for is not: the number of tasks follows the bytes to read
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // slice_bytes
    sliced = index.withColumn("_slice", F.floor(F.col("offset") / slice_bytes))
    spread = sliced.repartition(tasks, "archive", "_slice").sortWithinPartitions("archive", "offset")
    return spread.select("archive", "offset", "length").mapInArrow(run, READ + ", payload binary" * payloads)


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``payload`` (UTF-8, null is empty), ``revisit`` and ``refers_to`` to ``pages``.

    Of equal payloads of ``min_bytes`` or more the one with the largest id is the response, and the others revisit it;
    rows that repeat the largest id are all responses, and so are payloads whose pages have no id. Equal payloads meet
    as one entry per slot of ids, so a payload that a third of all pages share loads no single task. An empty table gives
    an empty result. Columns with the added names are replaced; all others stay.
    """
    p = spare(pages)
    slots = max(64, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    slot = F.pmod(F.xxhash64(F.col(page_id)), F.lit(slots))
    keys = [f"{p}{k}" for k in ("slot", "digest", "size")]
    digest, size = F.sha1("payload"), F.octet_length("payload")
    keyed = pages.withColumn("payload", body).withColumns(dict(zip(keys, (slot, digest, size), strict=True)))
    runs = settled(keyed.groupBy(*keys).agg(F.max(page_id).alias("last"), F.count("*").alias("n")))
    groups = runs.groupBy(*keys[1:]).agg(F.max("last").alias(f"{p}keep"), F.sum("n").alias(f"{p}copies")).where((F.col(f"{p}copies") > 1) & (F.col(keys[2]) >= min_bytes))
    back = runs.select(*keys).join(groups, list(keys[1:]))
    found = keyed.join(broadcast_if_small(back), keys, "left")
    keep = F.col(f"{p}keep")
    revisit = keep.isNotNull() & ~F.col(page_id).eqNullSafe(keep)
    return found.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, keep)).drop(*keys, f"{p}keep", f"{p}copies")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (``page_id, url, html``) as monolithic archives under ``folder``, normalises and indexes them,
    and gives the records read back through the index. Null html is an empty payload, null ids are written as such, equal
    rows are records of their own, and a payload of any length is written and inflated in pieces but held whole when it
    is read back. An empty table gives an empty result; other columns are not written."""
    spark = pages.sparkSession
    raw = settled(write_monolithic(with_revisits(pages), f"{folder}/raw"))
    archives = raw.count()
    if not archives:
        return spark.createDataFrame([], READ)
    settled(normalise(raw.repartition(archives), f"{folder}/raw", f"{folder}/normalised"))  # an archive is a task
    return read_records(read_index(spark, f"{folder}/normalised"), f"{folder}/normalised")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back, see ``round_trip``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages, f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex, 1 + 5 * CAST(floor(i / 4) AS INT), 5))::BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""
