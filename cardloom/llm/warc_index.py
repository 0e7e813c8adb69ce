"""WARC archives with a two-level capture index.

``write_archives`` writes one record per capture into files in the shared folder, each record a gzip
member of its own; payloads of at least REVISIT_BYTES that occur again become revisit records that
refer to the capture with the smallest id. ``build_index`` sorts the captures by reversed-host key,
writes them as compressed blocks of BLOCK_LINES lines into block files, and returns the sparse
directory: the first key of each block with the block's place. ``look_up`` finds captures by binary
search in the directory, reads the range of the one block, searches in it, and reads the range of the
record from its archive. Files go through pyarrow's file systems, so any store that it knows serves;
a task writes under a name of its own, and only files of tasks that ended well are listed.

Null html is an empty payload; null URLs have an empty key. Repeated page ids are separate captures
(with equal payloads the first by id is the response; among equal ids one of them). A null page id
is never referred to unless all copies have none.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import new_path, stage

REVISIT_BYTES = 100
BLOCK_LINES = 1024
FILE_BYTES = 64 << 20
DIRECTORY_BYTES = 256 << 20  # part of the directory that a task gets
DATE = "2020-01-01T00:00:00Z"
END = b"\r\n\r\n"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reversed_host(url: str | None) -> str:
    """Sort key of a URL: com,example,www)/path?query, lower case in the host, without scheme and fragment.

    Tabs, line ends and backslashes are escaped, so a key fits a line of an index block.
    """
    m = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return _escape(url or "")
    host = m[1].rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    return _escape(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record: a response, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + payload + END


def parse(data: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    size = int(fields["Content-Length"])
    if len(rest) != size + len(END):
        raise ValueError("record is cut")
    return fields | {"payload": rest[:size]}


def _write_batches(batches, folder: str):
    system, base = _file_system(folder)
    part = TaskContext.get().partitionId()
    out, name, at = None, "", 0
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            payload = (row["html"] or "").encode("utf-8", "surrogatepass")
            data = gzip.compress(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]), 1, mtime=0)
            out.write(data)
            rows.append((row["page_id"], reversed_host(row["url"]), name, at, len(data)))
            at += len(data)
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "key", "file", "offset", "length"])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of (page_id, url, html); returns (page_id, key, file, offset, length)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    work = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    again = work.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.filter("n > 1").select(F.col("digest").alias("_digest"), "first")
    work = work.join(again, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    work = work.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    written = work.mapInArrow(partial(_write_batches, folder=folder), "page_id bigint, key string, file string, offset bigint, length bigint")
    return stage(written, "captures")


def _line(key: str, page_id, file: str, offset: int, length: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), file, str(offset), str(length)))


def _escape(key: str) -> str:
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def _index_batches(batches, folder: str):
    system, base = _file_system(folder)
    part = TaskContext.get().partitionId()
    name = f"index-{part:05d}-{uuid.uuid4().hex}.cdx"
    out, at, held, blocks = None, 0, [], []

    def flush():
        nonlocal out, at
        if out is None:
            out = system.open_output_stream(f"{base}/{name}", compression=None)
        data = zlib.compress("\n".join(_line(*r) for r in held).encode("utf-8", "surrogatepass"), 6)
        out.write(data)
        blocks.append((held[0][0], name, at, len(data), len(held)))
        at += len(data)
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            if len(held) == BLOCK_LINES:
                flush()
    if held:
        flush()
    if out is not None:
        out.close()
    cols = list(zip(*blocks, strict=True)) or [()] * 5
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["first_key", "file", "offset", "length", "lines"])


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the block files; returns the directory (first_key, file, offset, length, lines)."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    ordered = ordered.select("key", "page_id", "file", "offset", "length")
    return stage(ordered.mapInArrow(partial(_index_batches, folder=folder), "first_key string, file string, offset bigint, length bigint, lines bigint"), "directory")


def _order(key: str) -> bytes:
    """Keys compare by their bytes, as Spark sorts strings."""
    return key.encode("utf-8", "surrogatepass")


def _find_batches(batches, folder: str, directory: list[tuple], low: bytes | None, high: bytes | None):
    """Captures of the wanted keys that lie in the part [low, high) of the directory."""
    system, base = _file_system(folder)
    first = [_order(d[0]) for d in directory]
    cached, lines, keys = -1, [], []
    seen: tuple[str, list] = ("", [])
    for batch in batches:
        rows = []
        for key in batch.column(0).to_pylist():
            wanted = _order(key)
            # captures of one key may span blocks; they begin in the last block that starts below it
            b = max(0, bisect.bisect_left(first, wanted) - 1)
            found = []
            while b < len(directory) and first[b] <= wanted:
                if cached != b:
                    _, file, offset, length, _ = directory[b]
                    with system.open_input_file(f"{base}/{file}") as f:
                        data = zlib.decompress(f.read_at(length, offset)).decode("utf-8", "surrogatepass")
                    lines = data.split("\n")
                    keys = [_order(x.partition("\t")[0]) for x in lines]
                    cached = b
                i = bisect.bisect_left(keys, wanted)
                while i < len(keys) and keys[i] == wanted:
                    found.append(lines[i].split("\t")[1:])
                    i += 1
                b += 1
            rows += [(key, int(p) if p else None, f, int(o), int(n)) for p, f, o, n in found]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "page_id", "file", "offset", "length"])


def _read_batches(batches, folder: str):
    system, base = _file_system(folder)
    name, file = "", None
    for batch in batches:
        rows = []
        for key, path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != name:
                if file is not None:
                    file.close()
                name, file = path, system.open_input_file(f"{base}/{path}")
            got = parse(file.read_at(length, offset))
            payload, kind = got["payload"], got["WARC-Type"]
            digest = got["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {path} at {offset} does not fit its digest")
            page, refers = got["X-Page-Id"], got.get("X-Refers-To-Page")
            size = len(payload) if kind == "response" else int(got["X-Payload-Length"])
            rows.append((int(page) if page else None, key, size, digest, kind, int(refers) if refers else None, payload))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "key", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _without_payload(batches, folder: str):
    for batch in _read_batches(batches, folder):
        yield batch.select(batch.schema.names[:-1])


def look_up(keys: DataFrame, directory: DataFrame, archives: str, index: str, payload: bool = True) -> DataFrame:
    """Records of all captures of the distinct ``keys`` (column key), through the index.

    The directory has one entry per BLOCK_LINES captures. It is sent to the tasks in parts of at most
    DIRECTORY_BYTES, each searched by the keys of its range.
    """
    wanted = keys.select("key").distinct()
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = directory.orderBy("first_key", "file", "offset").toLocalIterator()
    found, part, size = None, [], 0
    schema = "key string, page_id bigint, file string, offset bigint, length bigint"

    def search(found, part, low, high):
        own = wanted
        if low is not None:
            own = own.filter(F.col("key") >= low)
        if high is not None:
            own = own.filter(F.col("key") <= high)
        own = own.repartitionByRange(n, "key").sortWithinPartitions("key")
        got = own.mapInArrow(partial(_find_batches, folder=index, directory=part, low=None, high=None), schema)
        return got if found is None else found.unionAll(got)

    low = None
    for e in entries:
        part.append(tuple(e))
        size += len(e["first_key"]) + 200
        if size > DIRECTORY_BYTES:
            # a key that starts the next part may begin in this one: both parts search it
            found = search(found, part[:-1], low, part[-1][0])
            low, part, size = part[-1][0], part[-1:], 0
    found = search(found, part, low, None)
    # records of one archive are read by one task, in the order of the file
    found = found.repartition(n, "file").sortWithinPartitions("file", "offset").select("key", "file", "offset", "length")
    schema = "page_id bigint, key string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if payload:
        return found.mapInArrow(partial(_read_batches, folder=archives), schema + ", payload binary")
    return found.mapInArrow(partial(_without_payload, folder=archives), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages, index them, and read every record back through the index."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    for path in (archives, index):
        system, base = _file_system(path)
        system.create_dir(base, recursive=True)
    captures = write_archives(pages, archives)
    directory = build_index(captures, index)
    return look_up(captures, directory, archives, index, payload=False)
