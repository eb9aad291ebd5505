"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own.  Index lines are
sorted by reversed-host URL key (then page) and cut into compressed blocks;
each index file ends with a sparse directory of its blocks and a footer with
the directory's place.  A search goes by the files' first keys, reads one
directory, bisects it, and reads one block; the record follows by a range read.

Files are written by executors to the shared folder through the file system
that its URI names.  Each attempt of a task writes a file of its own and only
files named by the finished attempt's rows are read, so lost executors leave
nothing but unused files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_uri, filesystem, read_texts, shared_dir, written

#: Lines of an index block; bytes between two records that are still read over; bytes of a read.
BLOCK_LINES, GAP, READ = 1000, 1 << 16, 8 << 20
#: Bytes of records that a task reads.
TASK_BYTES = 64 << 20
_MAGIC = b"QIX1"


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query: com,example,www)/a?b.  What can't be read as a URL is its own key."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port = "" if port in (None, 80 if u.scheme == "http" else 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _header(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}:{row}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in h.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _write_udf(folder: str):
    """(row, page, url, payload, revisit, refers_to) -> (key, page, row, file, offset, length); a file for each task."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows = []
                for row, page, payload, revisit, refers, url in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), read_texts(batch.column(2)), strict=True):
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    packed = _gzip(record(page, row, url, payload, digest, refers, revisit))
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(packed)
                    rows.append((url_key(url), page, row, name, at, len(packed)))
                    at += len(packed)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page", "row", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _rank(key: str, page: int | None, row: int) -> tuple[bytes, int, int, int]:
    """The order of the index: keys by bytes, null pages first."""
    return key.encode("utf-8", "surrogatepass"), page is not None, page or 0, row


def _index_udf(folder: str):
    """Sorted captures -> (file, first key, page and row, captures); one index file for each task."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, out, n, first = f"{uuid.uuid4().hex}.idx", 0, None, 0, None
        directory: list[tuple[list, int, int]] = []
        lines: list[list] = []

        def block() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(packed)
            directory.append((lines[0][:3], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                first = first or line[:3]
                lines.append(list(line))
                n += 1
                if len(lines) == BLOCK_LINES:
                    block()
        if n:
            if lines:
                block()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + struct.pack("<QQ", at, len(packed)) + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([first[2]], pa.int64()), pa.array([n], pa.int64())], ["file", "key", "page", "row", "n"])

    return run


class CaptureIndex:
    """Searches index files; holds one directory and one block at a time."""

    def __init__(self, folder: str, files: list[tuple[str, str, int | None, int]]):
        self.fs, self.base = filesystem(folder)
        files = sorted(files, key=lambda f: _rank(*f[1:]))
        self.files, self.firsts = [f[0] for f in files], [_rank(*f[1:]) for f in files]
        self.open = self.block = None

    def _range(self, name: str, at: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(n, at)

    def find(self, key: str, page: int | None, row: int) -> list | None:
        """The capture's index line, or None."""
        want = _rank(key, page, row)
        k = bisect.bisect_right(self.firsts, want) - 1
        if k < 0:
            return None
        if self.open is None or self.open[0] != k:
            with self.fs.open_input_file(f"{self.base}/{self.files[k]}") as f:
                at, n = struct.unpack("<QQ", f.read_at(20, f.size() - 20)[:16])
                directory = json.loads(zlib.decompress(f.read_at(n, at)))
            self.open, self.block = (k, directory, [_rank(*d[0]) for d in directory]), None
        _, directory, firsts = self.open
        b = bisect.bisect_right(firsts, want) - 1
        if self.block is None or self.block[0] != (k, b):
            lines = [json.loads(x) for x in zlib.decompress(self._range(self.files[k], *directory[b][1:])).decode().split("\n")]
            self.block = (k, b), lines, [_rank(*x[:3]) for x in lines]
        i = bisect.bisect_left(self.block[2], want)
        return self.block[1][i] if i < len(self.block[2]) and self.block[2][i] == want else None


def _find_udf(folder: str, files):
    def run(batches):
        index = CaptureIndex(folder, files.value)
        for batch in batches:
            found = [index.find(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*[(f[3], f[4], f[5]) for f in found if f is not None], strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])

    return run


def _read_udf(folder: str):
    """Places sorted by file and offset -> records; neighbouring ranges are read at once."""
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    number = lambda urn: int(x) if (x := urn.strip("<>").split(":")[2]) else None

    def run(batches):
        fs, base = filesystem(folder)
        name, source = None, None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(places):
                file, start, n = places[i]
                j, end = i + 1, start + n
                while j < len(places) and places[j][0] == file and start <= places[j][1] <= end + GAP and places[j][1] - start < READ:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                data = source.read_at(end - start, start)
                rows = []
                for _, at, m in places[i:j]:
                    warc, http, payload = parse_record(zlib.decompress(data[at - start : at - start + m], 31))
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    revisit = warc["warc-type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise OSError(f"{file}: the payload at {at} has another digest")
                    rows.append((number(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], number(warc["warc-refers-to"]) if revisit else None, warc["warc-target-uri"], None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                i = j
        if source is not None:
            source.close()

    return run


class Archive:
    """Written records and their index: ``captures`` (key, page, row, file, offset, length), index files, folder.

    ``tasks`` share the look-ups and reads, by default as many as Spark's shuffle
    partitions, or more for archives of over ``TASK_BYTES`` in each.  The number is
    given to Spark, which else would merge tasks by the few bytes of a place, where
    each stands for the bytes of a record.
    """

    def __init__(self, folder: str, captures: DataFrame, files: list[tuple[str, str, int | None, int]], n_bytes: int):
        self.folder, self.captures, self.files = folder, captures, files
        self.tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """(file, offset, length) for rows (key, page, row) of ``wanted``, by search in the index.

        Rows are dealt by key range, so that each task passes through its part of the index once.
        """
        files = wanted.sparkSession.sparkContext.broadcast(self.files)  # one entry for each index file
        near = wanted.select("key", "page", "row").repartitionByRange(self.tasks, "key", "page", "row").sortWithinPartitions("key", "page", "row")
        return near.mapInArrow(_find_udf(f"{self.folder}/index", files), "file string, offset long, length long")

    def read(self, places: DataFrame, with_payload: bool = True) -> DataFrame:
        """(page, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the records at ``places``.

        Null payload: a revisit.  A page without an id has a null page.
        """
        order = ["file", "offset"]
        out = places.repartitionByRange(self.tasks, *order).sortWithinPartitions(*order).mapInArrow(
            _read_udf(f"{self.folder}/warc"), "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
        return out if with_payload else out.drop("payload")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> Archive:
    """Write every page as a record, and the index, under ``spark.checkpoint.dir``.

    Null html is an empty payload, malformed UTF-8 stays as it is.  Of pages with
    equal payloads of at least ``min_revisit_bytes`` bytes that with the largest id (null
    ranks lowest) is a response, those of other ids revisit it; repeated rows of
    that id are all responses.  Null and unreadable urls have keys of their own.
    A folder in a file system that can't be written to raises ValueError at once.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    arrow_uri(folder)
    html = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").alias("url"), html.alias("payload"))
    digests = written(src.select("page", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("n")), f"{folder}/digests")
    long_ = digests.where(F.col("n") >= min_revisit_bytes)
    groups = long_.groupBy("sha").agg(F.max("page").alias("best"), F.count("*").alias("c")).where("c > 1").select(F.concat("sha", F.lit(b"")).alias("g"), "best")
    revisits = long_.join(groups, F.col("sha") == F.col("g")).where(~F.col("page").eqNullSafe(F.col("best"))).select(F.col("page").alias("r_page"), F.col("sha").alias("r_sha"), "best").distinct()
    revisits = written(revisits, f"{folder}/revisits")
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    both = src.join(revisits, F.col("page").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left")
    both = both.select(F.monotonically_increasing_id().alias("row"), "page", "url", "payload", F.col("r_sha").isNotNull().alias("revisit"), "best")
    captures = both.mapInArrow(_write_udf(f"{folder}/warc"), "key string, page long, row long, file string, offset long, length long")
    captures = written(captures, f"{folder}/captures")
    order = ["key", "page", "row"]
    index = captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "file", "offset", "length")
    files = index.mapInArrow(_index_udf(f"{folder}/index"), "file string, key string, page long, row long, n long")
    n_bytes = captures.agg(F.sum("length")).first()[0] or 0
    return Archive(folder, captures, [(r.file, r.key, r.page, r.row) for r in files.collect()], n_bytes)  # one row for each task
