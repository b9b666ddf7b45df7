"""WARC archives and their index, merged from locally sorted capture runs.

``write_archives`` gives every page a gzip member in an archive of its task (``response``, or ``revisit`` without payload
where a page with a larger id has the same payload), and gives the files' names.  ``read_archives`` parses archives back
and checks digests.  ``merge_index`` turns captures into globally ordered capture histories by an external merge: each task
sorts ``RUN_ROWS`` captures at a time and writes them as a run, in chunks of ``CHUNK_ROWS``, to the shared folder; only the
chunks' places and first and last keys go through Spark.  A range of (URL key, timestamp, id) is one task, which reads the
chunks that reach into it and merges their runs with a tree of losers.  A task holds one chunk of each run, ``FAN_IN`` of
them at most: with more runs, groups of ``FAN_IN`` are first merged to longer runs, range by range.

Null html is an empty payload; equal payloads are equal by SHA-1 and length.  A null url has the empty key.  Rows that
repeat the largest page id of a payload are all responses; a null page id is one too.  Archive names hold the task attempt, and only names that a finished task
returned are read, so a task that runs twice leaves a file that nothing reads.
"""

from __future__ import annotations

import base64
import bisect
import calendar
import gzip
import hashlib
import io
import itertools
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, small, stash, table

FIRST_CAPTURE = 1_600_000_000
RUN_ROWS, CHUNK_ROWS, FAN_IN = 50_000, 1_000, 128
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, captured_at long, archive string, record_offset long"
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in CAPTURES.split(", ")]


def url_key(url: Column) -> Column:
    """Sort-friendly key of a URL: lower-case host with its labels reversed, then path and query, without scheme, ``www.``, port and fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"(?i)^www\.|:\d*$", ""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, urlkey, and refers_to (null for a response)."""
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # one row for each payload that occurs more than once; partial counts meet hot payloads before the exchange
    twins = p.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1").drop("n")
    return p.join(small(stash(twins, "twins")), ["sha", "size"], "left").select(
        "page_id", "url", "payload", url_key(F.col("url")).alias("urlkey"),
        F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def _record(kind: str, page: int, url: str, key: str, at: int, payload: bytes, refers_to: int | None) -> bytes:
    body = b"" if kind == "revisit" else payload
    one_line = lambda s: re.sub(r"[\r\n]+", " ", s)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime(at))}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}", f"X-Url-Key: {one_line(key)}",
        *([f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_archives(decided: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write an archive for each task of ``decided`` and give (archive, records), as a table that is already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, payload, key, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    kind = "response" if refers_to is None else "revisit"
                    at = FIRST_CAPTURE + (page or 0) % (1 << 31)
                    out.write(gzip.compress(_record(kind, page, url or "", key, at, payload, refers_to), level, mtime=0))
                    n += 1
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    return stash(decided.select("page_id", "url", "payload", "urlkey", "refers_to").mapInArrow(run, "archive string, records long"), "archives")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each gzip member, one member in memory at a time."""
    pending, offset = b"", 0
    while True:
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not pending:
                pending = stream.read(1 << 20)
                if not pending:
                    if parts or used:
                        raise ValueError("an archive ends inside a record")
                    return
            parts.append(member.decompress(pending))
            used += len(pending) - len(member.unused_data)
            pending = member.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
        yield offset, headers, rest[: int(headers["content-length"])]
        offset += used


def capture(archive: str, offset: int, h: dict[str, str], block: bytes) -> tuple:
    """The row of a record; an error if its digest or length isn't that of its block."""
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (base32_sha1(block) != digest or len(block) != int(h["x-payload-length"])):
        raise ValueError(f"{archive}: the record at {offset} doesn't match its digest")
    page = None if h["x-page-id"] == "None" else int(h["x-page-id"])
    refers = int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None
    return page, int(h["x-payload-length"]), digest, h["warc-type"], refers, h["x-url-key"], calendar.timegm(time.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ")), archive, offset


def _batches(rows: Iterator[tuple], size: int = 10_000, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Batches of captures, each row with further columns of longs."""
    types, names = [*_TYPES, *[pa.int64()] * len(more)], [*_NAMES, *more]
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``CAPTURES``, one row for each record, in the archives' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    yield from _batches(capture(name, *r) for r in records(stream))

    return archives.select("archive").mapInArrow(run, CAPTURES)


def sort_key(row: tuple) -> bytes:
    """Bytes that sort like (urlkey, captured_at, page_id), null first."""
    page = b"\0" if row[0] is None else b"\1" + struct.pack(">Q", row[0] + (1 << 63))
    return row[5].encode().replace(b"\0", b"\0\1") + b"\0\0" + struct.pack(">Q", row[6] + (1 << 63)) + page


def order(row: tuple) -> tuple:
    return sort_key(row), row[7], row[8]


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, node 0 the winner; each step replays one path to the root."""

    def __init__(self, runs: list[Iterator], key=order):
        self.key, self.runs = key, runs
        self.k = max(1, len(runs))
        self.heads = [self._next(r) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _next(self, run: Iterator):
        for row in run:
            return self.key(row), row
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) >> 1
        while node:
            if self.tree[node] == -1:  # still being built: wait here for the other side
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node >>= 1
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head[1]
            self.heads[w] = self._next(self.runs[w])
            self._replay(w)


_CHUNKS = "run long, path string, start long, length long, low binary, high binary"


def _write_run(folder: str, rows: Iterator[tuple], run: int, chunk_rows: int) -> Iterator[tuple]:
    """Write sorted rows as a file of chunks and give their rows of ``_CHUNKS``."""
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    name, at = f"run-{uuid.uuid4().hex}", 0
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        for batch in _batches(rows, chunk_rows):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            data = sink.getvalue()
            out.write(data)
            first, last = (tuple(c[k].as_py() for c in batch.columns) for k in (0, -1))
            yield run, name, at, len(data), sort_key(first), sort_key(last)
            at += len(data)


def _read_run(folder: str, chunks: list[tuple[str, int, int]], low: bytes, high: bytes | None) -> Iterator[tuple]:
    """Rows of a run's chunks (path, start, length) with low <= key < high, one chunk in memory at a time."""
    fs, path = _store(folder)
    for name, parts in itertools.groupby(chunks, key=lambda c: c[0]):
        with fs.open_input_file(f"{path}/{name}") as file:
            for _, start, length in parts:
                file.seek(start)
                for batch in pa.ipc.open_stream(file.read(length)):
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if low <= (key := sort_key(row)) and (high is None or key < high):
                            yield row


def _as_chunks(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    for some in itertools.batched(rows, 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=["run", "path", "start", "length", "low", "high"])


def sorted_runs(captures: DataFrame, folder: str, run_rows: int = RUN_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Write each task's captures in sorted runs and give their chunks; a run's number is its task's, with a count in the low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for k, some in enumerate(itertools.batched(rows, run_rows)):
            yield from _as_chunks(_write_run(folder, iter(sorted(some, key=order)), first + k, chunk_rows))

    return captures.select(*_NAMES).mapInArrow(run, _CHUNKS)


def _ranges(chunks: DataFrame, most: int, runs: int) -> list[bytes]:
    """Starts of at most ``most`` ranges after the first, with about as many chunks each; not so many that a chunk reaches into several."""
    n = min(most, max(1, 2 * chunks.count() // runs))
    parted = chunks.select("low").repartitionByRange(n, "low").groupBy(F.spark_partition_id().alias("k")).agg(F.min("low").alias("low"))
    return sorted(bytes(r["low"]) for r in parted.collect())[1:]  # one key for each range


def _by_range(chunks: DataFrame, groups: DataFrame, bounds: list[bytes]) -> DataFrame:
    """Each chunk once for each range that it reaches into, rows of a (range, grp) together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            spans = [range(bisect.bisect_right(bounds, a), bisect.bisect_right(bounds, b) + 1) for a, b in zip(low, high, strict=True)]
            at = pa.array([i for i, x in enumerate(spans) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r for x in spans for r in x], pa.int64()), *(batch.column(k).take(at) for k in ("grp", "run", "path", "start", "length", "low"))], names=["r", "grp", "run", "path", "start", "length", "low"])

    spread = chunks.join(small(groups), "run").mapInArrow(run, "r long, grp long, run long, path string, start long, length long, low binary")
    return spread.repartitionByRange(len(bounds) + 1, "r", "grp").sortWithinPartitions("r", "grp", "run", "low", "path", "start")


def _merged(batches: Iterator[pa.RecordBatch], folder: str, bounds: list[bytes]) -> Iterator[tuple[int, int, Iterator[tuple]]]:
    """(range, group, merged rows) of what ``_by_range`` sends to a task."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True))
    for (r, grp), some in itertools.groupby(rows, key=lambda x: x[:2]):
        low, high = bounds[r - 1] if r else b"", bounds[r] if r < len(bounds) else None
        runs = [_read_run(folder, [x[3:] for x in own], low, high) for _, own in itertools.groupby(some, key=lambda x: x[2])]
        yield r, grp, iter(LoserTree(runs))


def merge_index(captures: DataFrame, ranges: int | None = None, run_rows: int = RUN_ROWS, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The captures in global order of (urlkey, captured_at, page_id), with ``position``: it grows strictly in that order
    (range number << 33, plus the number in the range)."""
    n, folder = ranges or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), fresh_path(captures.sparkSession, "runs")
    chunks = stash(sorted_runs(captures, folder, run_rows, chunk_rows), "chunks")
    while True:
        runs = chunks.select("run").distinct()
        k = runs.count()
        last = k <= fan_in
        bounds = _ranges(chunks, n, max(1, k))
        # a row for each run of RUN_ROWS captures or more: small enough for one window
        number = F.floor((F.row_number().over(Window.orderBy("run")) - 1) / fan_in)
        sent = _by_range(chunks, runs.withColumn("grp", F.lit(0).cast("long") if last else number.cast("long")), bounds)
        if last:
            break

        def longer(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[pa.RecordBatch]:
            for _, grp, rows in _merged(batches, folder, bounds):
                yield from _as_chunks(_write_run(folder, rows, grp, chunk_rows))

        chunks = stash(sent.mapInArrow(longer, _CHUNKS), "chunks")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _, rows in _merged(batches, folder, bounds):
            yield from _batches(((*row, (r << 33) + k) for k, row in enumerate(rows)), more=("position",))

    return sent.mapInArrow(final, CAPTURES + ", position long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write_archives(decide(table(spark, sf_dir, "pages")), folder)
    return merge_index(read_archives(archives.repartition(max(1, archives.count())), folder)).drop("archive", "record_offset")


QUERIES = {"op8_warc": op8_warc}
SQL: dict[str, str] = {}
