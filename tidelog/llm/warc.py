"""WARC archives: writing, reading back, and one ordered index of all captures.

Pages become WARC/1.1 records, each a gzip member of its own; a page whose payload
equals that of an earlier page becomes a revisit. Reading an archive verifies payload
digests and leaves its captures as a locally sorted run, a file of small batches. Runs
are merged externally: a loser tree streams them from their files, a batch of each at a
time. While there are more runs than a merge may open, groups of them are merged into
longer ones. The key space (URL key, timestamp, page id) is split into ranges, of which
each task reads its slice of every run by a binary search, so the captures of every URL
come in order of time, over range after range. The key holds more than the URL, so a URL
or host with very many captures spreads over ranges.

Archives and runs are written under the shared folder with the attempt of their task in
their names, and count only if the manifest that the task returns lists them: a task that
runs twice, or in two places at once, leaves files that nobody reads.

Defined results: a null html is the empty payload; empty payloads equal one another; a
payload of any length is one record. Of repeated page ids the first in the scan counts
as smaller; a null page id is larger than any other; a null url has an empty key. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import arrow_schema, fresh_path, frugal, only, row_key, shuffle_parts, small_batches, staged, steady
from tidelog.llm.exact_dedup import BROADCAST_ROWS

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Compressed bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 32 << 20
GZIP_LEVEL = 4
#: Captures of a range at most and at least, about; of a batch of a run.
RANGE_ROWS, LEAST_RANGE_ROWS, RUN_BATCH = 1_000_000, 2000, 128
#: Runs that a merge opens at once, about; sampled keys for each range.
FAN_IN, RANGE_KEYS = 256, 64
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RUNS = "range int, run string, captures long"
INDEX = (
    "url_key string, timestamp string, page_id long, row long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, archive string, offset long, length long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and sorted query; no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    default = {"http": 80, "https": 443}.get(parts.scheme)
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{where}){parts.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


def capture_time(page_id: int | None) -> str:
    """Pages carry no time; their ids stand for seconds, within a century."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def name_of(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{row}>"


def parse_name(name: str) -> tuple[int | None, int]:
    _, _, page, row = name.strip("<>").split(":")
    return (None if page == "null" else int(page)), int(row)


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(row: int, page_id: int | None, url: str | None, payload: bytes, first: tuple[int | None, int] | None) -> bytes:
    """A response, or a revisit of the page that came first."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": name_of(page_id, row),
        "WARC-Date": capture_time(page_id),
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if first is None:
        return record("response", headers, head + payload)
    return record("revisit", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": name_of(*first)}, head)


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an open file."""
    offset, left = 0, b""
    while True:
        inflate, content, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            data, left = left or stream.read(size), b""
            if not data:
                if used:
                    raise ValueError(f"archive ends within the record at byte {offset}")
                return
            content.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            left = inflate.unused_data
        yield offset, used, b"".join(content)
        offset += used


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("record is cut short")
    return headers, block


def http_payload(block: bytes) -> tuple[int, bytes]:
    """(declared length, payload) of an HTTP response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return int(re.search(rb"(?i)content-length: *(\d+)", head)[1]), payload


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(row, first_page, first_row) of the pages whose payload an earlier page has."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digests = only(pages, "page_id", "html").select(row_key().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    digests = digests.where(F.col("bytes") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first")
    copied = staged(digests.groupBy("digest", "bytes").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first"), "copied")
    return digests.join(copied, ["digest", "bytes"]).where("row <> first.row").select("row", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes every page to archives in `folder` and returns (path, records, bytes)."""
    small_batches(pages.sparkSession)
    pages = steady(pages)
    later = staged(revisits(pages, least_bytes).withColumnRenamed("row", "r"), "revisits")
    small = later.count() <= BROADCAST_ROWS
    rows = only(pages, "page_id", "url", "html").select(row_key().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    planned = rows.join(F.broadcast(later) if small else later, rows.row == later.r, "left").select("row", "page_id", "url", "html", "first_page", "first_row")
    out = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        context = TaskContext.get()
        part, attempt, number = context.partitionId(), context.taskAttemptId(), 0
        stream = name = None
        count = size = 0

        def close() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], schema=out)

        for batch in batches:
            for r in batch.to_pylist():
                if stream is None:
                    name = f"pages-{part:06d}-{attempt}-{number:04d}.warc.gz"
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:archive:{name}>", "WARC-Date": capture_time(0), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    stream.write(info)
                    count, size, number = 0, len(info), number + 1
                first = None if r["first_row"] is None else (r["first_page"], r["first_row"])
                data = page_record(r["row"], r["page_id"], r["url"], (r["html"] or "").encode(), first)
                stream.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return staged(planned.mapInArrow(frugal(run), MANIFEST), "manifest")


def order_of(r: dict) -> tuple:
    return r["url_key"], r["timestamp"], r["page_id"] is None, r["page_id"] or 0, r["row"]


def read_run(stream, name: str) -> list[dict]:
    """The captures of one archive, checked and sorted."""
    out = []
    for offset, length, content in members(stream):
        headers, block = parsed(content)
        if headers["warc-type"] not in ("response", "revisit"):
            continue
        size, payload = http_payload(block)
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"{name}: the payload at byte {offset} does not have its digest")
        page, row = parse_name(headers["warc-record-id"])
        refers = parse_name(headers["warc-refers-to"])[0] if "warc-refers-to" in headers else None
        out.append({
            "url_key": url_key(headers.get("warc-target-uri")), "timestamp": re.sub(r"\D", "", headers["warc-date"]), "page_id": page, "row": row,
            "record_type": headers["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": refers, "archive": name, "offset": offset, "length": length,
        })
    return sorted(out, key=order_of)


def write_run(store: fs.FileSystem, path: str, rows: Iterable[dict], schema: pa.Schema) -> int:
    """Writes captures in batches and returns how many there are."""
    count = 0
    with store.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, schema) as writer:
        for batch in itertools.batched(rows, RUN_BATCH):
            writer.write_batch(pa.RecordBatch.from_pylist(list(batch), schema=schema))
            count += len(batch)
    return count


def slice_of(store: fs.FileSystem, path: str, low: tuple | None, high: tuple | None) -> Iterator[dict]:
    """The captures of a run with low <= key < high, batch by batch; None is unbounded."""
    with store.open_input_file(path) as file:
        reader = pa.ipc.open_file(file)
        first = lambda i: order_of(reader.get_batch(i).slice(0, 1).to_pylist()[0])
        batches = range(reader.num_record_batches)
        begin = 0 if low is None else max(bisect.bisect_left(batches, low, key=first) - 1, 0)
        for i in batches[begin:]:
            for r in reader.get_batch(i).to_pylist():
                key = order_of(r)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield r


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The locally sorted run of each listed archive, as a file: (range, run, captures);
    range -1 is the whole key space."""
    out, index = arrow_schema(RUNS), arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = read_run(stream, name)
                made = f"{name}.{attempt}.run"
                yield pa.RecordBatch.from_pylist([{"range": -1, "run": made, "captures": write_run(store, f"{root}/{made}", rows, index)}], schema=out)

    parts = max(shuffle_parts(manifest.sparkSession), 1)
    return staged(manifest.select("path").repartition(parts).mapInArrow(frugal(run), RUNS), "runs")


class LoserTree:
    """Merges sorted runs. Inner nodes hold the run that lost there; the winner of the
    whole is replayed from its leaf to the root when it is taken."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self.pull(r) for r in self.runs]
        self.losers = [-1] * max(len(runs), 1)
        self.winner = self.build(1) if runs else -1

    def pull(self, run: Iterator) -> tuple:
        """(0, key, item), or (1,) where the run has ended, which loses to all else."""
        for item in run:
            return (0, self.key(item), item)
        return (1,)

    def beats(self, a: int, b: int) -> bool:
        """Ties go to the run that was named first, so the merge is stable."""
        return (self.heads[a][:2], a) < (self.heads[b][:2], b)

    def build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self.build(2 * node), self.build(2 * node + 1)
        winner, loser = (a, b) if self.beats(a, b) else (b, a)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.heads[self.winner][0] == 0:
            run = self.winner
            yield self.heads[run][2]
            self.heads[run] = self.pull(self.runs[run])
            node = (run + k) // 2
            while node:
                if self.beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def range_bounds(runs: DataFrame, folder: str, parts: int, captures: int) -> list[tuple]:
    """Keys that split the captures into about `parts` ranges of about the same size,
    from a sample of the first keys of the runs' batches, of bounded size."""
    schema = "url_key string, timestamp string, page_id long, row long"
    out = arrow_schema(schema)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    reader = pa.ipc.open_file(file)
                    keys = [reader.get_batch(i).select(names).slice(0, 1) for i in range(reader.num_record_batches)]
                    yield from (pa.RecordBatch.from_arrays(k.columns, schema=out) for k in keys)

    share = int(min(1.0, RANGE_KEYS * parts * RUN_BATCH / max(captures, 1)) * (1 << 30))
    keys = runs.select("run").mapInArrow(frugal(run), schema).where(F.pmod(F.xxhash64("row", "page_id"), F.lit(1 << 30)) < share)
    found = sorted(map(order_of, keys.toArrow().to_pylist()))
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def merged(runs: DataFrame, folder: str) -> DataFrame:
    """The captures of all runs in one global order, range after range."""
    out, listed = arrow_schema(INDEX), arrow_schema(RUNS)
    size = runs.agg(F.count("*").alias("runs"), F.sum("captures").alias("captures")).first()
    parts, captures, count = shuffle_parts(runs.sparkSession), size.captures or 0, size.runs
    wanted = max(-(-captures // RANGE_ROWS), min(parts, -(-captures // LEAST_RANGE_ROWS)), 1)
    edges = [None, *range_bounds(runs, folder, wanted, captures), None]
    ranges = len(edges) - 1

    def merge(store: fs.FileSystem, root: str, at: int, names: list[str]) -> Iterator[dict]:
        low, high = (None, None) if at < 0 else edges[at : at + 2]
        return iter(LoserTree([slice_of(store, f"{root}/{name}", low, high) for name in sorted(names)], order_of))

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt, made = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for r in batch.to_pylist():
                name, made = f"merged-{attempt}-{made}.run", made + 1
                yield pa.RecordBatch.from_pylist([{"range": r["range"], "run": name, "captures": write_run(store, f"{root}/{name}", merge(store, root, r["range"], r["runs"]), out)}], schema=listed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                for rows in itertools.batched(merge(store, root, r["range"], r["runs"]), 10_000):
                    yield pa.RecordBatch.from_pylist(list(rows), schema=out)

    def planned(pieces: DataFrame, groups: int, split: bool) -> DataFrame:
        group = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")
        plan = pieces.groupBy("range", group).agg(F.collect_list("run").alias("runs")).select("range", "runs")
        return plan.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))) if split else plan

    whole = True
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        split = whole and count < parts  # too few merges of whole runs to go round
        plan = planned(runs, count, split)
        runs = staged(plan.repartition(max(parts, count)).mapInArrow(frugal(lengthen), RUNS), "longer")
        whole = whole and not split
    plan = planned(runs, 1, whole)
    return plan.repartitionByRange(ranges, "range").sortWithinPartitions("range").mapInArrow(frugal(finish), INDEX)


def payloads(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload) of the responses in an index, read at their offsets."""
    schema = "page_id long, payload binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                with store.open_input_file(f"{root}/{r['archive']}") as file:
                    _, block = parsed(zlib.decompress(file.read_at(r["length"], r["offset"]), 31))
                made.append({"page_id": r["page_id"], "payload": http_payload(block)[1]})
            yield pa.RecordBatch.from_pylist(made, schema=out)

    return index.where("record_type = 'response'").select("page_id", "archive", "offset", "length").mapInArrow(frugal(run), schema)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages, reads them back, and returns the merged index."""
    folder = fresh_path(pages.sparkSession, "warc")
    return merged(read_archives(write_archives(pages, folder, least_bytes), folder), folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
# Base32 letters come four from each five hexadecimal digits of the digest.
ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""
}
