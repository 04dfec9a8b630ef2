"""A WARC reader that salvages damaged archives.

Records are taken one after another: gzip members (one or more records each) or plain records, which may alternate in one file. A record
counts only if its header, its Content-Length, the closing blank lines, its block digest and its member's checksum hold; of a member with a
fault, records away from the fault count too. Where a check fails,
the reader searches onwards for the next gzip magic or version line at which a whole valid record stands, goes on from there, and
logs the bytes in between as a quarantined gap. Records and gaps together cover each file without overlap. Files are read in byte ranges, so an archive may be
of any size; the result is that of one reader from the first byte to the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranged, read, stored

#: Compressed bytes that are taken at once.
STEP = 1 << 16
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.[0-9]+\r?\n")
_BLANK = re.compile(rb"\r\n\r\n|\n\n")
_VERSION = re.compile(rb"WARC/[01]\.[0-9]+\r?\n")
SCHEMA = "path string, start long, length long, kind string, reason string, record_type string, record_id string, uri string, block binary"


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class _Bad(Exception):
    pass


#: Faults that more bytes might mend.
_SHORT = ("header without end", "content length doesn't fit", "truncated member")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _plain(data: memoryview, raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: (headers, block, end)."""
    if not _VERSION.match(raw, at):
        raise _Bad("no version line")
    blank = _BLANK.search(raw, at)
    if not blank:
        raise _Bad("header without end")
    nl, stop = blank[0][: len(blank[0]) // 2], blank.start()
    headers = {}
    for line in raw[at:stop].decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise _Bad("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise _Bad("bad content length")
    begin = stop + 2 * len(nl)
    end = begin + int(length)
    if raw[end : end + 2 * len(nl)] != 2 * nl:
        raise _Bad("content length doesn't fit")
    block = bytes(data[begin:end])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said != digest(block):
        raise _Bad("block digest differs")
    return headers, block, end + 2 * len(nl)


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The gzip member at ``at``: (content, end, reason). If its stream breaks, the content is what comes out before, the end where the broken part begins and the reason not empty."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            part = data[pos : pos + STEP]
            if not len(part):
                return b"".join(out), pos, "truncated member"
            out.append(z.decompress(part))
            pos += len(part)
    except zlib.error as e:
        why = "checksum or stream error" if "check" in str(e) else "corrupt member"
        # The step that fails gives nothing back: byte by byte it gives what comes before the fault.
        z, out = zlib.decompressobj(31), []
        try:
            out.append(z.decompress(data[at:pos]))
            for i in range(pos, min(pos + STEP, len(data))):
                out.append(z.decompress(data[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out), pos, why
    return b"".join(out), pos - len(z.unused_data), ""


def _inside(inner: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The valid records of a member's content, and why others aren't: empty if all are."""
    view, records, pos, why = memoryview(inner), [], 0, ""
    while pos < len(inner):
        try:
            headers, block, pos = _plain(view, inner, pos)
            records.append((headers, block))
        except _Bad as e:
            why = why or str(e)
            found = _VERSION.search(inner, pos + 1)
            pos = found.start() if found else len(inner)
    return records, why or ("" if records else "empty member")


def _take(data: memoryview, raw: bytes, at: int) -> tuple[list[Record], int, str]:
    """The records of the member or plain record at ``at``, its end, and the reason if it is damaged: then the end is where to search on."""
    if raw[at : at + 3] != b"\x1f\x8b\x08":
        headers, block, end = _plain(data, raw, at)
        return [Record(at, end, headers, block)], end, ""
    inner, end, broken = _member(data, at)
    found, why = _inside(inner)
    if broken and not why and broken != "truncated member":
        found = []  # all blocks are whole, so the fault is in some header, which nothing else checks
    if broken:
        found = [(h, b) for h, b in found if h.get("warc-block-digest", "").startswith("sha1:")]
    if not found:
        raise _Bad(broken or why)
    if broken:  # its end isn't known: the next valid member or record ends it
        return [Record(at, at, h, b) for h, b in found], at, broken
    return [Record(at, end, h, b) for h, b in found], end, why


class _Window:
    """Bytes of an archive from ``start`` on, of which more can be had: read(start, length)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, start: int, stop: int, slack: int):
        self.read, self.size, self.start, self.slack = read, size, start, slack
        self.raw = read(start, min(size, stop + slack) - start)

    def grow(self) -> bool:
        """Twice the slack more; False if all is there."""
        at = self.start + len(self.raw)
        if at >= self.size:
            return False
        self.slack *= 2
        self.raw += self.read(at, min(self.slack, self.size - at))
        return True


def _walk(w: _Window, stop: int) -> Iterator[Record | Gap]:
    """The records of the units that begin before ``stop`` and the gaps between them. The last gap, if it reaches ``stop``, ends there."""
    pos, lost, why = 0, None, ""
    while w.start + pos < stop and pos < len(w.raw):
        try:
            records, end, broken = _take(memoryview(w.raw), w.raw, pos)
        except _Bad as e:
            records, end, broken = [], pos, str(e)
        # What seems cut off may go on behind the window.
        if broken in (_SHORT[2:] if w.raw[pos : pos + 3] == b"\x1f\x8b\x08" else _SHORT[:2]) and w.grow():
            continue
        if records and lost is not None:
            yield Gap(w.start + lost, w.start + pos, why)
            lost = None
        for r in records:
            r.start, r.end = w.start + r.start, w.start + r.end
            yield r
        if end > pos:
            pos = end
            if broken:
                yield Gap(w.start + end, w.start + end, broken)
            continue
        if lost is None:
            lost, why = pos, broken
        found = _NEXT.search(w.raw, pos + 1)
        pos = found.start() if found else len(w.raw)
    if lost is not None:
        yield Gap(w.start + lost, stop, why)


def salvage(raw: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive and the gaps between them, in order.

    Of a gzip member that holds a damaged record the valid ones are given, and a gap of no length behind it says why others aren't. Of one
    whose stream breaks or whose checksum fails, those are given whose own digest holds, if the fault is seen to lie elsewhere: their length is 0, and the member's bytes are a gap.
    """
    yield from _walk(_Window(lambda start, length: raw[start : start + length], len(raw), 0, len(raw), 0), len(raw))


_ROWS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("block", pa.binary())])


def _batches(path: str, found: Iterator[Record | Gap]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for x in found:
        if isinstance(x, Gap):
            rows.append((path, x.start, x.end - x.start, "gap", x.reason, None, None, None, None))
        else:
            h = x.headers
            rows.append((path, x.start, x.end - x.start, "record", None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), x.block))
            size += len(x.block)
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)


def salvage_archives(files: DataFrame) -> DataFrame:
    """files (path, content) as of Spark's binaryFile source -> SCHEMA: a row for each recovered record, or quarantined gap (kind 'gap', with the reason).

    A NULL or empty content gives no rows, an archive of garbage alone one gap. Repeated rows are read each time. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield from _batches(path.as_py(), salvage(content.as_py() or b""))

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SCHEMA)


#: Bytes of a file that a task reads, and what it reads beyond them at first, for the record that crosses the border.
SPAN, SLACK = 64 << 20, 1 << 20


def _stitched(x: pd.DataFrame, span: int) -> pd.DataFrame:
    """Puts the ranges of one file together: where each begins to give rows (NULL for none), where its last gap ends, and which must be read again from where."""
    x = x.sort_values("i").reset_index(drop=True)
    give, again, until = [None] * len(x), [None] * len(x), [None] * len(x)
    pos, opened = 0, None  # opened: the range whose gap is open
    for k, r in enumerate(x.itertuples()):
        a, b = r.i * span, min(r.length, (r.i + 1) * span)
        if opened is None and pos >= b:
            continue  # a record that began before covers all of it
        want = a if opened is not None else pos
        first = None if pd.isna(r.first) else int(r.first)
        if r.start != want and not (r.start < want and (first is None or first >= want) and r.start == a):
            again[k] = want
            break
        if first is not None:
            if opened is not None:
                until[opened] = first
            give[k], opened, pos = first if opened is not None else want, None, int(r.tail)
        elif opened is None:
            give[k] = want
            opened, pos = k, b
        if not pd.isna(r.open):
            opened = k
    if opened is not None:
        until[opened] = int(x["length"].iloc[0])
    return x.assign(give=pd.array(give, "Int64"), again=pd.array(again, "Int64"), until=pd.array(until, "Int64"))


def read_warc(spark: SparkSession, path: str, span: int = SPAN, slack: int = SLACK) -> DataFrame:
    """The archives under a path or glob -> SCHEMA, as salvage() of each whole file, in tasks of byte ranges.

    A first pass finds of each range its first valid record and where its last one ends; what lies between the ranges is put together file by file.
    A range whose first record proves to lie inside one that began before (an archive within a record) is read again from that one's end. The second pass gives the rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / span) - 1)).alias("i"))
    shape = "path string, length long, i long, start long, first long, tail long, open long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, i, start in zip(*(c.to_pylist() for c in batch.columns)):
                stop, first, tail, gap = min(length, (i + 1) * span), None, None, None
                w = _Window(lambda at, n, name=name: ranged(name, at, n), length, start, stop, slack)
                for x in _walk(w, stop):
                    if isinstance(x, Record):
                        first = x.start if first is None else first
                        tail, gap = max(x.end, tail or 0), None
                    elif x.end > x.start:
                        gap = x.start if x.end == stop else None
                yield pa.RecordBatch.from_pydict({"path": [name], "length": [length], "i": [i], "start": [start], "first": pa.array([first], pa.int64()), "tail": pa.array([tail], pa.int64()), "open": pa.array([gap if first is not None else None], pa.int64())})

    def seen(x: DataFrame) -> DataFrame:
        return x.select("path", "length", "i", "start").repartition("path", "i").mapInArrow(look, shape)

    plan = stored(seen(ranges.withColumn("start", F.col("i") * span)), "ranges")
    while True:
        made = stored(plan.groupBy("path").applyInPandas(lambda x: _stitched(x, span), shape + ", give long, again long, until long"), "ranges")
        wrong = made.filter("again is not null")
        if not wrong.limit(1).count():
            break
        plan = stored(made.filter("again is null").select(plan.columns).unionByName(seen(wrong.withColumn("start", F.col("again")))), "ranges")

    def read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, i, give, until in zip(*(c.to_pylist() for c in batch.columns)):
                stop = min(length, (i + 1) * span)

                def ended(found: Iterator[Record | Gap], stop=stop, until=until) -> Iterator[Record | Gap]:
                    for x in found:
                        if isinstance(x, Gap) and x.end == stop and x.start < stop and until is not None:
                            x.end = until
                        yield x

                yield from _batches(name, ended(_walk(_Window(lambda at, n, name=name: ranged(name, at, n), length, give, stop, slack), stop)))

    return made.filter("give is not null").select("path", "length", "i", "give", "until").repartition("path", "i").mapInArrow(read_range, SCHEMA)


def member(page_id: int | None, url: str | None, html: str | None, gzip: bool = True) -> bytes:
    """A page as a resource record. A NULL url has no target header, a NULL html an empty block, a NULL id an empty record id."""
    block = (html or "").encode("utf-8", "replace")
    uri = "" if url is None else f"WARC-Target-URI: {re.sub('[\\r\\n]+', ' ', url)}\r\n"
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n{uri}WARC-Block-Digest: {digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    record = head.encode() + block + b"\r\n\r\n"
    if not gzip:
        return record
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def damaged(record: bytes, how: int) -> bytes:
    """A record spoilt by a flipped byte, a lost end, a lost begin or garbage in its middle."""
    m = len(record) // 2
    if how == 0:
        return record[:m] + bytes([record[m] ^ 0x5A]) + record[m + 1 :]
    if how == 1:
        return record[:m]
    if how == 2:
        return record[4:]
    return record[:m] + b"\0garbage\0" * 8 + record[m:]


def archive(pages: DataFrame, records: int = 64, spoil_every: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (path, content): archives of some records each, gzipped and plain in turn. Of each spoil_every records about one is damaged, chosen by a hash of page_id."""

    def spoilt(page_id: int | None) -> int:
        x = zlib.crc32(str(page_id).encode())
        return (x >> 8) % 4 if spoil_every and x % spoil_every == 0 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, records):
                part, members = batch.slice(at, records).to_pydict(), []
                first = next((i for i in part["page_id"] if i is not None), 0)
                for i, u, h in zip(part["page_id"], part["url"], part["html"]):
                    x, how = member(i, u, h, gzip=first // max(1, records) % 2 == 0), spoilt(i)
                    members.append(x if how < 0 else damaged(x, how))
                yield pa.RecordBatch.from_arrays([pa.array([f"pages-{first}.warc"]), pa.array([b"".join(members)])], ["path", "content"])

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "path string, content binary")


def recovered_pages(found: DataFrame) -> DataFrame:
    """SCHEMA -> (page_id, url, html) beside the place of each record, and the gaps with NULL in these."""
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return found.select("path", "start", "length", "kind", "reason", F.when(page != "", page.cast("long")).alias("page_id"), F.col("uri").alias("url"), F.decode("block", "utf-8").alias("html"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, with one record of 32 damaged, and read back: the recovered pages and the gaps."""
    return recovered_pages(salvage_archives(archive(read(spark, sf_dir, "pages"), spoil_every=32)))
