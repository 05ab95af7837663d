"""WARC: a deduplicating writer and a salvage reader.

``write_archives`` turns pages into gzip-per-record WARC/1.1 files. Pages of
equal payload are written once, as a response; the others become revisit
records that refer to it. ``read_archives`` checks every record (gzip CRC,
version line, content length, block and payload digest, by the algorithm that a
digest names). Where a check fails it searches for the next gzip member or
version line, goes on from there and logs the bytes that it passed over as a
quarantined gap. A gzip member may hold many records; of a damaged one those
are kept that inflate and that a digest proves. An HTTP length unlike the
payload's is a note in ``reason``.

Both sides go through Spark's own readers and writers, so archives may lie in
any store that Spark reaches and a lost executor costs a task's retry. The
writer bounds the bytes of a file. The reader takes a file as one value, or, beyond
Spark's bound of a value (``READ_BYTES``), in ranges that begin at a member (of
files named ``.gz``) or at a version line (of others). Salvaging is linear in the
file: places of patterns are searched once.

Defined cases: a null html is an empty payload; a null url leaves out the
target URI; rows that repeat page_id and payload are all responses; null
page_ids rank below all others and the record then carries no page number;
an empty table gives an empty archive; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches, table, written

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
#: Bytes of one archive file, unless a single record has more.
FILE_BYTES = 32 << 20
#: Largest file that Spark hands over as one value; of longer ones, bytes of a range, and log2 of the ranges that a split has room for.
READ_BYTES, RANGE_BYTES, PART_BITS = 2_000_000_000, 64 << 20, 16

RECORD_FIELDS = (
    "file string, offset long, length long, kind string, reason string, record_type string, record_id string, "
    "page_id long, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
)
_RECORD_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
        ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
        ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload and the page that a revisit refers to.

    The largest page_id of each payload that repeats comes from an aggregate
    with map-side partial sums and is written as a table. So the join that
    brings it back shuffles both sides by itself, unless Spark finds that table
    small, and adaptive execution splits a payload that a third of all pages share.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = written(
        pages.select("page_id", F.sha1(payload).alias("digest"))
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "largest"),
        "payloads",
    )
    joined = rows.join(repeated, "digest", "left")
    again = (F.length("payload") >= min_bytes) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("largest")).alias("refers_to"))


def _line(text: str) -> str:
    """A header value: line breaks would end it."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: the HTTP response, or for a revisit its head alone."""
    digest = "sha1:" + base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        *(
            [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: <urn:page:{refers_to}>",
            ]
            if refers_to is not None
            else []
        ),
        f"WARC-Payload-Digest: {digest}",
        "WARC-Block-Digest: sha1:" + base32_sha1(block),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose bytes depend on data alone."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return MAGIC + b"\0" * 5 + b"\x04\xff" + body + zlib.crc32(data).to_bytes(4, "little") + size


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> str:
    """Writes pages (page_id, url, html) as WARC files into path and returns it.

    Members are gathered up to ``file_bytes``, a file each. The text writer puts
    its separator, here one zero byte, after each value. A member's last byte is
    the top byte of its length, which is zero below 16 MB: that byte is left to
    the writer. Longer members get the zero byte as the padding that gzip allows.
    """
    rows = with_roles(pages, min_bytes)
    small_batches(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            whole = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole[-1] == 0 else whole], pa.binary())], ["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                member = gzip_member(record_bytes(page, url, payload, refers, date))
                if held and size + len(member) > file_bytes:
                    yield packed()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield packed()

    members = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


# ---------------------------------------------------------------- salvaging


def digest_holds(told: str, data: bytes) -> bool | None:
    """Whether a labelled digest (``sha1:...``, in base 32, 64 or 16) is that of data; None if its algorithm is not known here."""
    name, colon, value = told.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    raw, value = hashlib.new(name, data).digest(), value.strip()
    bare = value.rstrip("=")
    return bare.upper() == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex() or bare in (base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="))


class Ahead:
    """The next place of a pattern, or the end. As long as places are asked for in ascending order, the data are searched once."""

    def __init__(self, data: bytes, pattern: bytes | re.Pattern):
        self.data, self.pattern, self.since, self.place = data, pattern, 0, -1

    def _find(self, at: int, to: int) -> int:
        if isinstance(self.pattern, bytes):
            return self.data.find(self.pattern, at, to)
        found = self.pattern.search(self.data, at, to)
        return found.start() if found else -1

    def after(self, at: int) -> int:
        n = len(self.data)
        if self.place < at:
            self.since, self.place = at, self._find(at, n)
            if self.place < 0:
                self.place = n
        elif at < self.since:  # a step back: what lies before the last search
            found = self._find(at, min(n, self.since + 64))
            return found if 0 <= found < self.place else self.place
        return self.place


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The header lines from data[at:] by name, and where the empty line after them ends. A line that is none is an error."""
    out: dict[str, str] = {}
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("header does not end")
        if end == at:
            return out, end + 2
        name, colon, value = data[at:end].partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        elif data[at] not in b" \t":
            raise ValueError("bad header line")
        at = end + 2


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at data[at:], and where it ends. ValueError says what is wrong.

    proven: whether a digest of the block or the payload was compared.
    """
    found = VERSION.match(data, at)
    if not found:
        raise ValueError("no version line")
    head, start = _headers(data, found.end())
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise ValueError("bad content length")
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block is cut short")
    block = data[start:stop]
    proven = digest_holds(head.get("warc-block-digest", ""), block)
    if proven is False:
        raise ValueError("block digest differs")
    kind, http, payload, size, note = head.get("warc-type"), b"", None, None, None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = _http_length(http)
        size = int(told) if told.isdigit() else len(payload)
    else:
        payload, size = block, len(block)
    if kind == "revisit":
        payload = None
    else:
        same = digest_holds(head.get("warc-payload-digest", ""), payload)
        if same is False:
            raise ValueError("payload digest differs")
        proven = proven or same
        if size != len(payload):
            note, size = f"HTTP content length is {size}", len(payload)
    page = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
    return {
        "record_type": kind, "record_id": head.get("warc-record-id"), "page_id": int(page[1]) if page else None, "target_uri": head.get("warc-target-uri"),
        "refers_to_id": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload, "reason": note, "proven": bool(proven),
    }, stop + 4


def _http_length(http: bytes) -> str:
    """The last Content-Length of an HTTP head, whatever its other lines are."""
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.partition(b":")[0].strip().lower() == b"content-length"]
    return told[-1].decode("utf-8", "replace") if told else ""


#: Longest gzip header whose own checksum is compared; behind longer ones, those of the data are.
CHECKED_HEADER = 1 << 16


def _deflated(data: bytes, at: int, ends: tuple[Ahead, Ahead]) -> int:
    """Where the deflated data of the gzip member at data[at:] start; ``ends`` look for the ends of names and of comments."""
    flags, p = data[at + 3 : at + 4], at + 10
    if not flags or flags[0] & 0xE0:
        raise ValueError("gzip: bad header")
    if flags[0] & 4:
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for bit, zeros in zip((8, 16), ends, strict=True):
        if flags[0] & bit:
            p = zeros.after(p) + 1
    if flags[0] & 2:
        if p - at <= CHECKED_HEADER and zlib.crc32(data[at:p]) & 0xFFFF != int.from_bytes(data[p : p + 2], "little"):
            raise ValueError("gzip: header crc mismatch")
        p += 2
    if p >= len(data):
        raise ValueError("gzip: header does not end")
    return p


def _member(data: bytes, body: int, window: int) -> tuple[bytes, int]:
    """The deflated data at data[body:body + window] of a gzip member, inflated, its CRC and length checked, and where the member ends."""
    unpack = zlib.decompressobj(-15)
    part = memoryview(data)[body : body + window]
    try:
        out = unpack.decompress(part)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    stop = body + len(part) - len(unpack.unused_data)
    if not unpack.eof or len(data) < stop + 8:
        raise ValueError("gzip member is cut short")
    if zlib.crc32(out) != int.from_bytes(data[stop : stop + 4], "little"):
        raise ValueError("gzip: incorrect data check")
    if len(out) & 0xFFFFFFFF != int.from_bytes(data[stop + 4 : stop + 8], "little"):
        raise ValueError("gzip: incorrect length check")
    return out, stop + 8


def _inflated(data: bytes, at: int, window: int) -> tuple[bytes, bool]:
    """What can be inflated of the damaged deflated data at data[at:at + window], and whether the stream breaks off there."""
    unpack, out, to = zlib.decompressobj(-15), [], min(at + window, len(data))
    step = 1 << 12
    while at < to and not unpack.eof:
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[at : min(at + step, to)]))
            at += step
        except zlib.error:
            if step == 1:
                return b"".join(out), True
            unpack, step = before, 1  # up to the byte at fault
    return b"".join(out), not unpack.eof


def _records(text: bytes, damaged: bool = False, torn: bool = False) -> list[dict]:
    """Records and gaps of an inflated member, with the reason of each gap.

    Of a damaged member only proven records count, and only such as another one
    follows or, if the stream is not torn, its end: else the damage hits them.
    """
    out, at, gap, versions = [], 0, "", Ahead(text, VERSION)
    while at < len(text):
        if text[at] in b"\r\n":
            at += 1
            continue
        try:
            record, stop = parse_record(text, at)
            whole = VERSION.match(text, stop) or not torn and stop == len(text)
            if damaged and not (record["proven"] and whole):
                raise ValueError("damaged member")
            at = stop
            if gap:
                out.append({"kind": "gap", "reason": gap})
                gap = ""
            out.append({"kind": "record"} | record)
        except ValueError as e:
            gap = gap or f"in a member: {e}"
            at = versions.after(at + 1)
    return out + ([{"kind": "gap", "reason": gap}] if gap else [])


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, plain or gzip, in order.

    Every byte belongs to a record, to a gap or to zero padding after a member.
    What comes from one gzip member has the member's offset; its length is with
    the first of these rows, the others have 0, as have all that come from a
    damaged member, whose bytes are a gap.
    """
    at, gap, why, n = 0, None, "", len(data)
    versions, members, ends = Ahead(data, VERSION), Ahead(data, MAGIC), (Ahead(data, b"\0"), Ahead(data, b"\0"))
    bad: dict[int, str] = {}  # starts of deflated data that are none; many headers may lead to one
    while at < n:
        saved: list[dict] = []
        try:
            if data.startswith(MAGIC, at):
                body = _deflated(data, at, ends)
                if body in bad:
                    raise ValueError(bad[body])
                # Inflating works on windows, so a damaged start costs no copy of the rest of the file.
                window = 1 << 16
                while True:
                    try:
                        text, stop = _member(data, body, window)
                        break
                    except ValueError as e:
                        if "cut short" not in str(e) or body + window >= n:
                            bad[body] = str(e)
                            text, torn = _inflated(data, body, window)
                            saved = [r for r in _records(text, True, torn) if r["kind"] == "record"]
                            raise
                        window *= 8
                rows = _records(text)
                if all(r["kind"] == "gap" for r in rows):
                    raise ValueError(rows[0]["reason"].removeprefix("in a member: ") if rows else "no version line")
            else:
                record, stop = parse_record(data, at)
                rows = [{"kind": "record"} | record]
        except ValueError as e:
            if saved:
                if gap is not None and gap < at:
                    yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                yield from ({"offset": at, "length": 0} | r for r in saved)
                gap, why = at, str(e)
            if gap is None:
                gap, why = at, str(e)
            at = min(versions.after(at + 1), members.after(at + 1))
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
            gap = None
        for k, row in enumerate(rows):
            yield {"offset": at, "length": 0 if k else stop - at} | row
        at = stop
        while at < n and data[at] == 0:  # padding
            at += 1
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": n - gap, "reason": why}


def _row(x: dict, file: str, with_payload: bool) -> dict:
    row = {f: x.get(f) for f in _RECORD_SCHEMA.names} | {"file": file}
    return row if with_payload else row | {"payload": None}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"") + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record or quarantined gap (``kind``) of the archives in a folder.

    A file is a row of Spark's binary reader; the writer bounds the bytes of
    files, and Spark those of a task's files. Files longer than READ_BYTES are read
    in ranges.
    """
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= READ_BYTES).select("path", "content")
    small_batches(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches((_row(x, name.as_py(), with_payload) for x in salvage(content.as_py())), _RECORD_SCHEMA)

    out = files.mapInArrow(read, RECORD_FIELDS)
    long = [r["path"] for r in every.where(F.col("length") > READ_BYTES).select("path").collect()]  # names of files of gigabytes each
    for packed in (True, False):
        if some := [p for p in long if p.endswith(".gz") == packed]:
            out = out.unionByName(read_ranges(spark, some, MAGIC if packed else b"WARC/", with_payload))
    return out


_EDGE_FIELDS = f"block long, {RECORD_FIELDS}"
_EDGE_SCHEMA = pa.schema([("block", pa.int64()), *_RECORD_SCHEMA])


def _edges(data: bytes) -> Iterator[dict]:
    """The salvaged rows of a range; what it holds before its first and after its last record is ``head`` and ``tail``, with its bytes, or all of it ``whole``."""
    rows = list(salvage(data))
    if not [r for r in rows if r["kind"] == "record" and r["length"]]:
        rows = [{"kind": "whole", "offset": 0, "length": len(data), "payload": data}]
    else:
        for i, kind in ((0, "head"), (-1, "tail")):
            gap = rows[i]
            if gap["kind"] == "gap" and (gap["offset"] == 0 if kind == "head" else gap["offset"] + gap["length"] == len(data)):
                rows[i] = {"kind": kind, "offset": gap["offset"], "length": gap["length"], "payload": data[gap["offset"] : gap["offset"] + gap["length"]]}
                # What was saved of the member at the range's end comes again with the rest of that member.
                rows = [r for r in rows if not (kind == "tail" and r["kind"] == "record" and not r["length"] and r["offset"] == gap["offset"])]
    yield from rows
    yield {"kind": "range", "offset": 0, "length": len(data)}


def read_ranges(spark: SparkSession, paths: list[str], start: bytes, with_payload: bool = True) -> DataFrame:
    """The same of files of any length, in ranges of Spark's splits that begin where ``start`` (a member's or a record's first bytes) is found.

    The text source finds the places: ``start`` is its line separator, so each split
    begins with the first one in it and runs to the first one beyond it; files named
    ``.gz`` are one split each, taken as they are and in parts. A range is some
    RANGE_BYTES from one place to another. Such bytes may also lie within a member: so
    what a range cannot use at its ends is put together with its neighbours' and
    salvaged again, up to READ_BYTES.
    """
    lines = spark.read.option("lineSep", start.decode("latin-1")).option("encoding", "ISO-8859-1")
    lines = lines.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
    for name in ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension"):  # Spark's own Hadoop client has its names changed
        lines = lines.option(name, ".gz")
    lines = lines.text(paths)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    small_batches(pieces)

    most = RANGE_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size = None, 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            data, block = b"".join(held), (now[1] << PART_BITS) + part
            yield from _batches((_row(x, now[0], with_payload or x["kind"] in ("head", "tail", "whole")) | {"block": block} for x in _edges(data)), _EDGE_SCHEMA)

        for batch in batches:
            for file, split, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, split) != now or size > most:
                    if now is not None:
                        yield from done()
                    part, held, size = part + 1 if (file, split) == now else 0, [], 0
                if (file, split) != now and split == 0:
                    held.append(piece)  # all but a file's first piece have a separator before them
                else:
                    held += [start, piece]
                now, size = (file, split), size + len(piece)
        if now is not None:
            yield from done()

    rows = written(pieces.mapInArrow(read, _EDGE_FIELDS), "ranges")
    order = Window.partitionBy("file").orderBy("block")  # the ranges of a file
    sizes = rows.where("kind = 'range'").select("file", "block", F.col("length").alias("n"))
    whole = rows.where("kind = 'whole'").select("file", "block", F.lit(1).alias("whole"))
    ranges = sizes.join(whole, ["file", "block"], "left").select(
        "file", "block", (F.sum("n").over(order) - F.col("n")).alias("base"), F.sum(F.when(F.col("whole").isNull(), 1).otherwise(0)).over(order).alias("sound")
    )
    ranges = written(ranges, "bases")
    based = rows.where("kind <> 'range'").join(ranges, ["file", "block"]).withColumn("offset", F.col("offset") + F.col("base"))
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    parts = based.where("kind IN ('head', 'tail', 'whole')").select("file", "offset", "length", "payload", (F.col("sound") - F.when(F.col("kind") == "head", 1).otherwise(0)).alias("between"))
    both = parts.groupBy("file", "between").agg(F.sum("length").alias("n"))
    parts = parts.join(both, ["file", "between"]).withColumn("alone", F.when(F.col("n") > READ_BYTES, F.col("offset")))
    joined = parts.groupBy("file", "between", "alone").agg(F.sort_array(F.collect_list(F.struct("offset", "payload"))).alias("parts"))  # READ_BYTES at most

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, data = found[0]["offset"], b"".join(x["payload"] for x in found)
                yield from _batches((_row(x | {"offset": at + x["offset"]}, file, with_payload) for x in salvage(data)), _RECORD_SCHEMA)

    return based.where("kind IN ('record', 'gap')").select(*names).unionByName(joined.select("file", "parts").mapInArrow(again, RECORD_FIELDS))


# ---------------------------------------------------------------- query


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back and returns what each record says."""
    pages = table(spark, sf_dir, "pages")
    path = write_archives(pages, scratch(spark, "warc"))
    records = read_archives(spark, path, with_payload=False)
    return records.where("kind = 'record'").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to_id", "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p
)
SELECT page_id,
  CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM m
"""
