"""WARC archives: a writer that revisits equal payloads, and a salvage reader that recovers what it can."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import lean, save, scratch_dir, skew_join, small_batches, stable

READ = 1 << 20
GZIP, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
#: An archive is closed when it has this many compressed bytes; so a reader's task is bounded too.
ARCHIVE_BYTES = 64 << 20
MANIFEST = "archive string, records long, bytes long"
#: What every record must have, a header line of it and of no more than HEADER bytes in all.
REQUIRED, HEADER = ("warc-type", "warc-record-id", "warc-date", "content-length"), 1 << 16
RECORDS = "archive string, offset long, length long, inner_offset long, inner_length long, kind string, reason string, warc_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, sha1: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}:{ordinal}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, ordinal: int = 0) -> bytes:
    """One WARC record: a response with its payload, or a revisit that keeps only the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    sha1 = digest(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, sha1, ordinal)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {_record_id(refers_to, sha1, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Window:
    """Random access to a file of any size, of which little is in memory at once."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.buf = file, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if not (self.at <= start and start + n <= self.at + len(self.buf)):
            self.file.seek(start)
            self.at, self.buf = start, self.file.read(max(n, READ))
        return self.buf[start - self.at : start - self.at + n]

    def find(self, pattern: re.Pattern, start: int) -> int:
        """The first match at or after start, or the size."""
        while start < self.size:
            chunk = self.get(start, READ)
            if m := pattern.search(chunk):
                return start + m.start()
            if start + len(chunk) >= self.size:
                break
            start += len(chunk) - 16
        return self.size


def _member(win: Window, at: int, most: int) -> tuple[bytes, int, str]:
    """Of the gzip member at an offset: its data or what can be had of it, the end of what was read, and why it broke, if it did (broken, cut off, or over most bytes)."""
    d, out, n, pos, step = zlib.decompressobj(31), [], 0, at, 1 << 14
    while not d.eof:
        chunk = win.get(pos, step)
        if not chunk:
            return b"".join(out), pos, "member is cut off"
        before, got = d.copy(), []
        try:
            rest = chunk
            while rest and not d.eof and n <= most:
                got.append(d.decompress(rest, min(1 << 16, most + 1 - n)))
                n += len(got[-1])
                rest = d.unconsumed_tail
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"member: {e}"
            # what came before the break within the chunk is in no output: go on in smaller steps
            d, step, n = before, step // 16 or 1, n - sum(map(len, got))
            continue
        out += got
        pos += len(chunk)
        if n > most:
            return b"".join(out), pos, "member is too long"
    return b"".join(out), pos - len(d.unused_data), ""


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset of data, and its end. Raises ValueError where a check fails."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at, at + HEADER)
    if end < 0:
        raise ValueError("header has no end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if missing := [x for x in REQUIRED if not headers.get(x)]:
        raise ValueError(f"header lacks {missing[0]}")
    if not (length := headers["content-length"]).isascii() or not length.isdigit():
        raise ValueError("no content length")
    if not re.match(r"\d{4}(-\d\d|$)", headers["warc-date"]):
        raise ValueError("header has no date")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = data[start:stop]
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest differs")
    return headers, block, stop + 4


def _inside(data: bytes, broken: str) -> Iterator[dict]:
    """Records and gaps of a member's data, with offsets in it. Of a broken member's records only those that their own digest proves count."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            headers, block, stop = parse(data, at)
            if broken and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError(broken)
            row = _fields(headers, block)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            found = VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield {"kind": "gap", "inner_offset": bad, "inner_length": at - bad, "reason": why}
            bad = None
        yield {"kind": "record", "inner_offset": at, "inner_length": stop - at} | row
        at = stop
    if bad is not None or broken:
        bad = len(data) if bad is None else bad
        yield {"kind": "gap", "inner_offset": bad, "inner_length": len(data) - bad, "reason": broken or why}


def _fields(headers: dict[str, str], block: bytes) -> dict:
    head, _, body = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type", "")
    http = block.startswith(b"HTTP/")
    payload = body if http else block
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head) if http else None
    n = int(length[1]) if kind == "revisit" and length else len(payload)
    want = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and want and want != digest(payload):
        raise ValueError("payload digest differs")
    number = lambda k: int(headers[k]) if re.fullmatch(r"-?\d+", headers.get(k, "")) else None
    return {"warc_type": kind, "record_id": headers.get("warc-record-id"), "page_id": number("x-page-id"), "target_uri": headers.get("warc-target-uri"), "payload_bytes": n,
            "payload_digest": want or digest(payload), "refers_to": number("x-refers-to-page-id"), "payload": payload}


def salvage(file, size: int, most: int = 1 << 28) -> Iterator[dict]:
    """Records and gaps of an archive, by offset.

    At each offset a gzip member or a plain record is read and checked: CRC
    and length of the member, version line, header lines and those a record
    must have, content length, end mark, block and payload digests. If a check
    fails, the reader searches for the next offset from which all checks hold
    (a gzip magic or a version line), goes on there, and reports the bytes
    between as one gap with the first reason.

    A member may hold several records. If one of them is broken, the good ones
    before and after it are given, and a gap's inner_offset and inner_length
    name the bytes of the member's data between them. If the member itself is
    broken or cut off, records before the break that their digests prove are
    given, and one gap names the rest. What a member has beyond `most` bytes
    counts as broken.
    """
    win, at, gap, why, held = Window(file, size), 0, None, "", []
    start = re.compile(re.escape(GZIP) + rb"|" + VERSION.pattern)

    def closed(to: int) -> Iterator[dict]:
        if gap is not None:
            yield from (x | {"offset": gap, "length": to - gap} for x in held or [{"kind": "gap", "reason": why}])

    while at < size:
        try:
            head = win.get(at, 10)
            if head.startswith(GZIP):
                data, end, broken = _member(win, at, most)
                found = list(_inside(data, broken))
                del data
                if not any(x["kind"] == "record" for x in found):
                    raise ValueError(broken or (found[0]["reason"] if found else "empty member"))
                if broken:  # how far it reaches is known once the next good offset is
                    yield from closed(at)
                    gap, held = at, found
                    at = win.find(start, at + 1)
                    continue
            elif VERSION.match(head):
                n = READ
                while True:
                    data = win.get(at, n)
                    try:
                        headers, block, used = parse(data)
                        break
                    except ValueError as e:
                        # a longer look helps only if the record may go on beyond it
                        if n >= most or at + n >= size or "does not end" not in str(e):
                            raise
                        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", data[:HEADER])
                        if m and m.start() + int(m[1]) + 8 < n // 2:
                            raise
                        n = min(most, max(4 * n, int(m[1]) + m.end() + 8192 if m else 0))
                found, end = [{"kind": "record"} | _fields(headers, block)], at + used
            else:
                raise ValueError("no member and no version line")
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = win.find(start, at + 1)
            continue
        yield from closed(at)
        gap, held = None, []
        for x in found:
            yield x | {"offset": at, "length": end - at}
        at = end
    yield from closed(size)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0
    for row in rows:
        kept.append(row)
        n += len(row.get("payload") or b"") + 200
        if n >= most:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, n = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 4) -> DataFrame:
    """Write rows (page_id, url, payload, revisit, refers_to, ordinal) as .warc.gz files under path; a saved manifest of them.

    Each task names its files anew and lists them in its output, so files of
    failed or doubled attempts are in no manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"], row["revisit"], row["ordinal"])
                data = c.compress(data) + c.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append({"archive": name, "records": n, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"archive": name, "records": n, "bytes": size})
        schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return save(records.select("page_id", "url", "payload", "revisit", "refers_to", "ordinal").mapInArrow(lean(write), MANIFEST))


def read_archives(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """Every record and gap of the archives (column archive) that manifest lists; path names their file system.

    One archive is read by one task, a member at a time. kind is record or
    gap; gaps carry archive, offset, length and reason, and those within a
    member inner_offset and inner_length. Payloads are given only if asked for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        num = lambda k: (k, pa.int64())
        txt = lambda k: (k, pa.string())
        schema = pa.schema([txt("archive"), num("offset"), num("length"), num("inner_offset"), num("inner_length"), txt("kind"), txt("reason"), txt("warc_type"), txt("record_id"), num("page_id"), txt("target_uri"), num("payload_bytes"), txt("payload_digest"), num("refers_to"), ("payload", pa.binary())])

        def rows() -> Iterator[dict]:
            for batch in batches:
                for name in batch.column("archive").to_pylist():
                    with store.open_input_file(name) as f:
                        for x in salvage(f, f.size()):
                            yield x | {"archive": name, "payload": x.get("payload") if payloads else None}

        yield from _batches(rows(), schema)

    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.select("archive").repartition(tasks).mapInArrow(lean(read), RECORDS)


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 0) -> tuple[DataFrame, str]:
    """Write a record per page (page_id, url, html) and give the manifest and the folder.

    Of pages with equal payloads of at least `least` bytes, the one with the
    smallest page_id is a response, the others revisit it. A null html is an
    empty payload; a null url becomes an urn. A null page_id comes after all
    others and is referred to by none: pages that revisit it carry null. Of rows
    that repeat page_id and payload, the first in the table is the response.
    Only digests are grouped; payloads move once, to meet what was decided.
    """
    path = path or scratch_dir(pages.sparkSession)
    small_batches(pages.sparkSession)
    pages = stable(pages)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    known = rows.select(F.sha2("payload", 256).alias("key"), F.length("payload").alias("n"), F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row").alias("who")).where(F.col("n") >= least)
    first = known.groupBy("key").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = skew_join(known, first, ["key"]).where("who <> first").select(F.col("who.row").alias("row"), F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    out = rows.join(again, "row", "left").select("page_id", "url", "payload", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to", F.when(F.col("revisit") | F.col("page_id").isNull(), F.col("row") + 1).otherwise(F.lit(0)).alias("ordinal"))
    return write_archives(out, path), path


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """archive_pages, then what the salvage reader finds: page_id, payload_bytes, payload_digest, record_type, refers_to, archive_gaps.

    archive_gaps is the number of quarantined gaps in all archives, equal in
    every row: 0 unless the shared store damaged them.
    """
    manifest, path = archive_pages(pages, least=least)
    found = save(read_archives(manifest, path).select("kind", "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"))
    gaps = found.where("kind = 'gap'").count()
    return found.where("kind = 'record'").drop("kind").withColumn("archive_gaps", F.lit(gaps).cast("long"))
