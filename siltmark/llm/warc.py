"""WARC 1.1 archives: a writer that turns equal payloads to revisit records, and a salvage reader.

The salvage reader checks each gzip member, record length, trailer and digest. After a failed check it searches for the
next gzip member (or, in plain archives, the next version line) that begins a record, goes on there, and logs the bytes
in between as a quarantined gap. One record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _shared as S

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(x: str) -> str:
    """A header value on one line."""
    return " ".join(x.split()) or "-"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or with refers_to a revisit record, which has the response's HTTP header but not its payload."""
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _line(url or "")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + (payload if refers_to is None else b""))


class _Write:
    def __init__(self, root: str, date: str, max_bytes: int, compress: bool):
        self.root, self.date, self.max_bytes, self.compress = root, date, max_bytes, compress

    def __call__(self, it):
        fs, top = S.open_fs(self.root)
        fs.create_dir(top)
        part, seq, out, size, n = TaskContext.get().partitionId(), 0, None, 0, 0

        def close():
            out.close()
            name = f"part-{part:08d}-{seq:05d}.warc" + ".gz" * self.compress
            fs.move(temp, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "n_records": pa.array([n], pa.int64())})

        put = member if self.compress else bytes
        for rb in it:
            for row in zip(*(rb.column(x) for x in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    temp = f"{top}/.{part:08d}-{uuid.uuid4().hex}"
                    out, n = fs.open_output_stream(temp), 0
                    info = put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{part}-{seq}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size = len(info)
                data = put(page_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, self.date))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= self.max_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", max_bytes: int = 1 << 30, compress: bool = True) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) to archives below root; returns (file, n_records).

    Of rows with equal payloads of at least min_bytes, those with the largest page_id are responses, others revisit it;
    smaller payloads are all responses. A null html is an empty payload; a null page_id counts as smallest; repeated
    rows that share the largest page_id are all responses; other columns are ignored; an empty table writes no archive.
    """
    html = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "to")
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("to") > F.coalesce("page_id", F.lit(-(1 << 63))), F.col("to")))
    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_Write(root, date, max_bytes, compress), "file string, n_records long")


# ---------------------------------------------------------------- reading


class Source:
    """Bytes of a file at any place, through one block that is kept."""

    def __init__(self, src, block: int = 4 << 20):
        self.src, self.size, self.block, self.at, self.data = src, src.size(), block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.src.seek(at)
            self.at, self.data = at, self.src.read(max(n, self.block))
        return self.data[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            data = self.get(at, 1 << 20)
            k = data.find(what)
            if k >= 0:
                return at + k
            at += max(1, len(data) - len(what) + 1) if at + len(data) < self.size else len(data) + 1
        return -1


class Damaged(Exception):
    pass


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response; the whole block of other records."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def http_header(self, name: str) -> str | None:
        for x in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            k, _, v = x.partition(b":")
            if k.strip().lower() == name.lower().encode():
                return v.strip().decode("latin-1")
        return None


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise Damaged("no version line")
    out: dict[str, str] = {}
    for x in lines[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        out[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    return out


def _checked(r: Record) -> Record:
    for name, data in (("warc-block-digest", r.block), ("warc-payload-digest", r.payload if r.headers.get("warc-type") == "response" else None)):
        want = r.headers.get(name, "")
        if data is not None and want.startswith("sha1:") and want[5:] != base32_sha1(data):
            raise Damaged(f"{name} differs")
    return r


def _gzip_record(src: Source, at: int) -> Record:
    z, out, pos, step = zlib.decompressobj(31), [], at, 1 << 14
    while not z.eof:
        data = src.get(pos, step)
        if not data:
            raise Damaged("a member is cut short")
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        pos, step = pos + len(data), min(step * 2, 1 << 20)
    data = b"".join(out)
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise Damaged("no end of headers")
    headers = _headers(head)
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("the block is not as long as its header says")
    return _checked(Record(at, pos - len(z.unused_data), headers, rest[:n]))


def _plain_record(src: Source, at: int) -> Record:
    if src.get(at, 5) != b"WARC/":
        raise Damaged("no version line")
    end = src.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("no end of headers")
    headers = _headers(src.get(at, end - at))
    n = int(headers["content-length"])
    if end + 8 + n > src.size:
        raise Damaged("a record is cut short")
    if src.get(end + 4 + n, 4) != b"\r\n\r\n":
        raise Damaged("the block is not as long as its header says")
    return _checked(Record(at, end + 8 + n, headers, src.get(end + 4, n)))


def salvage(src: Source) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive that pass all checks, and (start, end, reason) of each gap between them."""
    at, gap, reason = 0, None, ""
    marks = {MEMBER: -1, b"WARC/1.": -1}  # where each was last found, so that no stretch is sought through twice
    while at < src.size:
        gzip = src.get(at, 3) == MEMBER
        try:
            r = (_gzip_record if gzip else _plain_record)(src, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            for mark, found in marks.items():
                if found <= at:
                    found = src.find(mark, at + 1)
                    marks[mark] = found if found >= 0 else src.size
            at = min(marks.values())
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield r
        at = r.end
    if gap is not None:
        yield gap, src.size, reason


def _page_id(urn: str | None) -> int | None:
    x = (urn or "").strip("<>").rpartition(":")[2]
    return int(x) if x.lstrip("-").isdigit() else None


SCHEMA = "file string, kind string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_start long, gap_end long, reason string"


class _Read:
    def __init__(self, root: str, payload: bool):
        self.root, self.payload = root, payload

    def __call__(self, it):
        fs, top = S.open_fs(self.root)
        for rb in it:
            for name in rb.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{top}/{name}") as src:
                    for x in salvage(Source(src)):
                        if isinstance(x, tuple):
                            rows.append({"file": name, "kind": "gap", "gap_start": x[0], "gap_end": x[1], "reason": x[2]})
                        elif (kind := x.headers.get("warc-type")) in ("response", "revisit"):
                            length = x.http_header("Content-Length") if kind == "revisit" else None
                            rows.append({"file": name, "kind": "record", "page_id": _page_id(x.headers.get("warc-record-id")), "url": x.headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(length) if length else len(x.payload), "payload_digest": x.headers.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page_id(x.headers.get("warc-refers-to")), "payload": x.payload if self.payload and kind == "response" else None, "gap_start": x.offset, "gap_end": x.end})
                            size += len(x.payload) if self.payload else 200
                        if size > 8 << 20:
                            yield self._rows(rows)
                            rows, size = [], 0
                yield self._rows(rows)

    @staticmethod
    def _rows(rows):
        text, num = pa.string(), pa.int64()
        kinds = {"file": text, "kind": text, "page_id": num, "url": text, "record_type": text, "payload_bytes": num, "payload_digest": text, "refers_to": num, "payload": pa.binary(), "gap_start": num, "gap_end": num, "reason": text}
        return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})


def read_archives(files: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """Records (kind record) and quarantined gaps (kind gap) of the archives named in files' column file, below root.

    For a record gap_start and gap_end are its own bytes. With payload the bodies of responses are returned too.
    """
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(_Read(root, payload), SCHEMA)
