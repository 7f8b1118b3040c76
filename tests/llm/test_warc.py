"""The archive round trip, and the salvage reader over damaged archives."""

import base64
import hashlib
import io

import pyarrow.parquet as pq
import pytest

from siltmark.llm import _shared as S, warc
from siltmark.llm.queries import QUERIES


class Src(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def pages_of(payloads, compress):
    put = warc.member if compress else bytes
    return [put(warc.page_record(k, f"http://x/{k}", p, warc.base32_sha1(p), None, "2024-01-01T00:00:00Z")) for k, p in enumerate(payloads)]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_records_after_damage(compress):
    parts = pages_of([b"first" * 50, b"second" * 80, b"", b"WARC/1.1 inside \x1f\x8b\x08 text" * 9, b"last" * 70], compress)
    whole = b"".join(parts)
    got = list(warc.salvage(warc.Source(Src(whole), block=64)))
    assert [r.payload[:4] for r in got] == [b"firs", b"seco", b"", b"WARC", b"last"]
    # damage in the middle of the second record
    at = len(parts[0]) + len(parts[1]) // 2 + 40
    bad = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
    got = list(warc.salvage(warc.Source(Src(bad))))
    gaps = [x for x in got if isinstance(x, tuple)]
    assert [x[:2] for x in gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    assert [r.payload[:4] for r in got if not isinstance(r, tuple)] == [b"firs", b"", b"WARC", b"last"]
    # cut short, and rubbish before the start
    cut = b"rubbish" + whole[:-5]
    got = list(warc.salvage(warc.Source(Src(cut))))
    assert got[0][:2] == (0, 7) and got[-1][:2] == (7 + len(whole) - len(parts[-1]), len(cut))
    assert len([r for r in got if not isinstance(r, tuple)]) == 4
    assert list(warc.salvage(warc.Source(Src(b"")))) == []


def brute(rows, least=0):
    best = {}
    for r in rows:
        p = (r["html"] or "").encode()
        if len(p) >= least:
            best[p] = max(best.get(p, -1), r["page_id"])
    out = {}
    for r in rows:
        p = (r["html"] or "").encode()
        to = best.get(p, r["page_id"])
        out[r["page_id"]] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to == r["page_id"] else "revisit", None if to == r["page_id"] else to)
    return out


def test_op8_against_brute_force(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op8_warc_round_trip"](spark, sf).collect()}
    assert got == brute(rows)


def test_edges(spark):
    schema = "page_id long, url string, html string, digest int, payload string, to int, n int"
    rows = [(1, "u", None, 1, "", 1, 1), (2, None, "", 1, "", 1, 1), (3, "a\r\nb", "same", 1, "", 1, 1), (4, "c", "same", 1, "", 1, 1), (4, "c", "same", 1, "", 1, 1), (5, "d", "é" * 100_000, 1, "", 1, 1), (None, "n", "same", 1, "", 1, 1)]
    root = S.shared_root(spark)
    files = S.materialised(warc.write_archives(spark.createDataFrame(rows, schema), f"{root}/w", max_bytes=500), f"{root}/m")
    got = warc.read_archives(files, f"{root}/w", payload=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == 7
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(0, "revisit", 4, 4), (1, "revisit", 2, 0), (2, "response", None, 0), (3, "revisit", 4, 4), (4, "response", None, 4), (4, "response", None, 4), (5, "response", None, 200_000)]
    none = S.materialised(warc.write_archives(spark.createDataFrame([], schema), f"{root}/e"), f"{root}/em")
    assert warc.read_archives(none, f"{root}/e").count() == 0
    root = S.shared_root(spark)
    files = S.materialised(warc.write_archives(spark.createDataFrame(rows, schema), f"{root}/w", min_bytes=1, compress=False), f"{root}/m")
    got = warc.read_archives(files, f"{root}/w").collect()
    assert {r.page_id: r.record_type for r in got if r.page_id in (1, 2)} == {1: "response", 2: "response"}
