"""Token-id files by plane shuffling: blocks of ids are transposed to byte or bit planes, each compressed by zstandard.

File layout (integers little-endian)::

    magic | planes of chunk 0 | planes of chunk 1 | ... | document index | footer (zstd of JSON) | footer length u64 | magic

A chunk holds ``chunk_ids`` consecutive ids (the last fewer); its planes are stored one after the other, and an all-zero
plane has length 0. The footer's chunk index gives each chunk's offset, number of ids and plane lengths, so that any
range of ids is read without the rest. The document index holds key, first id, number of ids and a mark of a null key of
each document.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _shared as S
from .tokens import encoded

MAGIC = b"SMPLANE2"
CHUNK_IDS = 1 << 16


def shuffle(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block of 32-bit ids: 4 of bytes, or 32 of bits, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if mode == "byte":
        return [np.ascontiguousarray(p).tobytes() if p.any() else b"" for p in raw]
    planes = []
    for p in raw:
        for k in range(8):
            bit = (p >> k) & 1
            planes.append(np.packbits(bit).tobytes() if bit.any() else b"")
    return planes


def unshuffle(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    for k, p in enumerate(planes):
        if p and mode == "byte":
            raw[k] = np.frombuffer(p, np.uint8)
        elif p:
            raw[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, mode: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        if mode not in ("byte", "bit"):
            raise ValueError(f"planes are of bytes or bits, not {mode!r}")
        self.out, self.mode, self.chunk_ids = out, mode, chunk_ids
        self.z = zstandard.ZstdCompressor(level=level)
        self.at = self._put(MAGIC)
        self.held, self.n_held, self.chunks, self.docs, self.n_ids = [], 0, [], [], 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> None:
        """Documents with their numbers of ids and their ids one after the other; null marks keys that are null."""
        starts = self.n_ids + np.cumsum(counts) - counts
        self.docs.append(np.stack([keys, starts, counts, np.zeros(len(keys), np.int64) if null is None else null]).astype("<i8"))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk_ids:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.chunk_ids * self.chunk_ids
            for k in range(0, whole, self.chunk_ids):
                self._chunk(ids[k : k + self.chunk_ids])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.z.compress(p) if p else b"" for p in shuffle(ids, self.mode)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.at += self._put(b"".join(planes))

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((4, 0), "<i8")
        index = self.z.compress(docs.tobytes())
        foot = {"mode": self.mode, "chunk_ids": self.chunk_ids, "n_ids": self.n_ids, "n_docs": docs.shape[1], "docs": [self.at, len(index)], "chunks": self.chunks}
        self._put(index)
        foot = self.z.compress(json.dumps(foot).encode())
        self._put(foot + len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to a file: documents() is the index, ids(start, n) any range of ids."""

    def __init__(self, src):
        self.src, self.z = src, zstandard.ZstdDecompressor()
        size = src.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self.z.decompress(self._at(size - 16 - n, n)))
        self.n_ids = self.foot["n_ids"]
        self._kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, offset: int, n: int) -> bytes:
        self.src.seek(offset)
        return self.src.read(n)

    def documents(self) -> np.ndarray:
        """4 rows: key, first id, number of ids, whether the key is null."""
        return np.frombuffer(self.z.decompress(self._at(*self.foot["docs"])), "<i8").reshape(4, -1)

    def chunk(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            at, n, lens = self.foot["chunks"][k]
            data, planes, p = self._at(at, sum(lens)), [], 0
            for x in lens:
                planes.append(self.z.decompress(data[p : p + x]) if x else b"")
                p += x
            self._kept = (k, unshuffle(planes, n, self.foot["mode"]))
        return self._kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, "<u4")
        size = self.foot["chunk_ids"]
        got = []
        for k in range(start // size, (start + n - 1) // size + 1):
            c = self.chunk(k)
            got.append(c[max(0, start - k * size) : start + n - k * size])
        return np.concatenate(got)


class _Write:
    def __init__(self, root: str, tokenizer: str, end_id: int | None, mode: str, chunk_ids: int):
        self.root, self.tokenizer, self.end_id, self.mode, self.chunk_ids = root, tokenizer, end_id, mode, chunk_ids

    def __call__(self, it):
        fs, top = S.open_fs(self.root)
        writer, first = None, None
        part = TaskContext.get().partitionId()
        for rb in it:
            keys, null = np.asarray(pa.compute.fill_null(rb.column(0), 0)).astype(np.int64), np.asarray(rb.column(0).is_null())
            for at, ids, counts in encoded(self.tokenizer, rb.column(1)):
                if self.end_id is not None:
                    ends = np.cumsum(counts)
                    ids, counts = np.insert(ids, ends, self.end_id), counts + 1
                if writer is None:
                    # an attempt writes under a name of its own, and the manifest names the attempt that counts
                    fs.create_dir(top)
                    name = f"part-{part:08d}-{uuid.uuid4().hex}.ids"
                    out = fs.open_output_stream(f"{top}/{name}")
                    writer, first = Writer(out, self.mode, self.chunk_ids), rb.column(0)[0].as_py()
                writer.add(keys[at : at + len(counts)], counts, ids, null[at : at + len(counts)])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "part": pa.array([part], pa.int64()), "first_key": pa.array([first], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})


class _Read:
    def __init__(self, root: str):
        self.root = root

    def __call__(self, it):
        fs, top = S.open_fs(self.root)
        for rb in it:
            for name, base in zip(rb.column("file").to_pylist(), rb.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as src:
                    r = Reader(src)
                    keys, starts, counts, null = r.documents()
                    crc = [zlib.crc32(r.ids(a, n).tobytes()) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, mask=null > 0), "start": pa.array(starts + base), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})


def write_ids(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", mode: str = "byte", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Encodes every whole text, appends end_id, writes ids by ascending key to files below root; returns their manifest.

    A null text is empty; null keys come first; equal keys are ordered by text, so reruns agree. Other columns are
    ignored; an empty table writes no file. The manifest (file, part, first_key, n_ids) is in the order of the ids.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    return rows.mapInArrow(_Write(root, tokenizer, end_id, mode, chunk_ids), "file string, part long, first_key long, n_ids long")


def read_ids(spark, root: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The driver sees one row a file."""
    files = sorted(manifest.collect(), key=lambda r: r.part)
    base, rows = 0, []
    for f in files:
        rows.append((f.file, base))
        base += f.n_ids
    index = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return index.mapInArrow(_Read(root), "doc_id long, start long, n_tokens long, ids_crc32 long")
