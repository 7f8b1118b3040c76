"""Staging, request/reply exchanges and rolling hashes that the operators of this subpackage share.

Everything that must outlive a task goes to the folder named by ``spark.checkpoint.dir``: executors and the driver
share it, so a lost executor costs a re-run of its tasks only. Nothing is kept in an executor's own folder.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text in one staged batch, at least and at most, and rows at most. A batch sends one row to each exchange
#: partition, so batches grow with the square root of the input and these rows do not become tiny.
BATCH_BYTES, MOST_BYTES, BATCH_ROWS = 4 << 20, 512 << 20, 1 << 18
#: Bytes of requests that one exchange partition should hold.
PART_BYTES = 12 << 20
#: Bytes of requests that a worker hands over at once.
SENT_BYTES = 1 << 20

M64 = (1 << 64) - 1
_LIBC = ctypes.CDLL(None)


# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir; a folder of the warehouse is set as that only where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        # unset: the warehouse, which executors share too
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_state"
        top = "file://" + top[5:] if top.startswith("file:/") and not top.startswith("file://") else top
        spark.conf.set("spark.checkpoint.dir", top)
    if "://" not in top and not top.startswith("file:"):
        top = "file://" + top
    return f"{top.rstrip('/')}/siltmark-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system for a URI (file, hdfs, s3, gs) and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    """Deletes a folder below the shared one, if it is there."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def materialised(df: DataFrame, path: str) -> DataFrame:
    """Writes df to path and reads it again: cuts lineage, and lets what df was made from be deleted."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- batches


def batch_bytes(df: DataFrame, least: int = BATCH_BYTES) -> int:
    """Bytes of a batch for so much input as the plan's statistics tell: 4 MB up to 2 GB, 28 MB at 100 GB, 512 MB from 36 TB."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(MOST_BYTES, int(90 * min(known, 1 << 50) ** 0.5))) if known < 1 << 60 else least


def stage(df: DataFrame, path: str, batch_bytes: int = BATCH_BYTES, weight: str = "text", derive: Callable[[pa.Table], bytes] | None = None) -> DataFrame:
    """Writes df as batches, one row each: (batch, n_rows, n_bytes, data[, keys]), data being an Arrow stream of all columns.

    ``weight`` is the column that a batch's size is counted by. A batch is written once, so that each later pass sees
    the same rows in the same order under the same number. ``derive`` makes keys of a batch's table, which later passes
    find in the table's metadata instead of making them anew.
    """
    schema = "batch long, n_rows long, n_bytes long, data binary" + ", keys binary" * bool(derive)
    out = df.mapInArrow(_Pack(batch_bytes, weight, derive), schema)
    # sizes are looked at after each row, by default after 100, which are 100 batches in a task's memory; a reader takes a row group at once
    write = out.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).option("parquet.block.row.count.limit", max(1, (32 << 20) // batch_bytes))
    write.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 8).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class _Pack:
    def __init__(self, batch_bytes: int, weight: str, derive: Callable[[pa.Table], bytes] | None):
        self.batch_bytes, self.weight, self.derive = batch_bytes, weight, derive

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, size, rows = TaskContext.get().partitionId() << 24, 0, [], 0, 0
        for rb in it:
            lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(rb.column(self.weight)), 0)).astype(np.int64) + 16
            at, ends = 0, np.cumsum(lens)
            while at < rb.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + self.batch_bytes - size, "left")) + 1
                to = min(to, rb.num_rows, at + BATCH_ROWS - rows)
                held.append(rb.slice(at, to - at))
                size, rows = size + int(ends[to - 1]) - before, rows + to - at
                at = to
                if size >= self.batch_bytes or rows >= BATCH_ROWS:
                    yield self._row(first + seq, held, size)
                    seq, held, size, rows = seq + 1, [], 0, 0
        if held:
            yield self._row(first + seq, held, size)

    def _row(self, batch: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        row = {"batch": pa.array([batch], pa.int64()), "n_rows": pa.array([t.num_rows], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        if self.derive:
            row["keys"] = pa.array([self.derive(t)], pa.binary())
        return pa.RecordBatch.from_pydict(row)


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def release(trim: bool = False) -> None:
    """Gives back what this worker does not use: it outlives its tasks, and the next stage's need the memory. trim: the C heap too."""
    pa.default_memory_pool().release_unused()
    if trim:
        _POWERS.clear()
        gc.collect()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The staged batches of a task, one at a time."""
    try:
        for rb in it:
            for k in range(rb.num_rows):
                t = unpack(rb.column("data")[k].as_buffer()) if "data" in rb.schema.names else pa.table({})
                if "keys" in rb.schema.names:
                    t = t.replace_schema_metadata({b"keys": rb.column("keys")[k].as_py()})
                yield rb.column("batch")[k].as_py(), t
            release()
    finally:
        release(trim=True)


def column_bytes(t: pa.Table, name: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as (bytes of all rows, row offsets with one more at the end, nulls). A null has no bytes."""
    col = t.column(name)
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    nulls = np.asarray(col.is_null())
    col = col.cast(pa.large_binary()) if not nulls.any() else pa.compute.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64), nulls


def int_column(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A long column as (values, with 0 for null; nulls)."""
    col = pa.concat_arrays(t.column(name).chunks) if t.column(name).num_chunks else pa.array([], pa.int64())
    return np.asarray(pa.compute.fill_null(col, 0)).astype(np.int64), np.asarray(col.is_null())


# ---------------------------------------------------------------- request / reply exchange


def parts_for(spark: SparkSession, n_bytes: float) -> int:
    """Exchange partitions for so many bytes of requests: by size, and enough for all of this session's tasks."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // PART_BYTES), 4))


def exchange(staged: DataFrame, emit: Callable, resolve: Callable, parts: int, path: str) -> str:
    """Each batch asks, each partition answers all that was asked there, each batch can read its answers.

    emit(batch, table) yields (part, request bytes) with 0 <= part < parts; resolve(part, [request bytes]) returns as
    many reply bytes. Columns that emit does not need may be dropped from staged. A batch sends at most one row to a part, whatever number of its rows hold a key, so one key that
    is in a third of all documents costs a part no more than one entry a batch. Replies are written to ``path`` by
    batch; see replies().
    """
    spark = staged.sparkSession
    asked = staged.drop("n_rows", "n_bytes").mapInArrow(_Emit(emit), "p int, batch long, request binary")
    told = asked.groupBy("p").applyInArrow(_resolver(resolve), "batch long, p int, reply binary")
    told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch").write.mode("overwrite").option("compression", "zstd").partitionBy("batch").parquet(path)
    return path


class _Emit:
    def __init__(self, emit: Callable):
        self.emit = emit

    def __call__(self, it):
        for b, t in batches(it):
            held, size = [], 0
            for p, data in self.emit(b, t):
                held.append((p, data))
                size += len(data)
                if size >= SENT_BYTES:
                    yield self._rows(b, held)
                    held, size = [], 0
            if held:
                yield self._rows(b, held)

    def _rows(self, b: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in held], pa.int32()), "batch": pa.array([b] * len(held), pa.int64()), "request": pa.array([data for _, data in held], pa.binary())})


def _resolver(resolve: Callable) -> Callable:
    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        p = t.column("p")[0].as_py()
        out = resolve(p, [x.as_buffer() for x in t.column("request")])
        release(trim=True)
        return pa.table({"batch": t.column("batch"), "p": t.column("p"), "reply": pa.array(out, pa.binary())})

    return answer


def replies(path: str, batch: int) -> dict[int, bytes]:
    """What the exchange at path answered to a batch, by part."""
    fs, at = open_fs(f"{path}/batch={batch}")
    out: dict[int, bytes] = {}
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return out
    for f in fs.get_file_info(pafs.FileSelector(at)):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as src:
                t = pq.ParquetFile(src).read(columns=["p", "reply"])
            out.update(zip(t.column("p").to_pylist(), t.column("reply").to_pylist(), strict=True))
    return out


# ---------------------------------------------------------------- hashes


def _odd(seed: int) -> int:
    return int(np.random.Generator(np.random.PCG64(seed)).integers(1 << 62, 1 << 63)) * 2 + 1 & M64


BYTE_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (_odd(11), _odd(12))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n > 8 << 20:  # not kept: a very long text must not stay in every worker
            return p[:n]
        _POWERS[base] = have = p
    return have[:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, one more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=out[1:])
    np.add.accumulate(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], wherever it lies."""
    inverse = pow(base, -1, 1 << 64)
    return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all rows: byte bounds, row and position in the row of each, and hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        rows = len(off) - 1
        # a space after each row keeps words of neighbours apart
        self.data = np.full(len(raw) + rows, 0x20, np.uint8)
        self.row_start = off + np.arange(rows + 1)
        if len(raw):
            keep = np.ones(len(self.data), bool)
            keep[self.row_start[1:] - 1] = False
            self.data[keep] = LOWER[raw] if lower else raw
        solid = np.zeros(len(self.data) + 2, np.int8)
        solid[1:-1] = ~WHITE[self.data]
        step = np.diff(solid)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.row = np.searchsorted(self.row_start, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.pos = np.arange(len(self.start)) - self.first[self.row]

    def hashes(self) -> np.ndarray:
        p = prefix_hash(BYTE_VALUES[self.data], BASES[0])
        return span_hash(p, self.start, self.end, BASES[0])

    def windows(self, hashes: np.ndarray, n: int, base: int = BASES[1], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the n-word windows that stay in their row, their hashes), at the given starts or at all."""
        if at is None:
            at = np.flatnonzero(self.row[: max(0, len(hashes) - n + 1)] == self.row[n - 1 :]) if len(hashes) >= n else np.zeros(0, np.int64)
        return at, span_hash(prefix_hash(hashes, base), at, at + n, base)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The exchange partition of a hash, from its upper 32 bits: rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def slices(sorted_hashes: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of sorted hashes that go to one part."""
    if not len(sorted_hashes):
        return
    p = part_of(sorted_hashes, parts)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(p[a]), int(a), int(b)


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1)) if len(sorted_values) else np.zeros(0, np.int64)
