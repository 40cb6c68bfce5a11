"""What the training-data operators share: session set-up, shared storage and the chunked exchange.

The chunked exchange carries per-document work past a corpus-wide lookup without a row per word.
Documents are read in chunks of a bounded size. A chunk leaves one blob (its own state, bucket -1) and
one message per hash bucket with its distinct keys, packed into one binary value. A bucket task answers
all messages of its bucket, and the chunk's blob meets the answers in a task of its own. A frequent key
is in a message once per chunk, so no bucket grows with the frequency of a key.
"""

from __future__ import annotations

import gc
import io
import os
import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, as a Java and RE2 pattern: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one chunk of the exchange holds, unless one document is longer.
CHUNK_BYTES = 6 << 20
#: Bytes of text for which one bucket of the exchange is made.
BUCKET_BYTES = 8 << 20
ROWS = "chunk long, bucket long, body binary"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the session share; one of this machine only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or prepare(spark).sparkContext.getCheckpointDir()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound Arrow batches by bytes, and see to a shared checkpoint folder.

    A cluster must name the folder in spark.checkpoint.dir; only a local master gets a temporary one.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakescope-"))
    return spark


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    prepare(frame.sparkSession)
    return frame.checkpoint(eager=True)


def tidy(spark: SparkSession, seconds: float = 2.0) -> None:
    """Let Spark delete the shuffle files of frames that nobody reads any more; else they stay until the driver collects its garbage.

    Spark's cleaner works in the background, so a moment is left to it; a local master's disk does without.
    """
    for _ in range(2):  # what the first round finds dead held the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not spark.sparkContext.master.startswith("local["):
            time.sleep(seconds / 2)


def held(frame: DataFrame) -> DataFrame:
    """The frame on executors' disks, for several readers; lost parts are computed again, so its rows must not depend on order.

    It stays until the session's cache is cleared.
    """
    prepare(frame.sparkSession)
    return frame.persist(StorageLevel.DISK_ONLY)


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def buckets_for(docs: DataFrame, text: str = "text", per: int = BUCKET_BYTES) -> int:
    """How many buckets the corpus needs; one narrow aggregate over the length of all texts."""
    total = docs.agg(F.sum(F.octet_length(text_of(text)).cast("long"))).first()[0] or 0
    return int(total // per) + 4


class _Pickler(pickle.Pickler):
    """Arrays byte by byte: all lowest bytes, then all next ones, which compress far better than whole numbers do."""

    def reducer_override(self, obj):
        if type(obj) is np.ndarray and obj.dtype.kind in "iuf" and obj.dtype.itemsize > 1 and obj.size > 16:
            return _joined, (obj.dtype.str, obj.shape, np.ascontiguousarray(obj).reshape(-1, 1).view(np.uint8).T.tobytes())
        return NotImplemented


def _joined(kind: str, shape: tuple, data: bytes) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(shape)


def pack(value: object, level: int = 3) -> bytes:
    out = io.BytesIO()
    _Pickler(out, protocol=5).dump(value)
    return zstandard.ZstdCompressor(level=level).compress(out.getbuffer())


def unpack(body: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def table(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch from columns in the order of a DDL schema of simple types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(",")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def emit(rows: Iterable[tuple], schema: str, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size; an empty batch for no rows."""
    held, size, any_yet = [], 0, False
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= most or size > 8 << 20:
            yield table(schema, list(zip(*held, strict=True)))
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield table(schema, list(zip(*held, strict=True)) if held else [[] for _ in schema.split(",")])


def _dealt(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """The rows in as many parts, where that is more than the session deals out by itself and then joins as they are small."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key) if parts > usual else rows


def chunked(docs: DataFrame, work: Callable[[list[tuple]], tuple[object, dict[int, object]]], level: int = 3) -> DataFrame:
    """First step of the exchange: chunks of rows (last column: text) to blobs and messages.

    work gets the rows of a chunk and returns (state of the chunk, {bucket: message});
    level is how hard the state is compressed.
    """
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def chunk(rows):
            state, messages = work(rows)
            yield number, -1, pack(state, level)
            for bucket, message in messages.items():
                yield number, bucket, pack(message)

        def chunks():
            nonlocal number
            rows, size = [], 0
            for row in rows_of(batches):
                rows.append(row)
                size += len(row[-1])
                if size >= CHUNK_BYTES:
                    yield from chunk(rows)
                    rows, size, number = [], 0, number + 1
            if rows:
                yield from chunk(rows)

        yield from emit(chunks(), ROWS)

    return stored(docs.mapInArrow(run, ROWS))


def answered(sent: DataFrame, work: Callable[[list[object]], list[object]], parts: int, summed: bool = False) -> DataFrame:
    """Second step: each bucket's messages, together, to one answer per message. parts: tasks, as many as buckets.

    summed: work returns (answers, totals of the bucket); the totals go into a row of their own, chunk -1.
    """
    def run(group: pa.Table) -> pa.Table:
        answers = work([unpack(x) for x in group["body"].to_pylist()])
        chunks, buckets = group["chunk"].to_pylist(), group["bucket"].to_pylist()
        if summed:
            answers = [*answers[0], answers[1]]
            chunks, buckets = [*chunks, -1], [*buckets, buckets[0]]
        return pa.Table.from_batches([table(ROWS, [chunks, buckets, [pack(x) for x in answers]])])

    return _dealt(sent.filter("bucket >= 0"), parts, "bucket").groupBy("bucket").applyInArrow(run, ROWS)


def gathered(sent: DataFrame, answers: DataFrame, work: Callable[[object, dict[int, object]], Iterable[tuple]], schema: str, parts: int, numbered: bool = False) -> DataFrame:
    """Third step: a chunk's state and its answers by bucket, to rows of the given schema, in as many tasks as parts.

    numbered: the state is (number of the chunk, state), for results that name their chunk.
    """
    tidy(sent.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        state, answers = None, {}
        number = group["chunk"][0].as_py()
        for bucket, body in zip(group["bucket"].to_pylist(), group["body"].to_pylist(), strict=True):
            if bucket < 0:
                state = unpack(body)
            else:
                answers[bucket] = unpack(body)
        return pa.Table.from_batches(list(emit(work((number, state) if numbered else state, answers), schema)))

    return _dealt(sent.filter("bucket < 0").unionByName(answers), parts, "chunk").groupBy("chunk").applyInArrow(run, schema)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive spans, one after another."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts unsigned keys by bucket (a mix of the key modulo n), the bucket of each run and the runs' ends."""
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, found, np.append(starts, len(order))
