"""Exact dedup by a tree-merge of sorted digest runs.

Every partition cuts its digests into key ranges and leaves one sorted run per range: distinct digests, each with
its best identifier and how often it occurs. In round after round, FAN neighbouring nodes' runs of a range meet
and are merged into one, so after log(nodes) rounds a range has one run. An entry is a digest verified by the
text's length and a second hash; at every level the best identifier of an entry stays. A text with very many
copies costs a round one entry per node, and no task ever sees its rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, held, prepare, stored, table, text_of

FAN = 8
#: Rows that a run of the first level holds, and distinct digests for which one key range is made.
RUN, RANGE = 250_000, 250_000
#: Groups of more rows than this, of which there are at most rows / HOT, are met by broadcast.
HOT, MOST_HOT = 10_000, 100_000
#: Groups up to which all of them are broadcast (under 64 MB), so that no row moves.
FEW = 500_000
#: The digest, and what verifies it: the length and a second hash of the text.
KEYS = ["digest", "check", "n_bytes"]
RUNS = "node long, range long, body binary"
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("check", "<i8"), ("n_bytes", "<i8"), ("null", "<i1"), ("doc_id", "<i8"), ("uid", "<i8"), ("n", "<i8"), ("same", "<i8")])
SORTED_BY = ("n_bytes", "check", "d3", "d2", "d1", "d0")
MERGED = "digest binary, check long, n_bytes long, keep long, uid long, n long, same long"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, digest, check, n_bytes of every row, stored; null text counts as empty."""
    t = text_of(text_col)
    return stored(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
        digest_of(t).alias("digest"), F.xxhash64(t).alias("check"), F.octet_length(t).cast("long").alias("n_bytes"),
    ))


def merge(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Sorted runs to one sorted run: an entry per verified digest, with its best (doc_id, uid), n and same.

    same: how many of the n rows have the best doc_id. Stable sorts of what is a row of sorted runs are merges.
    """
    a = np.concatenate(runs)
    if not len(a):
        return a
    sign = -1 if largest else 1
    # A null doc_id stands below all others.
    a = a[np.lexsort((a["uid"], sign * a["doc_id"], sign * -a["null"], *(a[k] for k in SORTED_BY)))]
    new = np.ones(len(a), bool)
    new[1:] = np.logical_or.reduce([a[k][1:] != a[k][:-1] for k in SORTED_BY])
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    best = a[first]
    ties = (a["doc_id"] == best["doc_id"][of]) & (a["null"] == best["null"][of])
    best["same"] = np.add.reduceat(np.where(ties, a["same"], 0), first)
    best["n"] = np.add.reduceat(a["n"], first)
    return best


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of digests as entries of one row each."""
    out = np.zeros(batch.num_rows, ENTRY)
    words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
    for k in range(4):
        out[f"d{k}"] = words[:, k]
    ids = batch.column("doc_id")
    out["null"], out["doc_id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    for name in ("check", "n_bytes", "uid"):
        out[name] = batch.column(name).to_numpy()
    out["n"] = out["same"] = 1
    return out


def merged(rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """rows of digests -> one row per distinct text: KEYS, keep (the best doc_id), uid (its row), n, same.

    keep: "smallest" or "largest" doc_id; same: how many rows have it. Equal digests whose lengths or second
    hashes differ stay apart. No row gives no row.
    """
    largest = {"smallest": False, "largest": True}[keep]
    spark = prepare(rows.sparkSession)
    total = rows.count()
    ranges = total // RANGE + 1

    def leaves(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def runs():
            node, held, size = TaskContext.get().partitionId() << 20, [], 0
            for batch in batches:
                held.append(_entries(batch))
                size += batch.num_rows
                if size >= RUN:
                    yield from cut(node, merge(held, largest))
                    node, held, size = node + 1, [], 0
            if held:
                yield from cut(node, merge(held, largest))

        def cut(node, run):
            of = ((run["d0"] >> np.uint64(32)).astype(np.int64) * ranges) >> 32
            found, starts = np.unique(of, return_index=True)
            for r, i, j in zip(found.tolist(), starts, np.append(starts[1:], len(run)), strict=True):
                yield node, r, run[i:j].tobytes()

        yield from emit(runs(), RUNS)

    def exchange(group: pa.Table) -> pa.Table:
        run = merge([np.frombuffer(b.as_buffer(), ENTRY) for b in group["body"]], largest)
        return pa.Table.from_batches([table(RUNS, [[group["node"][0].as_py()], [group["range"][0].as_py()], [run.tobytes()]])])

    def opened(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                run = np.frombuffer(body.as_buffer(), ENTRY)
                raw = np.stack([run[f"d{k}"] for k in range(4)], axis=1).astype(">u8").tobytes()
                names = [pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())]
                names += [pa.array(run[k].astype(np.int64)) for k in ("check", "n_bytes")]
                names.append(pa.array(run["doc_id"].astype(np.int64), mask=run["null"].astype(bool)))
                names += [pa.array(run[k].astype(np.int64)) for k in ("uid", "n", "same")]
                yield pa.record_batch(names, names=[c.split()[0] for c in MERGED.split(", ")])

    runs = held(rows.mapInArrow(leaves, RUNS))
    # Nodes are numbered without gaps, so the rounds are as few as the runs allow.
    nodes = sorted(r[0] for r in runs.select("node").distinct().collect())
    place = spark.createDataFrame([(k, i) for i, k in enumerate(nodes)], "node long, place long")
    runs = runs.join(F.broadcast(place), "node").select(F.col("place").alias("node"), "range", "body")
    left, wide = len(nodes), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while left > 1:
        left = -(-left // FAN)
        runs = runs.withColumn("node", F.floor(F.col("node") / FAN))
        runs = runs.repartition(min(left * ranges, max(wide, ranges)), "node", "range").groupBy("node", "range").applyInArrow(exchange, RUNS)
    return held(runs.select("body").mapInArrow(opened, MERGED))


def met(rows: DataFrame, groups: DataFrame, stays=None) -> DataFrame:
    """rows with KEYS, left-joined to their groups; of those that match, only the ones for which stays holds (None: all).

    Up to FEW groups are broadcast, after they were counted. Of more, those so large that their rows must not
    meet in one task are broadcast (at most MOST_HOT), and the others are met by a shuffled join.
    """
    size = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    kept = (lambda frame: frame.filter(F.col("n").isNull() | stays)) if stays is not None else (lambda frame: frame)
    if size[0] <= FEW:
        return kept(rows.join(F.broadcast(groups), KEYS, "left"))
    hot = F.broadcast(groups.filter(F.col("n") > max(HOT, size[1] // MOST_HOT)))
    rest = rows.join(hot.select(*KEYS), KEYS, "left_anti").join(groups.hint("shuffle_merge"), KEYS, "left")
    return kept(rows.join(hot, KEYS)).unionByName(kept(rest))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts, the one with the smallest (or largest) doc_id stays; of several such
    rows, exactly one. Null text equals empty text. A null doc_id stands below all others, repeated rows repeat.
    Texts of any length are hashed whole. Other columns are ignored; an empty table gives an empty result.
    """
    rows = digests(docs, id_col, text_col)
    groups = merged(rows, keep).filter("n > 1").select(*KEYS, "keep", F.col("uid").alias("best"), "n")
    return met(rows, groups).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("best"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The input's rows, all columns, without those that repeat the text of a kept row.

    Null text equals empty text, a null doc_id stands below all others. Rows that share doc_id and text count as
    one document: one stays. Columns pass through whatever their names are; an empty table gives an empty result.
    Where groups are few enough to be broadcast, texts are read and written where they lie.
    """
    groups = merged(digests(docs, id_col, text_col), keep).filter("n > 1").select(*KEYS, "keep", "same", "n")
    t = text_of(text_col)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), digest_of(t).alias("digest"), F.xxhash64(t).alias("check"), F.octet_length(t).cast("long").alias("n_bytes"))
    out = met(marked, groups, F.col("id").eqNullSafe(F.col("keep")))
    if groups.filter("same > 1").isEmpty():
        return out.select("row.*")
    once = out.filter("same > 1").dropDuplicates(KEYS)
    return out.filter("same is null or same = 1").unionByName(once).select("row.*")
