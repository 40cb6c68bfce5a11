"""SimHash near-dedup by tiled exact comparison.

Fingerprints of 64 bits are made per document. Distinct ones, sorted by their population counts, are cut
into tiles of a fixed size. A pair of tiles is compared, by numpy exclusive-or and bit counts, unless the
population counts of the tiles (of the whole, the halves and the quarters of the fingerprint) differ by more
than the radius. Tiles are dealt to a grid: a cell compares the tiles of one group with those of another, so a tile
travels once per group and not once per tile it meets. A cell reports a spanning forest of its links, so many near
copies of one text give few rows, and components are found from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, held, prepare, text_of
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
TILE, BLOCK = 32768, 256
#: Tiles on a side of a grid's cell at most (32 MB of tiles in a cell), and groups of tiles that are made before cells grow.
SIDE, GROUPS = 32, 24
#: Masks whose population counts order the fingerprints: whole, halves, quarters.
MASKS = np.array([2**64 - 1, 2**32 - 1 << 32, 2**32 - 1, *(0xFFFF << s for s in (48, 32, 16, 0))], dtype=np.uint64)
LEVELS = ((0,), (1, 2), (3, 4, 5, 6))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes as a signed number: bit set where over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k]]
    hashed = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row, held. Null text is the empty text."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return held(d.mapInArrow(run, "doc_id long, fp long"))


def _counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] & MASKS[None, :]).astype(np.int16)


def _apart(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """A lower bound on the distance between boxes of population counts (last axis: MASKS)."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return np.maximum.reduce([gap[..., list(level)].sum(axis=-1) for level in LEVELS])


def _boxes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(counts), BLOCK)
    return np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j, pairwise; root stays fully compressed."""
    while True:
        a, b = root[i], root[j]
        rest = a != b
        if not rest.any():
            return
        i, j, a, b = i[rest], j[rest], a[rest], b[rest]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (nxt := root[root]).tobytes() != root.tobytes():
            root[:] = nxt


def forest(fps_a: np.ndarray, fps_b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius between two tiles (or within one, b None) as a forest over positions, b's after a's."""
    same = fps_b is None
    fps_b = fps_a if same else fps_b
    shift = 0 if same else len(fps_a)
    (lo_a, hi_a), (lo_b, hi_b) = _boxes(_counts(fps_a)), _boxes(_counts(fps_b))
    root = np.arange(len(fps_a) + (0 if same else len(fps_b)))
    for k in range(len(lo_a)):
        near = np.flatnonzero(_apart(lo_a[k], hi_a[k], lo_b, hi_b) <= radius)
        if same:
            near = near[near >= k]
        rows = fps_a[k * BLOCK : (k + 1) * BLOCK]
        for g in range(0, len(near), 8):
            at = (near[g : g + 8, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
            at = at[at < len(fps_b)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ fps_b[at][None, :]) <= radius)
            if len(i):
                _join(root, i + k * BLOCK, at[j] + shift)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


LO, HI = [f"lo{k}" for k in range(len(MASKS))], [f"hi{k}" for k in range(len(MASKS))]
TILES = "part int, tile long, nodes binary, fps binary, " + ", ".join(f"{c} int" for c in LO + HI)


def _tiles(distinct: DataFrame, parts: int) -> DataFrame:
    """part, tile, nodes and fps packed, least and largest population counts; at most TILE fingerprints each, held."""
    counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(int(m.astype(np.int64))))) for m in MASKS[[0, 1, 3, 5]]]
    keys = [f"c{i}" for i in range(len(counts))]
    ordered = distinct.select("node", "fp", *(c.alias(k) for c, k in zip(counts, keys, strict=True)))
    ordered = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "fp").select("node", "fp")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tile = part << 32

        def cut():
            nonlocal tile
            nodes, fps = np.empty(0, np.int64), np.empty(0, np.int64)
            for batch in batches:
                nodes = np.append(nodes, batch.column(0).to_numpy())
                fps = np.append(fps, batch.column(1).to_numpy())
                while len(fps) >= TILE:
                    yield one(nodes[:TILE], fps[:TILE])
                    nodes, fps, tile = nodes[TILE:], fps[TILE:], tile + 1
            if len(fps):
                yield one(nodes, fps)

        def one(nodes, fps):
            c = _counts(fps.view(np.uint64))
            return part, tile, nodes.tobytes(), fps.tobytes(), *c.min(axis=0).tolist(), *c.max(axis=0).tolist()

        yield from emit(cut(), TILES)

    return held(ordered.mapInArrow(run, TILES))


def _cells(tiles: DataFrame, radius: int) -> DataFrame:
    """a, b: pairs of groups of tiles, a <= b, whose population counts do not differ by more than the radius."""
    boxes = tiles.groupBy("group").agg(*(F.min(c).alias(c) for c in LO), *(F.max(c).alias(c) for c in HI))
    a = boxes.select(F.col("group").alias("a"), *(F.col(c).alias(f"a_{c}") for c in LO + HI), F.explode(F.sequence(F.col("lo0") - radius, F.col("hi0") + radius)).alias("bits"))
    b = boxes.select(F.col("group").alias("b"), *(F.col(c).alias(f"b_{c}") for c in LO + HI), F.explode(F.sequence("lo0", "hi0")).alias("bits"))
    gap = [F.greatest(F.lit(0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(len(MASKS))]
    near = [sum((gap[k] for k in level[1:]), gap[level[0]]) <= radius for level in LEVELS]
    pairs = a.join(b, "bits").filter("a <= b")
    for condition in near:
        pairs = pairs.filter(condition)
    return pairs.select("a", "b").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, fp), fp distinct and not null -> (u, v): node pairs that link the same nodes as all pairs within radius do.

    Other columns are ignored; an empty table gives no pairs.
    """
    prepare(distinct.sparkSession)
    parts = distinct.count() // TILE + 1
    side = max(1, min(SIDE, parts // GROUPS))
    tiles = _tiles(distinct, parts).withColumn("group", F.floor(F.col("part") / side))
    cells = _cells(tiles, radius)
    body = tiles.select("group", "tile", "nodes", "fps", F.array(*LO).alias("lo"), F.array(*HI).alias("hi"))
    left = cells.join(body, cells["a"] == body["group"]).withColumn("second", F.lit(False))
    right = cells.filter("a < b").join(body, F.col("b") == body["group"]).withColumn("second", F.lit(True))

    def compare(group: pa.Table) -> pa.Table:
        """All near pairs of tiles of a cell; a diagonal cell's tiles among themselves."""
        fps = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["fps"]]
        lo, hi = (np.array(group[c].to_pylist(), np.int64) for c in ("lo", "hi"))
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group["nodes"]])
        first = np.cumsum([0, *map(len, fps)])
        second = np.array(group["second"].to_pylist())
        root = np.arange(len(nodes))
        pairs = [(i, j) for i in np.flatnonzero(~second) for j in np.flatnonzero(second)] if second.any() else [(i, j) for i in range(len(fps)) for j in range(i, len(fps))]
        for i, j in pairs:
            if i != j and _apart(lo[i], hi[i], lo[j], hi[j]) > radius:
                continue
            x, y = forest(fps[i], None if i == j else fps[j], radius)
            if len(x):
                place = np.arange(first[i], first[i + 1])
                place = place if i == j else np.append(place, np.arange(first[j], first[j + 1]))
                _join(root, place[x], place[y])
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": nodes[linked], "v": nodes[root[linked]]})

    columns = ["a", "b", "second", "fps", "nodes", "lo", "hi"]
    met = left.select(*columns).unionByName(right.select(*columns))
    groups = (parts - 1) // side + 1
    return met.repartition(min(groups * (groups + 1) // 2, 100_000), "a", "b").groupBy("a", "b").applyInArrow(lambda t: compare(t), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts, and those without a word, have fingerprint 0 and link like any other. Rows with a
    null doc_id get the component of their fingerprint, null if no row of it has a doc_id. Repeated rows
    repeat in the result; other columns are ignored; an empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col)
    distinct = held(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    # A doc_id may stand on several rows with different texts: nodes are then numbered by fingerprint, not by document.
    joined = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius))
    ids = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = ids.groupBy("component").agg(F.min("node").alias("component_id"))
    of = ids.join(least, "component").select("fp", "component_id")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The input's rows, all columns, with one document of each group of near copies: the smallest doc_id.

    Rows without a doc_id stay. Rows that share a doc_id are one document, which goes if all of them would.
    Null and empty texts, and those without a word, are near copies of each other. Other columns pass through
    whatever their names are; an empty table gives an empty result.
    """
    groups = near_groups(docs, id_col, text_col, radius)
    gone = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone")
    return docs.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").select(*docs.columns)
