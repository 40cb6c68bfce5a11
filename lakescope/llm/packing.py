"""Best-fit packing of tokenized documents by the linear grouping scheme.

The plan depends on the documents' lengths alone, and so on a histogram with one entry per length up to the
capacity. Large lengths are grouped by equal cardinality and rounded up to their group's largest; few-size
configurations are optimised by column generation; actual lengths take the places of the rounded ones; what is
left over and all small ones go, largest first, where they fit best. Places are given to ranges of documents
of one length, so a plan's size is bounded by the capacity and not by the number of documents.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, buckets_for, chunked, emit, gathered, pack, prepare, rows_of, spans, text_of, unpack
from .tokencount import MARK, Units, drops_blanks, load, splitter

CAPACITY, GROUPS, SMALL = 4096, 48, 8
END = 1
#: Pre-tokens whose ids a worker keeps.
KEEP = 200_000
LENGTHS = "chunk long, length long, n long"
PIECES = "row string, piece int, start long, length long, ids binary, sequence_id long, offset long"


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the largest worth."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(worth > 1e-12):
        s = int(sizes[k])
        for at in range(s, capacity + 1, s):
            end = min(at + s, capacity + 1)
            new = best[at - s : end - s] + worth[k]
            up = new > best[at:end] + 1e-12
            best[at:end][up], last[at:end][up] = new[up], k
    counts, at = np.zeros(len(sizes)), capacity
    while at > 0:
        if last[at] < 0:
            at -= 1
            continue
        counts[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(counts @ worth), counts


def configurations(sizes: np.ndarray, needs: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many sequences): the linear optimum over configurations, rounded down.

    Column generation ends at the optimum, or after so many rounds with the best basis found, which costs only
    sequences: what a plan leaves over is best-fit. A column that would leave no invertible basis ends it too.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, price = inverse @ needs, inverse.sum(axis=0)
        value, column = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        leaving = int(np.argmin(ratio))
        if abs(step[leaving]) < 1e-9 * max(1.0, np.abs(step).max()):
            break
        basis[:, leaving] = column
    x = np.linalg.inv(basis) @ needs
    out, left = [], needs.copy()
    for k in range(n):
        column = np.round(basis[:, k]).astype(int)
        times = int(x[k] + 1e-6)
        if times > 0 and (most := int(min(left[i] // column[i] for i in np.flatnonzero(column)))) > 0:
            out.append((column, min(times, most)))
            left = left - column * min(times, most)
    return out


class Plan:
    """Places for lengths: (length, first rank, count, first sequence, offset), a range of documents each."""

    def __init__(self, capacity: int):
        self.capacity, self.places, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = {}
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.room: list[int] = []

    def put(self, length: int, count: int, sequence: int, room: int) -> None:
        first = self.rank.get(length, 0)
        self.rank[length] = first + count
        self.places.append((length, first, count, sequence, self.capacity - room))

    def give(self, room: int, sequence: int, count: int) -> None:
        if room > 0 and count > 0:
            if not self.free.get(room):
                insort(self.room, room)
                self.free[room] = []
            self.free[room].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            k = bisect_left(self.room, length)
            if k == len(self.room):
                room, sequence, n = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += n
            else:
                room = self.room[k]
                sequence, n = self.free[room].pop()
                if not self.free[room]:
                    self.room.pop(k)
            used = min(n, count)
            self.put(length, used, sequence, room)
            self.give(room - length, sequence, used)
            self.give(room, sequence + used, n - used)
            count -= used

    def configure(self, column: np.ndarray, times: int, groups: list[list[list[int]]]) -> None:
        """times new sequences with column[i] documents of group i each; groups hold [length, count] runs."""
        ranges = [(self.sequences, times, self.capacity)]
        self.sequences += times
        for i in np.flatnonzero(column):
            for _ in range(int(column[i])):
                after = []
                for sequence, n, room in ranges:
                    while n:
                        run = groups[i][-1]
                        used = min(n, run[1])
                        self.put(run[0], used, sequence, room)
                        after.append((sequence, used, room - run[0]))
                        sequence, n = sequence + used, n - used
                        run[1] -= used
                        if not run[1]:
                            groups[i].pop()
                ranges = after
        for sequence, n, room in ranges:
            self.give(room, sequence, n)


def planned(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan for a histogram of lengths from 1 to the capacity."""
    plan = Plan(capacity)
    large = [(size, histogram[size]) for size in sorted(histogram, reverse=True) if size > capacity // SMALL]
    total = sum(n for _, n in large)
    runs: list[list[list[int]]] = []
    if total:
        k = min(groups, total)
        done = 0
        for size, n in large:
            while n:
                g = done * k // total
                if g == len(runs):
                    runs.append([])
                used = min(n, -(-(g + 1) * total // k) - done)
                runs[g].append([size, used])
                done, n = done + used, n - used
        same: dict[int, list] = {}  # groups whose largest lengths are equal are one
        for g in runs:
            same.setdefault(g[0][0], []).extend(g)
        runs = list(same.values())
        needs = np.array([sum(n for _, n in g) for g in runs], float)
        for g in runs:
            g.reverse()
        for column, times in sorted(configurations(np.array(list(same)), needs, capacity), key=lambda c: -c[1]):
            plan.configure(column, times, runs)
    left: dict[int, int] = {size: n for size, n in histogram.items() if size <= capacity // SMALL}
    for g in runs:
        for size, n in g:
            left[size] = left.get(size, 0) + n
    for size in sorted(left, reverse=True):
        plan.best_fit(size, left[size])
    return plan


class Encoder:
    """The ids of texts. A tokenizer that drops white space sees each distinct pre-token of a chunk once, another whole texts.

    The ids of the first KEEP pre-tokens are kept for further chunks; the frequent ones are among them.
    """

    def __init__(self, path: str):
        self.t, self.path = load(path), path
        self.whole = not drops_blanks(self.t)
        self.kept: dict[str, bytes] = {}

    def ids(self, names: list[str]) -> list[bytes]:
        """The ids of pre-tokens, each as its 32-bit numbers."""
        kept, tokenize, out = self.kept, self.t.model.tokenize, []
        for name in names:
            got = kept.get(name)
            if got is None:
                got = array("I", [self.t.token_to_id(name[1:])] if name[0] == MARK else [x.id for x in tokenize(name)]).tobytes()
                if len(kept) < KEEP:
                    kept[name] = got
            out.append(got)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and how many each has."""
        if self.whole:
            lists = [e.ids for e in self.t.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        runs = Units()
        parts = [runs.numbers(x) for x in texts]
        words, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        names, inner, sizes = splitter(self.path).split(list(runs.at))
        found = self.ids(names)
        ids, per = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Ids by run, from those by pre-token; then by text, from those by run.
        by_run = ids[spans((np.cumsum(per) - per)[inner], per[inner])]
        lengths = _sums(per[inner], sizes)
        return by_run[spans((np.cumsum(lengths) - lengths)[flat], lengths[flat])], _sums(lengths[flat], words)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of values, of so many values each."""
    sums, ends = np.append(0, np.cumsum(values)), np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per piece: key columns, piece, start, length, ids (little-endian unsigned 32 bits), sequence_id, offset.

    A document is its ids and then the end id; only one longer than the capacity is cut, into full pieces and a
    last one. Null text is empty and so a piece of one id. Repeated rows are packed repeatedly; null keys stay
    null; other columns are ignored; an empty table gives an empty result.

    Texts are encoded once, in chunks that keep their ids and report how often each length occurs. The plan is made
    on the driver from the histogram of lengths, of at most capacity entries; chunks learn where their ranks begin.
    """
    spark = prepare(docs.sparkSession)
    n = buckets_for(docs, text_col)

    def pieces(lengths):
        for i, size in enumerate(lengths.tolist()):
            for piece, start in enumerate(range(0, size, capacity)):
                yield i, piece, start, min(capacity, size - start)

    def encode(rows):
        flat, lengths = encoder(tokenizer).encode([r[1] for r in rows])
        flat = flat.astype(np.uint16) if flat.max(initial=0) < 65536 else flat
        return ([r[0] for r in rows], lengths, flat), {0: np.unique([p[3] for p in pieces(lengths + 1)], return_counts=True)}

    def place(state, answers):
        rows, lengths, flat = state
        rank = dict(zip(*(a.tolist() for a in answers[0]), strict=True))
        plan_key, plan_rank, plan_sequence, plan_offset = plan_table.value
        first = np.cumsum(lengths) - lengths
        made = (-1, None)
        for i, piece, start, size in pieces(lengths + 1):
            if made[0] != i:
                made = i, np.append(flat[first[i] : first[i] + lengths[i]], np.uint32(end)).astype("<u4")
            r = rank[size]
            rank[size] = r + 1
            k = int(np.searchsorted(plan_key, (size << 40) + r, "right")) - 1
            yield rows[i], piece, start, size, made[1][start : start + size].tobytes(), int(plan_sequence[k] + r - plan_rank[k]), int(plan_offset[k])

    def lengths_of(batches):
        yield from emit(((chunk, *pair) for chunk, body in rows_of(batches) for pair in zip(*(a.tolist() for a in unpack(body)), strict=True)), LENGTHS, 100_000)

    sent = chunked(docs.select(F.to_json(F.struct(*keys)).alias("row"), text_of(text_col).cast("binary").alias("text")), encode)
    counts = sent.filter("bucket = 0").select("chunk", "body").mapInArrow(lengths_of, LENGTHS)
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = np.array(sorted(planned(histogram, capacity).places), np.int64).reshape(-1, 5)
    plan_table = spark.sparkContext.broadcast(((plan[:, 0] << 40) + plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")

    def tell(group: pa.Table) -> pa.Table:
        body = pack((group["length"].to_numpy(), group["rank"].to_numpy()))
        return pa.table({"chunk": group["chunk"][:1], "bucket": pa.array([0]), "body": pa.array([body], pa.binary())})

    ranks = counts.withColumn("rank", before).select("chunk", "length", "rank").groupBy("chunk").applyInArrow(tell, ROWS)
    out = gathered(sent, ranks, place, PIECES, n)
    kind = docs.select(*keys).schema
    return out.withColumn("row", F.from_json("row", kind)).select("row.*", "piece", "start", "length", "ids", "sequence_id", "offset")
