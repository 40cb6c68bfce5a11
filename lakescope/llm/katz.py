"""Language-model scoring: a Katz back-off bigram model.

P(w | h) = d(c) c / C(h) for a seen pair of count c, else bow(h) P(w); d are Good-Turing discounts for counts
up to K, and bow(h) hands the discounted mass, exactly, to what h was not seen with. P(w) is discounted
likewise, its mass left to one unknown word. Counts live in tables partitioned by hash: words in one,
pairs in one by their first word, a frequent first word over several partitions. Each partition answers
chunks of documents with the counts they need, and a chunk evaluates its tokens: pair, else back-off to word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, answered, buckets_for, chunked, emit, gathered, pack, prepare, rows_of, stored, text_of, unpack
from .tokencount import Units, distinct

K = 5
#: A first word of more tokens than this is split over partitions; at most SPLIT of them can be, so their totals are small.
HOT, SPLIT = 150_000, 1_000_000
END, START = b"", 0
OUT = "row string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TOTALS = "kind int, at long, v0 double, v1 double, v2 double, v3 double, v4 double, v5 double"


def discounts(n: list[float]) -> np.ndarray:
    """d[c] for c = 0..K (d[0] unused), from n[r - 1], the number of items of count r, r = 1..K+1.

    Good-Turing after Katz; where the counts of counts do not allow a discount strictly between 0 and 1,
    (c - D) / c with D = n1 / (n1 + 2 n2), or none if no item has count 1.
    """
    d = np.ones(K + 1)
    n1, n2 = n[0], n[1]
    if not n1:
        return d
    tail = (K + 1) * n[K] / n1
    flat = n1 / (n1 + 2 * n2)
    for c in range(1, K + 1):
        good = ((c + 1) * n[c] / (c * n[c - 1]) - tail) / (1 - tail) if n[c - 1] and tail < 1 else 0
        d[c] = good if 0 < good < 1 else (c - min(flat, 0.9)) / c
    return d


class Words:
    """The word level: the number of tokens, discounts, and the mass of the unknown word."""

    def __init__(self, tokens: float, words: float, n: list[float]):
        self.tokens, self.words, self.d = int(tokens), int(words), discounts(n)
        left = float(sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, K + 1)))
        self.total = self.tokens if left > 0 or not self.tokens else self.tokens + 1
        self.unknown = left / self.total if left > 0 else 1 / (self.total or 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, d * c / (self.total or 1), self.unknown)


def _pairs(flat: np.ndarray, sizes: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second of each pair of a chunk, by local number, and the documents' token counts."""
    counts = sizes + 1
    last = np.cumsum(counts) - 1
    second = np.insert(flat, np.cumsum(sizes), end).astype(np.int64)
    first = np.roll(second, 1)
    first[last - counts + 1] = start
    return first, second, counts


def scored(docs: DataFrame, held: Column, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per input row: key columns, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on rows where held is false; null text is empty and has one token, its end. score is the log10
    probability of the text's tokens, base_score that of add-one word probabilities. Without training rows
    every token has probability 1 in both. Repeated rows repeat, null keys stay null, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    n = buckets_for(docs, text_col)

    def ask(rows):
        units = Units()
        units.at[END] = 0
        parts = [units.numbers(r[2].lower()) for r in rows]
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts).astype(np.int32)
        train = np.array([not r[1] for r in rows], bool)
        counts = np.bincount(flat[np.repeat(train, sizes)], minlength=len(units.at))
        counts[0] += train.sum()
        order, words = units.messages(n)
        parts, at = {}, 0
        for b in sorted(words):
            size = words[b].count(b"\n") + 1
            parts[b] = words[b], counts[order[at : at + size]].astype(np.uint32)
            at += size
        small = flat.astype(np.uint16) if len(units.at) < 65536 else flat
        bucket = np.empty(len(order), np.int64)  # says the order in less room than the order itself
        bucket[order] = np.repeat(sorted(words), [len(parts[b][1]) for b in sorted(words)])
        return ([r[:2] for r in rows], sizes, small, _slim(bucket)), parts

    def words(messages):
        """Each word's rank in its bucket and count; the bucket's share of the totals comes last. Number: rank * n + bucket + 1."""
        names, places = distinct([m[0] for m in messages])
        counts = np.zeros(len(names), np.int64)
        for m, p in zip(messages, places, strict=True):
            np.add.at(counts, p, m[1].astype(np.int64))
        rank = np.empty(len(names), np.int64)  # frequent words get small numbers, which take less room
        rank[sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))] = np.arange(len(names))
        of = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)
        totals = [(0, 0, counts.sum(), (counts > 0).sum(), 0, 0, 0, 0), (1, 0, *of[1 : K + 2])]
        return [(_slim(rank[p]), _slim(counts[p])) for p in places], totals

    def known(bucket, answers):
        """Global number and count of each local word."""
        number, count = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        order = np.argsort(bucket, kind="stable")
        parts = [(answers[b][0].astype(np.int64) * n + b + 1, answers[b][1]) for b in sorted(answers) if b < n]
        number[order], count[order] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return number, count

    def local(state, answers):
        """The chunk's distinct pairs by local numbers, and each token's pair; the number after the last is the start."""
        rows, sizes, flat, bucket = state
        number, count = known(bucket, answers)
        number, count = np.append(number, START), np.append(count, count[0])
        first, second, tokens = _pairs(flat, sizes, 0, len(bucket))
        keys, inverse = np.unique(first << 32 | second, return_inverse=True)
        a, b = keys >> 32, keys & 0xFFFFFFFF
        return rows, number, count, a, b, inverse, tokens

    def routes(number, count, a, b):
        """Bucket of each pair: by its first word, with the second word's share of it where the first is frequent."""
        home = (number[a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
        split = np.where(count[a] > hot, count[a] // hot + 1, 1)
        return (home + (number[b].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % split) % n

    def asked(number, count, a, b):
        """(bucket, places of its pairs), pairs whose first word occurs in training, sorted by first word."""
        use = np.flatnonzero(count[a] > 0)
        bucket = routes(number, count, a[use], b[use])
        order = np.lexsort((number[b[use]], number[a[use]], bucket))
        use, bucket = use[order], bucket[order]
        found, starts = np.unique(bucket, return_index=True)
        cut = np.append(starts, len(use))
        return [(int(x), use[i:j]) for x, i, j in zip(found, cut, cut[1:], strict=False)]

    def send(state, answers):
        chunk, inner = state
        rows, number, count, a, b, inverse, tokens = local(inner, answers)
        train = np.repeat(np.array([not r[1] for r in rows], bool), tokens)
        c = np.bincount(inverse[train], minlength=len(a))
        for x, at in asked(number, count, a, b):
            first, runs = np.unique(number[a[at]], return_counts=True)
            yield chunk, x, pack((_slim(np.diff(first, prepend=0)), _slim(runs), _slim(number[b[at]]), _slim(count[b[at]]), _slim(c[at]), count[a[at[np.append(0, np.cumsum(runs)[:-1])]]] > hot))

    def pairs(messages):
        """Each pair's count and, by first word, how many seconds were seen r times and their word-level mass."""
        messages = [(np.cumsum(m[0].astype(np.int64)), *m[1:]) for m in messages]
        firsts = np.concatenate([np.repeat(m[0], m[1]) for m in messages])
        seconds = np.concatenate([m[2] for m in messages]).astype(np.int64)
        names, i = np.unique(firsts, return_inverse=True)
        _, j = np.unique(seconds, return_inverse=True)
        keys, at, inverse = np.unique(i << 32 | j, return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate([m[4] for m in messages])).astype(np.int64)
        mass = model.value.p(np.concatenate([m[3] for m in messages])[at].astype(np.int64))
        of, seen = keys >> 32, c > 0
        m = np.array([np.bincount(of[c == r], minlength=len(names)) for r in range(1, K + 1)])
        s = np.bincount(of[seen], mass[seen], minlength=len(names))
        spread = np.zeros(len(names), bool)
        for x in messages:
            spread[np.searchsorted(names, x[0][x[5]])] = True
        out, done = [], 0
        for x in messages:
            size, f = len(x[2]), np.searchsorted(names, x[0])
            out.append((_slim(c[inverse[done : done + size]]), _slim(m[:, f]), s[f]))
            done += size
        totals = [(1, 0, *np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2])]
        totals += [(2, int(names[k]), *m[:, k], s[k]) for k in np.flatnonzero(spread)]
        return out, totals

    def evaluate(state, answers):
        rows, number, count, a, b, inverse, tokens = local(state, answers)
        words, d, frequent = model.value, pair_d.value, totals2.value
        c, m, s = np.zeros(len(a), np.int64), np.zeros((K, len(number))), np.zeros(len(number))
        for x, at in asked(number, count, a, b):
            counts, seen, mass = answers[x + n]
            c[at] = counts
            first = a[at[np.unique(number[a[at]], return_index=True)[1]]]
            m[:, first], s[first] = seen, mass
        for i in np.flatnonzero(count > hot):
            if int(number[i]) in frequent:
                m[:, i], s[i] = frequent[int(number[i])]
        m, s = m[:, a], s[a]
        total = count[a].astype(float)
        left = ((1 - d[1:, None]) * np.arange(1, K + 1)[:, None] * m).sum(axis=0)
        total = np.where(left > 0, total, total + 1)
        left = np.where(left > 0, left, 1.0) / total
        seen = np.where(c <= K, d[np.minimum(c, K)], 1.0) * c / total
        back = np.where(count[a] > 0, left / np.maximum(1 - s, 1e-300), 1.0) * words.p(count[b])
        logs = np.log10(np.where(c > 0, seen, back))
        base = np.log10((count[b] + 1) / (words.tokens + words.words + 1))
        doc = np.repeat(np.arange(len(rows)), tokens)
        sums = [np.bincount(doc, x[inverse], minlength=len(rows)) for x in (count[b] > 0, base, logs)]
        for k, row in enumerate(rows):
            yield row[0], row[1], int(tokens[k]), int(sums[0][k]), words.tokens, float(sums[1][k]), float(sums[2][k])

    sent = chunked(docs.select(F.to_json(F.struct(*keys)).alias("row"), held.alias("held"), text_of(text_col).cast("binary").alias("text")), ask, level=6)
    answers1 = stored(answered(sent, words, n, summed=True))
    sums = {r["kind"]: r for r in _totals(answers1).collect()}
    head, tail = ([float(sums[k][f"v{i}"]) for i in range(6)] if k in sums else [0.0] * 6 for k in (0, 1))
    model = spark.sparkContext.broadcast(Words(head[0], head[1], tail))
    hot = max(HOT, int(head[0]) // SPLIT)
    answers2 = stored(answered(gathered(sent, answers1.filter("chunk >= 0"), send, ROWS, n, numbered=True), pairs, n, summed=True))
    sums2 = _totals(answers2).collect()
    tail2 = next(([float(r[f"v{i}"]) for i in range(6)] for r in sums2 if r["kind"] == 1), [0.0] * 6)
    pair_d = spark.sparkContext.broadcast(discounts(tail2))
    totals2 = spark.sparkContext.broadcast({r["at"]: (np.array([r[f"v{i}"] for i in range(K)]), r["v5"]) for r in sums2 if r["kind"] == 2})
    both = answers1.filter("chunk >= 0").unionByName(answers2.filter("chunk >= 0").withColumn("bucket", F.col("bucket") + n))
    out = gathered(sent, both, evaluate, OUT, n)
    return out.withColumn("row", F.from_json("row", docs.select(*keys).schema)).select("row.*", *[c.split()[0] for c in OUT.split(", ")[1:]])


def _slim(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _totals(answers: DataFrame) -> DataFrame:
    """The buckets' totals, summed by kind and number."""
    def run(batches):
        yield from emit(((int(t[0]), int(t[1]), *map(float, t[2:])) for (body,) in rows_of(batches) for t in unpack(body)), TOTALS)

    rows = answers.filter("chunk < 0").select("body").mapInArrow(run, TOTALS)
    return rows.groupBy("kind", "at").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(6)))
