"""Substring dedup with suffix automata of reference shards.

A window of LENGTH words is removed if its words also start earlier: at a smaller doc_id, or earlier in the
same document. Reference text is sharded by content: the least hash of the short word sequences in a window
(its anchor) decides the window's shard, so equal windows share one, and anchors that occur once in the corpus
cannot repeat and are left out. Windows of an anchor that is very frequent, as one of a line in every document, are
sharded by all their words instead. In a shard, documents' segments are streamed in document order through a suffix
automaton of all earlier segments; where the matching statistic reaches LENGTH, the window is a repeat.
Segments go to the shards that hold their matches instead of every automaton to every document: automata of the
whole corpus grow with it and could not be broadcast.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, answered, buckets_for, by_bucket, chunked, gathered, pack, prepare, stored, text_of
from .tokencount import Units

LENGTH, ANCHOR = 20, 8
#: Places of an anchor in the corpus beyond which its windows go to shards one by one, by the hash of all their words.
HOT = 20_000
LAST = 2**63
OUT = "row string, n_words long, n_removed long, kept string"


class Automaton:
    """A suffix automaton over words, built on line; streams report where a suffix of some length occurred before."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.last, self.ends = [-1], [0], 0, 0

    def extend(self, word) -> None:
        nxt, link, size = self.next, self.link, self.size
        now, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = copy
                    p = link[p]
                link[q] = link[now] = copy
        self.last = now

    def stream(self, words: list, length: int) -> np.ndarray:
        """For each window of the words, whether it occurred in what came before; then the words are part of that."""
        state = matched = 0
        out = np.zeros(max(0, len(words) - length + 1), bool)
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            if matched >= length:
                out[i - length + 1] = True
            self.extend(w)
            while state and matched <= self.size[self.link[state]]:
                state = self.link[state]
        self.ends -= 1
        self.extend(self.ends)  # an end that no word equals
        return out


class Chunk:
    """A chunk's words and windows: where windows start, and the anchor of each."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
        units = Units()
        parts = [units.numbers(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.words = hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in units.at), np.uint64, len(units.at))[flat]
        usable = np.maximum(self.sizes - length + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), usable)
        self.start = np.arange(int(usable.sum())) - np.repeat(np.cumsum(usable) - usable, usable)
        at = self.first[self.doc] + self.start
        if not len(at):
            self.anchor = self.place = np.empty(0, np.uint64)
            return
        k = min(anchor, length)
        gram = np.zeros(len(flat) - k + 1, np.uint64)
        for i in range(k):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(gram)]
        gram ^= gram >> np.uint64(31)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(27)
        least = np.lib.stride_tricks.sliding_window_view(gram, length - k + 1).argmin(axis=1)
        self.place = at + least[at]
        self.anchor = gram[self.place] >> np.uint64(16)  # shared anchors of different words cost time, not results

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and in how many places each stands here."""
        spots = np.unique(self.place)
        order = np.argsort(self.place, kind="stable")
        values = self.anchor[order[np.searchsorted(self.place[order], spots)]]
        found, counts = np.unique(values, return_counts=True)
        return found, counts.astype(np.min_scalar_type(int(counts.max(initial=0))))

    def whole(self, windows: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all words of windows."""
        at = self.first[self.doc[windows]] + self.start[windows]
        out = np.zeros(len(windows), np.uint64)
        for i in range(length):
            out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + self.words[at + i]
        return out ^ out >> np.uint64(31)


def _order(key: tuple) -> tuple[int, int]:
    return (LAST if key[0] is None else key[0], key[1])


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] | None = None) -> DataFrame:
    """A row per input row: key columns, n_words, n_removed, kept (the words that stay, joined by one blank).

    Null text has no words. Rows with a null doc_id come after all others; rows that share a doc_id are
    separate documents, in the order they are read. An empty table gives an empty result; columns other than
    the keys (by default id_col) are ignored.
    """
    prepare(docs.sparkSession)
    keys = keys or (id_col,)
    n = buckets_for(docs, text_col)

    def cut(values):
        order, buckets, ends = by_bucket(values, n)
        return order, [(int(b), order[i:j]) for b, i, j in zip(buckets, ends, ends[1:], strict=False)]

    def ask(rows):
        chunk = Chunk([r[3] for r in rows], length)
        values, places = chunk.anchors()
        plain = [b" ".join(r[3].split()) for r in rows]
        return ([r[:3] for r in rows], plain), {b: (values[at], places[at]) for b, at in cut(values)[1]}

    def repeated(messages):
        """Of each anchor, whether it stands in several places of the corpus, and whether in very many."""
        found, at = np.unique(np.concatenate([m[0] for m in messages]), return_inverse=True)
        total = np.bincount(at, np.concatenate([m[1] for m in messages]), len(found))
        out, done = [], 0
        for values, _ in messages:
            mine = total[at[done : done + len(values)]]
            out.append((np.packbits(mine > 1), np.packbits(mine > HOT) if (mine > HOT).any() else None))
            done += len(values)
        return out

    def segments(state, answers):
        """Segments of windows that may repeat, by shard; equal ones once, at their first place in the chunk."""
        rows, texts = state
        chunk = Chunk(texts, length)
        values, _ = chunk.anchors()
        may, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for b, at in cut(values)[1]:
            may[at] = np.unpackbits(answers[b][0], count=len(at)).astype(bool)
            if answers[b][1] is not None:
                hot[at] = np.unpackbits(answers[b][1], count=len(at)).astype(bool)
        which = np.searchsorted(values, chunk.anchor)
        some = np.flatnonzero(may[which]) if len(values) else np.empty(0, np.int64)
        single = hot[which[some]] if len(values) else np.zeros(0, bool)
        new = np.ones(len(some), bool)
        new[1:] = (np.diff(some) != 1) | (np.diff(which[some]) != 0) | (np.diff(chunk.doc[some]) != 0) | single[1:]
        starts = np.flatnonzero(new)
        firsts, counts = some[starts], np.diff(np.append(starts, len(some)))
        shards = chunk.anchor[firsts]
        shards[single[starts]] = chunk.whole(firsts[single[starts]], length) >> np.uint64(16)
        words: tuple[int, list] = (-1, [])
        seen: dict[bytes, tuple] = {}
        removed = []
        for at, count, shard_of in zip(firsts.tolist(), counts.tolist(), shards.tolist(), strict=True):
            doc, start = int(chunk.doc[at]), int(chunk.start[at])
            if words[0] != doc:
                words = doc, texts[doc].split(b" ")
            body = b" ".join(words[1][start : start + count + length - 1])
            mine = (*_order(rows[doc][1:3]), start, doc, count, shard_of)
            other = seen.get(body)
            if other is None or mine < other:
                seen[body] = mine
            if other is not None:
                later = max(mine, other)
                removed.append((later[3], later[2], later[4]))
        messages: dict[int, list] = {}
        for body, mine in seen.items():
            messages.setdefault(mine[5] % n, []).append((body, *mine))
        return (removed, {b: [m[3:6] for m in x] for b, x in messages.items()}), {b: columns(x) for b, x in messages.items()}

    def columns(entries):
        """Bodies in one text, and the numbers of each as arrays: null id, id, uid, start, anchor."""
        bodies, ids, uids, starts, _, _, anchors = zip(*entries, strict=True)
        null = np.array([i == LAST for i in ids])
        return b"\n".join(bodies), null, np.array([0 if i == LAST else i for i in ids], np.int64), np.array(uids, np.int64), np.array(starts, np.int32), np.array(anchors, np.int64)

    def shard(messages):
        """True for a segment seen before, else which of its windows occur in earlier segments of its anchor."""
        by_anchor: dict[int, list] = {}
        out = [[None] * len(m[1]) for m in messages]
        for i, (bodies, *numbers) in enumerate(messages):
            for j, (body, null, doc_id, uid, start, anchor) in enumerate(zip(bodies.split(b"\n"), *(x.tolist() for x in numbers), strict=True)):
                by_anchor.setdefault(anchor, []).append((LAST if null else doc_id, uid, start, i, j, body))
        for group in by_anchor.values():
            group.sort(key=lambda g: g[:3])
            seen: set[bytes] = set()
            parsed = []
            for *_, i, j, body in group:
                if body in seen:
                    out[i][j] = True
                else:
                    seen.add(body)
                    parsed.append((i, j, body.split(b" ")))
            if len(parsed) == 1 and len(set(parsed[0][2])) == len(parsed[0][2]):
                continue
            automaton = Automaton()
            for i, j, words in parsed:
                hits = automaton.stream(words, length)
                if hits.any():
                    out[i][j] = np.flatnonzero(hits).astype(np.int32)
        return out

    def finish(state, answers):
        (rows, texts), (removed, asked), marks = state, answers[n], {}
        for doc, start, count in removed:
            marks.setdefault(doc, []).append((start, count))
        for b, list_ in asked.items():
            for (start, doc, count), verdict in zip(list_, answers[b], strict=True):
                if verdict is True:
                    marks.setdefault(doc, []).append((start, count))
                elif verdict is not None:
                    marks.setdefault(doc, []).extend((start + int(k), 1) for k in verdict)
        for doc, (row, text) in enumerate(zip(rows, texts, strict=True)):
            words = text.split(b" ") if text else []
            if doc not in marks:
                yield row[0], len(words), 0, text.decode("utf-8", "replace")
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            for start, count in marks[doc]:
                edge[start] += 1
                edge[start + count - 1 + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            yield row[0], len(words), int(gone.sum()), kept.decode("utf-8", "replace")

    def send(state, answers):
        number, inner = state
        new, messages = segments(inner, answers)
        yield number, n, pack(new)
        for b, m in messages.items():
            yield number, b, pack(m)

    row = F.to_json(F.struct(*keys)).alias("row")
    sent = chunked(docs.select(row, F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), text_of(text_col).cast("binary").alias("text")), ask, level=6)
    shards = stored(gathered(sent, answered(sent, repeated, n), send, ROWS, n, numbered=True))
    known = shards.filter(F.col("bucket") == n).unionByName(answered(shards.filter(F.col("bucket") < n), shard, n))
    out = gathered(sent, known, finish, OUT, n)
    return out.withColumn("row", F.from_json("row", docs.select(*keys).schema)).select("row.*", "n_words", "n_removed", "kept")
