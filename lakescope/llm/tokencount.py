"""Token counts: pieces are counted once per distinct pre-token of the corpus.

Each chunk of documents keeps its documents' pre-token frequencies and asks for its distinct pre-tokens by
hash bucket; a bucket runs the tokenizer's model once over the distinct ones of all chunks; the answers are
joined to the frequencies and summed. No ids of a text are made. Pre-tokens are those of the tokenizer's own
normalizer and pre-tokenizer; these see each distinct run between ASCII white space of a chunk once, which
suits tokenizers that drop white space. Special strings are cut out first, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answered, buckets_for, chunked, gathered, prepare, spans, text_of

COUNTS = "row string, n_bytes long, n_tokens long"
#: Before a special string, so that it equals no pre-token.
MARK = "\0"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json file, as its library reads it, without truncation or padding; once per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def drops_blanks(t) -> bool:
    """Whether texts can be cut at ASCII white space without changing their tokens, shown on samples of every such character."""
    def ids(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    words = ("a", "The", "don't", "x1", "3,", "...", "(é", "日本", "e\u0301")
    samples = [b.join(words) for b in (" ", "\t", "\n", "\v", "\f", "\r", "\r\n", "  ", " \n\t")]
    return all(ids(edge + s + edge) == [i for w in words for i in ids(w)] for s in samples for edge in ("", " ", "\n"))


def checked(path: str) -> None:
    """Raise unless the tokenizer suits: it drops white space, and its added strings are matched as they stand."""
    t = load(path)
    if not drops_blanks(t):
        raise ValueError(f"{path}: its tokens depend on white space, so runs cannot be taken alone")
    if any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in t.get_added_tokens_decoder().values()):
        raise ValueError(f"{path}: its added strings are not matched as they stand")


class Units:
    """The distinct runs of a chunk, numbered."""

    def __init__(self):
        self.at: dict[bytes, int] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        words, at = text.split(), self.at
        return np.fromiter([at.setdefault(w, len(at)) for w in words], np.int32, len(words))

    def messages(self, n: int) -> tuple[np.ndarray, dict[int, bytes]]:
        return messages(list(self.at), n)


def messages(names: list[bytes], n: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """The order in which names are asked for, and per bucket its names, joined by line ends."""
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % n for w in names), np.int32, len(names))
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    found, starts = np.unique(bucket[order], return_index=True)
    cut = np.append(starts, len(order))
    return order, {int(b): b"\n".join([names[k] for k in order[i:j]]) for b, i, j in zip(found, cut, cut[1:], strict=False)}


def distinct(messages: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """All units of a bucket's messages, once each, and each message's places among them."""
    at: dict[bytes, int] = {}
    places = [np.array([at.setdefault(w, len(at)) for w in m.split(b"\n")], np.int64) for m in messages]
    return list(at), places


#: Characters from here on are left to the library. Below, letters and digits are the same in every version of Unicode.
PLAIN = "\u0130"
#: Byte-level tokenizers spell printable bytes as themselves and the others, in order, by characters from 256 on.
_others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
SPELT = {b: 256 + k for k, b in enumerate(_others)}


class Splitter:
    """The pre-tokens of runs, as a tokenizer's normalizer and pre-tokenizer make them.

    Printable runs of Latin letters, digits and signs (all below PLAIN) go through the tokenizer's own pattern at
    once, if its parts do nothing else to such runs than compose, fold case, cut by one pattern and spell bytes
    as characters; composing leaves such runs as they are. All others go through the library.
    """

    def __init__(self, t):
        self.normal = t.normalizer.normalize_str if t.normalizer else str
        self.before = t.pre_tokenizer.pre_tokenize_str if t.pre_tokenizer else lambda s: [(s, (0, len(s)))] if s else []
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        parts = json.loads(t.to_str())
        normal, before = (self._parts(parts[k], inner) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        self.fold, self.pattern = {"type": "Lowercase"} in normal, None
        if all(x == blanks or x["type"] in ("NFC", "Lowercase") for x in normal) and [x["type"] for x in before] == ["Split", "ByteLevel"]:
            cut, level = before
            if (cut["behavior"], cut["invert"]) == ("Removed", True) and "Regex" in cut["pattern"] and not (level["add_prefix_space"] or level["use_regex"]):
                self.pattern = regex.compile("\n|" + cut["pattern"]["Regex"])

    @staticmethod
    def _parts(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    def alone(self, run: str) -> list[str]:
        """One run, special strings included."""
        out, done = [], 0
        for m in self.special.finditer(run) if self.special else ():
            out += [w for w, _ in self.before(self.normal(run[done : m.start()]))] + [MARK + m[0]]
            done = m.end()
        return out + [w for w, _ in self.before(self.normal(run[done:]))]

    def some(self, runs: list[str]) -> list[list[str]]:
        """Runs together, where the normalizer leaves one blank between two; else one by one."""
        plain = self.normal(" ".join(runs))
        one = plain.split(" ")
        if len(one) != len(runs):
            return [self.alone(w) for w in runs]
        out: list[list[str]] = [[] for _ in runs]
        ends, k = list(accumulate(len(w) + 1 for w in one)), 0
        for w, (a, _) in self.before(plain):
            while a >= ends[k]:
                k += 1
            out[k].append(w)
        return out

    def split(self, runs: list[bytes], most: int = 10_000) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pre-tokens, each run's by number, one run after another, and how many each run has."""
        texts = [r.decode("utf-8", "replace") for r in runs]
        mixed = self.special is not None and self.special.search("\n".join(texts)) is not None
        quick = [self.pattern is not None and (w.isascii() or max(w) < PLAIN) and w.isprintable() and not (mixed and self.special.search(w)) for w in texts]
        at, sizes = {"\n": 0}, np.zeros(len(texts), np.int64)
        fast = np.flatnonzero(quick)
        joined = "\n".join([w for w, q in zip(texts, quick, strict=True) if q])
        found = self.pattern.findall(joined.lower() if self.fold else joined) if len(fast) else []
        numbers = np.fromiter([at.setdefault(w, len(at)) for w in found], np.int64, len(found))
        at = {w if w.isascii() else w.encode().decode("latin-1").translate(SPELT): k for w, k in at.items()}
        edges = np.append(np.flatnonzero(numbers == 0), len(numbers))
        sizes[fast] = np.diff(edges, prepend=-1)[: len(fast)] - 1
        slow = np.flatnonzero(~np.array(quick, bool))
        rest: list[int] = []
        for i in range(0, len(slow), most):
            here = slow[i : i + most]
            odd = [len(texts[k].split()) != 1 or mixed and self.special.search(texts[k]) is not None for k in here]
            plain = iter(self.some([texts[k] for k, o in zip(here, odd, strict=True) if not o]) if not all(odd) else [])
            for k, o in zip(here, odd, strict=True):
                names = self.alone(texts[k]) if o else next(plain)
                sizes[k] = len(names)
                rest += [at.setdefault(w, len(at)) for w in names]
        flat, starts = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        flat[spans(starts[fast], sizes[fast])] = numbers[numbers > 0]
        flat[spans(starts[slow], sizes[slow])] = rest
        return list(at)[1:], flat - 1, sizes


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(load(path))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per input row: the key columns, n_bytes (UTF-8) and n_tokens, without added special tokens.

    Null text is empty: 0 bytes, 0 tokens. Repeated rows repeat; nulls in key columns stay null; other
    columns are ignored; an empty table gives an empty result. A text of any length counts whole.
    """
    prepare(docs.sparkSession)
    checked(tokenizer)
    n = buckets_for(docs, text_col)

    def ask(rows):
        runs = Units()
        parts = [runs.numbers(text) for _, text in rows]
        names, inner, sizes = splitter(tokenizer).split(list(runs.at))
        flat, words = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        doc = np.repeat(np.repeat(np.arange(len(rows)), words), sizes[flat])
        pairs, freq = np.unique(doc << 32 | inner[spans((np.cumsum(sizes) - sizes)[flat], sizes[flat])], return_counts=True)
        order, asked = messages([w.encode() for w in names], n)
        at = (pairs & 0xFFFFFFFF).astype(np.int32)
        per_doc = np.bincount(pairs >> 32, minlength=len(rows)).astype(np.int32)
        step = np.diff(at, prepend=0).astype(np.int32)
        small = freq.astype(np.uint16 if freq.max(initial=0) < 65536 else np.int64)
        return ([r[0] for r in rows], [len(r[1]) for r in rows], per_doc, step, small, order), asked

    def count(asked):
        names, places = distinct(asked)
        tokenize = load(tokenizer).model.tokenize
        sizes = np.fromiter((1 if w.startswith(b"\0") else len(tokenize(w.decode())) for w in names), np.int32, len(names))
        return [sizes[p] for p in places]

    def total(state, answers):
        rows, n_bytes, per_doc, step, freq, order = state
        sizes = np.zeros(len(order), np.int64)
        if len(order):
            sizes[order] = np.concatenate([answers[b] for b in sorted(answers)])
        weight = sizes[np.cumsum(step)] * freq if len(step) else np.empty(0, np.int64)
        sums = np.append(0, np.cumsum(weight))
        ends = np.cumsum(per_doc)
        return zip(rows, n_bytes, (sums[ends] - sums[ends - per_doc]).tolist(), strict=True)

    key = F.to_json(F.struct(*keys))
    sent = chunked(docs.select(key.alias("row"), text_of(text_col).cast("binary").alias("text")), ask)
    out = gathered(sent, answered(sent, count, n), total, COUNTS, n)
    kind = docs.select(*keys).schema
    return out.withColumn("row", F.from_json("row", kind)).select("row.*", "n_bytes", "n_tokens")
