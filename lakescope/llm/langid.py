"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters' vectors,
each permuted (rotated) by its place; a text's vector is the sum over its n-grams. A language's prototype is
the sum of the unit vectors of its training texts, less the mean over languages; a text is given the
language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

DIM, GRAM, SEED = 1024, 3, 7
#: A bound on the labelled texts per language that the prototypes are fitted on, chosen by a hash of doc_id.
FIT_PER_LANG = 20_000
UNDECIDED = "und"
#: Cosine below which a text of at least SURE characters counts as being in no learned language; chance gives about 0.03.
LEAST, SURE = 0.05, 64
#: N-grams and texts of one matrix product, and n-grams held at once; a longer text is read in slices.
BLOCK, TEXTS, HELD = 4096, 64, 1 << 18
HAS_LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"\P{L}+")


class Profiles:
    """Vectors of letters and n-grams; n-gram vectors are kept until there are many, then made anew."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED, keep: int = 16_000):
        self.dim, self.gram, self.seed, self.keep = dim, gram, seed, keep
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.rows = np.empty((0, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[code]

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """Keys of the text's n-grams (lower-cased letters, words set apart by one blank), at most HELD at a time."""
        plain = NOT_LETTERS.sub(" ", text).strip().lower()
        if not plain:
            return
        plain = f" {plain} "
        for at in range(0, max(1, len(plain) - self.gram + 1), HELD):
            points = np.frombuffer(plain[at : at + HELD + self.gram - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            n = max(0, len(points) - self.gram + 1)
            out = np.zeros(n, np.int64)
            for i in range(self.gram):
                out = out << 21 | points[i : i + n]
            yield out

    def _of(self, key: int) -> np.ndarray:
        v = np.ones(self.dim, np.int8)
        for place in range(self.gram):
            v = v * np.roll(self.letter(key >> 21 * (self.gram - 1 - place) & 0x1FFFFF), place)
        return v

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the n-grams' vectors, made where they are new."""
        if len(self.grams) + len(keys) > self.keep and self.grams:
            self.grams = {}
        new = [k for k in keys.tolist() if k not in self.grams]
        first = len(self.grams)
        while len(self.rows) < first + len(new):
            self.rows = np.concatenate([self.rows, np.empty((max(2048, len(self.rows)), self.dim), np.int8)])
        for i, k in enumerate(new, first):
            self.grams[k] = i
            self.rows[i] = self._of(k)
        return np.fromiter((self.grams[k] for k in keys.tolist()), np.int64, len(keys))

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Each text's sum of n-gram vectors; zeros for a text without letters. One matrix product per block of n-grams."""
        out = np.zeros((len(texts), self.dim), np.float32)
        held, docs, size = [], [], 0
        for i, text in enumerate(texts):
            for codes in self.codes(text or ""):
                held.append(codes)
                docs.append(i)
                size += len(codes)
                if size >= HELD or len(held) >= TEXTS:
                    self._add(out, docs, held)
                    held, docs, size = [], [], 0
        if held:
            self._add(out, docs, held)
        return out

    def _add(self, out: np.ndarray, docs: list[int], codes: list[np.ndarray]) -> None:
        keys, at = np.unique(np.concatenate(codes), return_inverse=True)
        own = np.repeat(np.arange(len(docs)), [len(c) for c in codes])
        for i in range(0, len(keys), BLOCK):
            here = (at >= i) & (at < i + BLOCK) if len(keys) > BLOCK else slice(None)
            width = min(BLOCK, len(keys) - i)
            counts = np.bincount(own[here] * width + (at[here] - i), minlength=len(docs) * width).reshape(len(docs), width)
            np.add.at(out, docs, counts.astype(np.float32) @ self.rows_of(keys[i : i + BLOCK]).astype(np.float32))

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        places = self.places(keys)
        return self.rows[places]

    def unit_vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors at length one, and which texts have letters."""
        out = self.vectors(texts)
        some = np.array([bool(t) and HAS_LETTER.search(t) is not None for t in texts], bool)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), some


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = FIT_PER_LANG) -> dict[str, np.ndarray]:
    """Language prototypes (unit vectors) from rows with a language.

    Rows whose language or text is null are left out, a text without letters adds nothing, repeated rows count
    repeatedly, other columns are ignored, and no row gives no prototype. A first pass counts the rows of each
    language, without texts; of a language with more than per_lang rows, those whose hashed id is in the matching
    share are read. What comes to the driver is one vector a language.
    """
    prepare(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = {r[0]: r[1] for r in labelled.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not per:
        return {}
    share = F.lit(1.0)
    for lang, n in per.items():
        if n > per_lang:
            share = F.when(F.col(lang_col) == lang, per_lang / n).otherwise(share)
    taken = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share * (1 << 20)

    def run(batches) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), {}
        for batch in batches:
            for i, texts in slices(batch.column(1)):
                units, _ = profiles.unit_vectors(texts)
                for lang, v in zip(batch.column(0).slice(i, TEXTS).to_pylist(), units.astype(np.float64), strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield table("lang string, dim int, value double", [[lang] * DIM, range(DIM), v])

    parts = rows.filter(taken).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, dim int, value double")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    out = {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in sums}
    out = {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}
    return out


def judge(prototypes: dict[str, np.ndarray]) -> Callable[[Profiles, list[str | None]], tuple[list[str], np.ndarray]]:
    """A function from texts to their languages and scores (the cosine, at least 0); und and 0 without letters or prototypes."""
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs]) if langs else np.empty((0, DIM))
    mean = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    centred = matrix - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def of(profiles: Profiles, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        units, some = profiles.unit_vectors(texts)
        if not langs:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = np.argmax((units - mean) @ centred.T, axis=1)
        near = np.clip((units * matrix[best]).sum(axis=1), 0, 1)
        return [langs[k] if known else UNDECIDED for k, known in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, near, 0.0)

    return of


def slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, TEXTS at a time, and where each part starts."""
    for i in range(0, len(texts), TEXTS):
        yield i, texts.slice(i, TEXTS).to_pylist()


def held_out(folds: int = 3, fold: int = 1, id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: by the CRC of its id's text; a null id counts as the text null."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: Callable[..., Column] = held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows not held out that have a language.

    Null text and text without letters give und with score 0. Repeated rows give repeated results, ties go to
    the first language by name, an empty table gives an empty result, other columns are ignored. A text of any
    length is read in slices of a bounded size.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), held(id_col=id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    of = judge(fit(marked.filter("not held_out")))

    def run(batches):
        profiles = Profiles()
        for batch in batches:
            langs, scores = [], []
            for _, texts in slices(batch.column(2)):
                found, near = of(profiles, texts)
                langs += found
                scores += near.tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The input's rows, all columns, whose text is in a learned language: lang_pred is not und and score is least or more.

    So null texts, texts without letters and texts that are like no learned language go; a text of under SURE
    characters says too little to be judged by its score and stays if it has a letter. Where no prototype can
    be learned, as when no row that is not held out has a language, no text has a score; then only null texts
    and texts without letters go. Repeated rows are judged alike, an empty table gives an empty result, other
    columns pass through whatever their names are. Texts go to Python once and are read in slices.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col=id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    prototypes = fit(marked.filter("not held_out"))
    of, at = judge(prototypes), docs.columns.index(text_col)

    def run(batches):
        profiles = Profiles()
        for batch in batches:
            for i, texts in slices(batch.column(at)):
                if prototypes:
                    langs, scores = of(profiles, texts)
                    stays = [lang != UNDECIDED and (score >= least or len(t) < SURE) for lang, score, t in zip(langs, scores.tolist(), texts, strict=True)]
                else:
                    stays = [bool(t) and HAS_LETTER.search(t) is not None for t in texts]
                yield batch.slice(i, TEXTS).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
