"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A letter n-gram is bound from
its letters' vectors, each permuted (rotated) by its place, and a document is the bundle (sum) of its
n-grams. A language's prototype bundles the documents of the language, each with equal weight, less the
mean of all languages, which says nothing about any. A document gets the language whose prototype has
the largest cosine with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loreframe.llm.wordarrays import give_back, mix, slices

UNKNOWN = "und"
LANGUAGES = 10_000  # a table with more label values than this is not one of languages
LEAST_ROWS = 20  # labelled rows of a size that make a bound of their own
BY_CHANCE = 2  # standard deviations of the cosine of unlike vectors
_SHIFT = 21  # bits of a code point


@cache
def _letter_flags() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngrams(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram codes, counts) of the letters; a gap between words counts as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_flags()[points]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    clean = np.where(letter, points, 0).astype(np.uint64)
    clean = np.concatenate([[0], clean[letter | np.concatenate([[False], letter[:-1]])], [0]]).astype(np.uint64)
    if clean[-2] == 0:
        clean = clean[:-1]
    if len(clean) < size:
        clean = np.concatenate([clean, np.zeros(size - len(clean), np.uint64)])
    code = np.zeros(len(clean) - size + 1, np.uint64)
    for k in range(size):
        code = (code << np.uint64(_SHIFT)) | clean[k : len(clean) - size + 1 + k]
    return np.unique(code, return_counts=True)


class Space:
    """Random letter vectors and bound n-gram vectors; the same in every task."""

    def __init__(self, dimensions: int, size: int, remembered: int = 30_000):
        self.dimensions, self.size, self.remembered = dimensions, size, remembered
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.zeros((remembered, dimensions), np.int8)  # pages are taken as rows are filled

    def letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            words = mix(np.arange(self.dimensions // 64, dtype=np.uint64) + np.uint64((point + 1) << 32))
            bits = np.unpackbits(words.view(np.uint8))
            found = self.letters[point] = (bits.astype(np.int8) << 1) - 1
        return found

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for k in range(self.size):
            point = (code >> (_SHIFT * (self.size - 1 - k))) & ((1 << _SHIFT) - 1)
            out = out * np.roll(self.letter(point), k)
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most ``remembered`` n-grams."""
        listed = codes.tolist()
        new = [c for c in listed if c not in self.place]
        if len(self.place) + len(new) > self.remembered:
            self.place.clear()
            new = listed
        for c in new:
            at = self.place[c] = len(self.place)
            self.table[at] = self.bind(c)
        return self.table[[self.place[c] for c in listed]]

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(codes), 2048):
            out += weights[at : at + 2048].astype(np.float32) @ self.rows(codes[at : at + 2048]).astype(np.float32)
        return out


def _bundles(dimensions: int, size: int):
    """Per task and language: the sum of its documents' bundles, as one row per stretch of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier task of this worker has left
        space = Space(dimensions, size)
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                by_language: dict[str, list] = {}
                for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    codes, counts = ngrams(text or "", size)
                    if len(codes):
                        by_language.setdefault(language, []).append((codes, counts / counts.sum()))
                for language, found in by_language.items():
                    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    weights = np.bincount(at, np.concatenate([w for _, w in found]))
                    part = space.bundle(codes, weights)
                    sums[language] = sums.get(language, 0) + part.astype(np.float64)
                    docs[language] = docs.get(language, 0) + len(found)
        for language, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language]), pa.array([docs[language]], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))],
                names=["lang", "n", "bundle"],
            )

    return run


def profiles(labelled: DataFrame, dimensions: int = 1024, size: int = 3) -> dict[str, np.ndarray]:
    """Language -> mean bundle of all rows of ``labelled(text, lang)`` with a language and a letter.

    What comes to the driver is one vector for each language; more than LANGUAGES values are an error.
    """
    parts = labelled.where("lang is not null").select("text", "lang").mapInArrow(
        _bundles(dimensions, size), "lang string, n long, bundle array<double>"
    )
    # sums in whole units of 2**-30, so that their order does not matter
    terms = parts.select("lang", "n", F.posexplode("bundle").alias("d", "v"))
    summed = terms.groupBy("lang", "d").agg(F.sum("n").alias("n"), F.sum(F.round(F.col("v") * 2**30).cast("long")).alias("v"))
    rows = summed.groupBy("lang").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "v"))).alias("all"))
    found = rows.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: np.array([x["v"] for x in r["all"]], np.float64) / 2**30 / r["n"] for r in sorted(found)}


def centred(means: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Language -> prototype: its mean bundle less the mean of all languages, of length 1."""
    if len(means) > 1:
        centre = sum(means.values()) / len(means)
        means = {k: v - centre for k, v in means.items()}
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in means.items()}


def learn(labelled: DataFrame, dimensions: int = 1024, size: int = 3) -> dict[str, np.ndarray]:
    """Language -> prototype, see ``profiles`` and ``centred``."""
    return centred(profiles(labelled, dimensions, size))


def _predict(model, dimensions: int, size: int, carried: list[str], plain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        prototypes = model.value
        names = sorted(prototypes)
        matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), dimensions)
        means = None
        if plain is not None:
            means = np.array([v / (np.linalg.norm(v) or 1) for v in plain.value.values()], np.float32).reshape(-1, dimensions)
        space = Space(dimensions, size)
        for whole in batches:
            for batch in slices(whole, "__text"):
                best, score, terms, likeness = [], [], [], []
                for text in batch.column("__text").to_pylist():
                    codes, counts = ngrams(text or "", size)
                    terms.append(len(codes))
                    if not len(codes) or not names:
                        best.append(UNKNOWN)
                        score.append(0.0)
                        likeness.append(0.0)
                        continue
                    vector = space.bundle(codes, counts)
                    cosine = matrix @ vector / (float(np.linalg.norm(vector)) or 1.0)
                    k = int(np.argmax(cosine))
                    best.append(names[k])
                    score.append(min(1.0, max(0.0, (1 + float(cosine[k])) / 2)))
                    if means is not None:
                        likeness.append(float((means @ vector).max()) / (float(np.linalg.norm(vector)) or 1.0))
                columns = [*[batch.column(c) for c in carried], pa.array(best, pa.string()), pa.array(score, pa.float64())]
                names_out = [*carried, "lang_pred", "score"]
                if means is not None:
                    columns += [pa.array(terms, pa.int64()), pa.array(likeness, pa.float64())]
                    names_out += ["n_ngrams", "likeness"]
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return run


def identify(
    docs: DataFrame,
    prototypes: dict[str, np.ndarray],
    carried: list[str],
    dimensions: int = 1024,
    size: int = 3,
    means: dict[str, np.ndarray] | None = None,
) -> DataFrame:
    """The ``carried`` columns of ``docs``, ``lang_pred`` and ``score`` ((1 + cosine) / 2) of its ``text``.

    A null text or one without a letter is ``und`` with score 0, and so is every text where nothing was
    learned. Of equal cosines the first language by name wins. Only the text is looked at, so repeated rows
    get equal results; other columns are left out.

    With the ``means`` of the languages there are two columns more: ``n_ngrams``, the distinct n-grams of the
    text, and ``likeness``, its largest cosine with a mean that is not centred. The score tells languages
    apart; the likeness tells text in any of them, or in several, from what is in none.
    """
    model = docs.sparkSession.sparkContext.broadcast(prototypes)
    plain = docs.sparkSession.sparkContext.broadcast(means) if means else None
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, F.col("text").alias("__text")).mapInArrow(
        _predict(model, dimensions, size, carried, plain),
        schema + ", lang_pred string, score double" + (", n_ngrams long, likeness double" if means else ""),
    )


def least_likeness(judged: DataFrame, means: dict[str, np.ndarray]) -> Column:
    """The likeness below which a text of its ``n_ngrams`` is in none of the languages.

    From all labelled rows of ``judged(lang, n_ngrams, likeness)``, by the power of two of the distinct n-grams,
    as short texts are less like any profile: a quarter of the likeness that nine in ten rows reach. Up to
    a tenth of mislabelled rows does not move it far. A size with fewer than LEAST_ROWS rows takes the bound of
    the next smaller one. It is never below what vectors unlike all languages reach by chance.
    """
    dimensions = len(next(iter(means.values())))
    chance = BY_CHANCE / math.sqrt(dimensions)
    size = F.floor(F.log2(F.col("n_ngrams").cast("double"))).cast("int")
    known = judged.where("lang is not null and n_ngrams > 0").groupBy(size.alias("size"))
    found = known.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("likeness", 0.1, 10_000).alias("low")).collect()
    bound = F.lit(chance)
    for r in sorted(found):  # one row for each power of two
        if r["n"] >= LEAST_ROWS:
            bound = F.when(size >= r["size"], max(chance, r["low"] / 4)).otherwise(bound)
    return bound


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text leaves 2 by 4; never if it is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
