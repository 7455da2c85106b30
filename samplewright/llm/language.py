"""Language identification by nearest centroid over TF-IDF vectors of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .arrow import pieces

#: n-grams of these lengths fall into this many buckets each.
SIZES, BUCKETS = (1, 2, 3), 2048
DIM = len(SIZES) * BUCKETS
#: Label of texts without letters, and of texts that are rejected.
UNKNOWN = "und"
#: Limits of the classes of text length (in letters and gaps) that have rejection distances of their own.
LENGTH_CLASSES = (10, 25, 50, 200, 1000)
#: Training texts a class needs to have a distance of its own; others take that of the nearest class that has.
LEAST_TEXTS = 10
#: Share of the training texts of a class that may lie below the cosine its distance comes from.
LOW = 0.001
#: Steps of the histograms of cosines.
STEPS = 1000

#: Texts whose vectors are held at once.
_ROWS = 256

#: Everything but letters and the marks that go with them; numerals that are no digits are gaps too.
_GAPS, _ASCII_GAPS = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def _vector(text: str) -> np.ndarray | None:
    """Counts of hashed character n-grams of the lower-cased text, runs of other than letters being one space."""
    lower = text.lower()
    letters = (_ASCII_GAPS if lower.isascii() else _GAPS).sub(" ", lower).strip()
    if not any(map(str.isalpha, letters)):
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.empty((len(SIZES), BUCKETS), np.float32)
    gram = np.zeros(len(codes), np.uint32)
    for row, size in enumerate(SIZES):
        n = len(codes) - size + 1
        if n <= 0:
            out[row] = 0
            continue
        gram = gram[:n] * np.uint32(2654435761) + codes[size - 1 :][:n]
        mixed = gram * np.uint32(0x9E3779B1)
        out[row] = np.bincount((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out.reshape(-1)


def _length(counts: np.ndarray) -> np.ndarray:
    """Characters behind rows of counts: those of the shortest n-grams."""
    return counts[..., :BUCKETS].sum(axis=-1)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1: (1 + log count) * idf."""
    rows = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task: how many of its texts have each bucket, and how many texts there are."""
    total, seen = 0, np.zeros(DIM, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts = _vector(text or "")
            if counts is not None:
                seen += counts > 0
                total += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([total], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64()))], ["total", "seen"]
    )


def _sampled_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 1):
            rows = [(lang, _vector(text or "")) for lang, text in zip(*(c.to_pylist() for c in piece.columns), strict=True)]
            rows = [(lang, counts) for lang, counts in rows if counts is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.uint32).tobytes() for r in rows], pa.binary())],
                ["lang", "counts"],
            )


@dataclass
class Centroids:
    """A fitted model: centroid rows of length 1, their languages, and per language and length class the floor."""

    idf: np.ndarray
    rows: np.ndarray
    language_of: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, cosine to its nearest centroid, whether that is too far) for rows of counts."""
        cosine = _tfidf(counts, self.idf) @ self.rows.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        language = self.language_of[best]
        far = score < self.floors[language, np.searchsorted(LENGTH_CLASSES, _length(counts))]
        return language, score, far


def _cluster(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts far apart."""
    chosen = [int(rng.integers(len(rows)))]
    for _ in range(min(count, len(rows)) - 1):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centroids = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[nearest == k].sum(axis=0) for k in range(len(centroids)) if (nearest == k).any()])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _clustered(idf: np.ndarray, centroids: int):
    def run(sample: pa.Table) -> pa.Table:
        counts = np.stack([np.frombuffer(c, np.uint32) for c in sorted(sample["counts"].to_pylist())])
        own = _cluster(_tfidf(counts, idf), centroids, np.random.default_rng(7)).astype(np.float32)
        langs = pa.array([sample["lang"][0].as_py()] * len(own), pa.string())
        return pa.table({"lang": langs, "centroid": pa.array([row.tobytes() for row in own], pa.binary())})

    return run


def fit(
    training: DataFrame,
    text_col: str,
    lang_col: str,
    centroids: int = 6,
    fit_rows: int = 400,
    slack: float = 0.4,
) -> Centroids:
    """Learns from labelled texts; rows without a text, letters or language are ignored.

    Document frequencies come from all training rows, added up by task. Centroids are clustered per language, in a task,
    from a sample of at most ``fit_rows`` rows of it, those with the smallest hashes of their text, so that
    repeated texts and the order of rows don't matter. The floor below which a text is rejected is ``slack``
    times a low quantile of the cosines that all training texts of the same language and length class have to
    their language's nearest centroid; classes with fewer than ``LEAST_TEXTS`` take their neighbour's.
    If there is nothing to learn from, the model knows no language and rejects every text.
    """
    ship(training.sparkSession)
    rows = training.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    parts = rows.select("text").mapInArrow(_document_counts, "total bigint, seen array<bigint>")
    # One row for each task is summed up in the cluster; one row of fixed length comes back for each bucket.
    sums = parts.select("total", F.posexplode("seen").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    seen, total = np.zeros(DIM), 0
    for r in sums.collect():
        seen[r.bucket], total = r.n, r.total
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 0.05

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text_h"))
    # A first cut inside shares of a language, so that no task sees all of a common one.
    share = F.pmod(F.col("text_h"), F.lit(64))
    first = F.row_number().over(Window.partitionBy("lang", share).orderBy("h", "text_h"))
    keyed = rows.select("lang", "text", F.xxhash64("text").alias("text_h"), F.hash("text").alias("h"))
    limits = keyed.select("lang", "h", "text_h").distinct().withColumn("first", first).where(F.col("first") <= fit_rows)
    limits = limits.withColumn("rank", rank).where(F.col("rank") <= fit_rows)
    picked = keyed.join(F.broadcast(limits.drop("rank", "first")), ["lang", "h", "text_h"], "left_semi")
    sample = picked.dropDuplicates(["lang", "text_h"]).select("lang", "text").mapInArrow(_sampled_vectors, "lang string, counts binary")
    # Each language's sample is clustered in a task; only centroids come back.
    found = sample.groupBy("lang").applyInArrow(_clustered(idf, centroids), "lang string, centroid binary").collect()
    languages = sorted({r.lang for r in found})
    if not languages:
        return Centroids(idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), [], np.zeros((0, len(LENGTH_CLASSES) + 1)))
    found.sort(key=lambda r: (r.lang, r.centroid))
    own = np.stack([np.frombuffer(r.centroid, np.float32) for r in found])
    model = Centroids(idf, own, np.array([languages.index(r.lang) for r in found]), languages, np.zeros(0))
    shared = training.sparkSession.sparkContext.broadcast(model)
    near = rows.mapInArrow(_near(shared), "lang int, length int, step int, n bigint")
    histogram = np.zeros((len(languages), len(LENGTH_CLASSES) + 1, STEPS), np.int64)
    for r in near.groupBy("lang", "length", "step").agg(F.sum("n").alias("n")).collect():  # at most one row for each cell
        histogram[r.lang, r.length, r.step] = r.n
    model.floors = _floors(histogram) * slack
    return model


def _near(shared):
    """Counts of training texts by language, length class and step of the cosine to the nearest of their language's centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {lang: i for i, lang in enumerate(model.languages)}
        cells = np.zeros((len(model.languages), len(LENGTH_CLASSES) + 1, STEPS), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                texts, langs = (c.slice(start, _ROWS).to_pylist() for c in batch.columns)
                kept = [(v, number[lang]) for t, lang in zip(texts, langs, strict=True) if (v := _vector(t or "")) is not None]
                if not kept:
                    continue
                counts, mine = np.stack([v for v, _ in kept]), np.array([k for _, k in kept])
                cosine = np.where(model.language_of == mine[:, None], _tfidf(counts, model.idf) @ model.rows.T, -1).max(axis=1)
                step = np.clip(cosine * STEPS, 0, STEPS - 1).astype(int)
                np.add.at(cells, (mine, np.searchsorted(LENGTH_CLASSES, _length(counts)), step), 1)
        at = np.nonzero(cells)
        columns = [pa.array(a, pa.int32()) for a in at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(cells[at])], ["lang", "length", "step", "n"])

    return run


def _floors(histogram: np.ndarray) -> np.ndarray:
    """Low quantile of the cosines of each language and length class; classes with few texts take the nearest one's, the shorter first.

    A language with few texts in every class takes the quantile over all of them.
    """
    total = histogram.sum(axis=-1)
    below = np.cumsum(histogram, axis=-1)
    out = (below > LOW * total[..., None]).argmax(axis=-1) / STEPS
    for i, sizes in enumerate(total):
        good = np.flatnonzero(sizes >= LEAST_TEXTS)
        for k in range(len(sizes)):
            if not len(good):
                out[i, k] = (below[i].sum(axis=0) > LOW * sizes.sum()).argmax() / STEPS
            elif k not in good:
                out[i, k] = out[i, min(good, key=lambda g: (abs(g - k), g))]
    return out


def _predict(shared, schema: T.StructType, inside: str | None):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            language, score, rejected = np.full(n, len(model.languages)), np.zeros(n), np.ones(n, bool)
            # The text travels once: as a field of the row, if it is one of its columns.
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            for start in range(0, n, _ROWS):
                vectors = [_vector(t or "") for t in texts.slice(start, _ROWS).to_pylist()]
                known = [i for i, v in enumerate(vectors) if v is not None]
                if known and model.languages:
                    at = start + np.array(known)
                    language[at], score[at], rejected[at] = model.predict(np.stack([vectors[i] for i in known]))
            columns = [batch.column(0), pa.array(names[language], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def identify(docs: DataFrame, text_col: str, model: Centroids, keep: Sequence[str] | None = None) -> DataFrame:
    """Languages of texts: (row, lang_pred, score, rejected), row being a struct of the columns ``keep``, all by default.

    The language is that of the nearest of all centroids by cosine over the whole text, score that cosine.
    Texts without letters, null and empty ones too, are 'und' with score 0 and rejected. Others always get a
    learned language, if there is one; ``rejected`` says that the text is farther from all centroids than the floor of its
    language and length class. Columns may have any names.
    """
    ship(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    inside = text_col if dict(docs.dtypes)[text_col] == "string" and (keep is None or text_col in keep) else None
    extra = [] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]
    packed = docs.select(F.struct(*kept).alias("row"), *extra)
    schema = T.StructType([packed.schema["row"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return packed.mapInArrow(_predict(shared, schema, inside), schema)
