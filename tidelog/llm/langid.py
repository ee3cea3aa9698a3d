"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its letters, weighted by TF-IDF and scaled
to length one. Every language has several centroids, found by spherical k-means over
its training texts. A text gets the language of the centroid with the highest cosine;
it is rejected if that cosine lies far below what training texts of like length reach.

The model is fitted on a bounded sample: at most about SAMPLE_PER_LANG texts a language
and SAMPLE_TOTAL in all, chosen by a hash of the row, so that a language with a third
of all rows adds no more than another. Each language has the row of its least hash in
the sample, so none is left out; only of more than SAMPLE_TOTAL languages, which cannot
all have a row, are the most frequent learned. Predictions read every text whole.

Defined results: a null text, and one without a letter, is `und` with score 0 and is
rejected; without any training row all texts are; repeated rows are judged alike; an
empty table gives an empty table; other columns are not read, and
`in_known_language` returns them unchanged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bytesops
from tidelog.llm.common import arrow_schema, crc_mod, documents, frugal, only, row_key, small_batches, spans_of, steady, text_buffer

BITS = 13
WIDTHS = (2, 3)
CENTROIDS = 3
SAMPLE_PER_LANG, SAMPLE_TOTAL = 500, 6000
#: A text is rejected under this share of the cosine that nearly all training texts reach.
REJECT_SHARE, REJECT_QUANTILE = 0.6, 0.01
HELD_OUT_MODULUS = 5
CHUNK = 1 << 18
UNKNOWN = "und"

#: Letters in lower case, one space for anything else of ASCII.
LETTERS = np.where((bytesops.LOWER >= ord("a")) & (bytesops.LOWER <= ord("z")) | (np.arange(256) >= 128), bytesops.LOWER, 32).astype(np.uint8)


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of length one
    idf: np.ndarray
    floor: np.ndarray  # lowest accepted cosine by log2 of the text's n-grams


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of some rows, one row each; n-grams of spaces only don't count."""
    edges = offsets - offsets[0]
    buf, rows = LETTERS[data[offsets[0] : offsets[-1]]], len(edges) - 1
    total = np.zeros(rows << BITS, np.int64)
    for width in WIDTHS:
        row, bucket = bytesops.grams(buf, edges, width, BITS)
        total += np.bincount(row << BITS | bucket, minlength=rows << BITS)
    total = total.reshape(rows, 1 << BITS)
    for width in WIDTHS:
        _, blank = bytesops.grams(np.full(width, 32, np.uint8), np.array([0, width]), width, BITS)
        total[:, blank] = 0
    return total


def weighted(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(total.astype(np.float32)) * idf
    return vector / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of row ranges of bounded size; a very long row is counted in parts."""
    for a, b in spans_of(offsets, CHUNK):
        for c in range(a, b, 128):
            d = min(b, c + 128)
            if offsets[d] - offsets[c] <= 2 * CHUNK or d - c > 1:
                yield c, d, counts(data, offsets[c : d + 1])
                continue
            total, overlap = 0, max(WIDTHS) - 1
            for at in range(int(offsets[c]), int(offsets[d]), CHUNK):
                stop = min(at + CHUNK + overlap, int(offsets[d]))
                total = total + counts(data, np.array([at, stop], np.int64))
                if at > offsets[c]:  # shorter n-grams of the overlap were counted twice
                    for width in WIDTHS:
                        _, twice = bytesops.grams(LETTERS[data[at : at + overlap]], np.array([0, overlap]), width, BITS)
                        live = total[0, twice] > 0
                        np.subtract.at(total[0], twice[live], 1)
            yield c, d, total


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one; the first seed is the mean, each next the farthest row."""
    k = min(k, len(x))
    centre = x.mean(axis=0)
    seeds = [x[int(np.argmax(x @ centre))]]
    while len(seeds) < k:
        seeds.append(x[int(np.argmin(np.max(x @ np.array(seeds).T, axis=1)))])
    found = np.array(seeds)
    for _ in range(rounds):
        nearest = np.argmax(x @ found.T, axis=1)
        for i in range(k):
            if (nearest == i).any():
                found[i] = x[nearest == i].sum(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


class Counted(NamedTuple):
    """A sampled text: the n-grams it has and how often, both as packed arrays."""

    lang: str
    bucket: bytes
    n: bytes

    def vector(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.bucket, np.uint16), np.frombuffer(self.n, np.uint32)


def sample(docs: DataFrame) -> list[Counted]:
    """A bounded sample of docs (doc_id, text, lang)."""
    whole = 1 << 30
    rows = only(steady(docs), "doc_id", "text", "lang").withColumn("row", row_key()).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "row", F.lit("langid")), F.lit(whole)))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    sizes = counted.orderBy(F.desc("n"), "lang").limit(SAMPLE_TOTAL).toArrow()
    if not sizes.num_rows:
        return []
    each = min(SAMPLE_PER_LANG, max(1, SAMPLE_TOTAL // sizes.num_rows))
    limit = np.maximum(np.minimum(1.0, each / sizes["n"].to_numpy()) * whole, sizes["least"].to_numpy() + 1)
    limits = docs.sparkSession.createDataFrame(pa.table({"lang": sizes["lang"], "most": pa.array(limit.astype(np.int64))}))
    chosen = rows.join(F.broadcast(limits), "lang").where("h < most")  # at most SAMPLE_TOTAL limits
    schema = "lang string, bucket binary, n binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b, total in pieces(data, offsets):
                buckets = [np.flatnonzero(t) for t in total]
                packed = [[i.astype(np.uint16).tobytes() for i in buckets], [t[i].astype(np.uint32).tobytes() for t, i in zip(total, buckets)]]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array(c, pa.binary()) for c in packed)], schema=out)

    table = chosen.select("text", "lang").mapInArrow(frugal(run), schema).toArrow()
    return sorted(Counted(*r) for r in zip(*(table[c].to_pylist() for c in out.names)))


def fit(docs: DataFrame) -> Model:
    """The model of docs' non-null languages."""
    small_batches(docs.sparkSession)
    rows = [r for r in sample(docs) if r.bucket]
    size = 1 << BITS
    seen = np.zeros(size, np.int64)
    for r in rows:
        seen[r.vector()[0]] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    langs, centroids, best, grams = [], [], [], []
    for lang, own in itertools.groupby(rows, key=lambda r: r.lang):
        own = list(own)
        total = np.zeros((len(own), size), np.float32)
        for i, r in enumerate(own):
            bucket, n = r.vector()
            total[i, bucket] = n
        x = weighted(total, idf)
        found = spherical_kmeans(x, CENTROIDS)
        langs += [lang] * len(found)
        centroids.append(found)
        best.append(np.max(x @ found.T, axis=1))
        grams.append(np.log2(total.sum(axis=1)).astype(int))
    if not rows:
        return Model([], np.zeros((0, size), np.float32), idf, np.ones(64, np.float32))
    best, grams = np.concatenate(best), np.concatenate(grams)
    floor, last = np.zeros(64, np.float32), 0.0
    for bin_ in range(64):
        if (grams == bin_).sum() >= 20:
            last = REJECT_SHARE * float(np.quantile(best[grams == bin_], REJECT_QUANTILE))
        floor[bin_] = last
    return Model(langs, np.concatenate(centroids).astype(np.float32), idf, floor)


def predict(docs: DataFrame, model: Model, *extra: str) -> DataFrame:
    """(doc_id, extra columns, lang_pred, score, rejected) for each row of docs."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.select("doc_id", *extra).schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = text_buffer(texts)
            langs, scores, rejected = [], [], []
            for a, b, total in pieces(data, offsets):
                cosine = weighted(total, model.idf) @ model.centroids.T if model.langs else np.zeros((b - a, 1))
                near, n = np.argmax(cosine, axis=1), total.sum(axis=1)
                for i in range(b - a):
                    if not model.langs or not has_letter(texts[a + i].as_py()):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                        continue
                    score = float(cosine[i, near[i]])
                    langs.append(model.langs[near[i]])
                    scores.append(min(1.0, max(0.0, score)))
                    rejected.append(score < model.floor[int(np.log2(max(1, n[i])))])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(scores), pa.array(rejected)], schema=out)

    return docs.select("doc_id", *extra, "text").mapInArrow(frugal(run), schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows whose language may be learned from."""
    return only(docs, "doc_id", "text", "lang").where(crc_mod("doc_id", HELD_OUT_MODULUS) != 0)


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for every row, learned from the rows that aren't held out."""
    out = predict(only(docs, "doc_id", "text"), fit(learnable(docs)))
    return out.withColumn("held_out", crc_mod("doc_id", HELD_OUT_MODULUS) == 0)


def in_known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected, with all their columns."""
    from tidelog.llm.exact_dedup import without_rows

    docs = steady(docs)
    known = predict(only(docs, "doc_id", "text").withColumn("row", row_key()), fit(learnable(docs)), "row")
    return without_rows(docs, known.where("rejected"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(documents(spark, sf_dir))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
