"""Operator 12, quality by compression.

Two zstandard dictionaries are trained, one from texts labelled good and one from texts labelled bad. Every text is cut
into pieces of ``PIECE`` bytes (so that a dictionary, not the text's own past, decides what is short), each piece is
compressed with either, and the difference of the sums per byte of text (``SHRINK`` bytes added, so that a few bytes are
no evidence) is the text's advantage. A logistic curve turns the advantage into a score; it is fitted on labelled texts
that took no part in the dictionaries.

``SAMPLE`` bounds the labelled documents used for fitting and ``PIECES`` the pieces of either class that a dictionary is
trained from (both by order of hashes; equal pieces count once); scoring covers every row and every byte. Rows with
crc32(doc_id as text) % 5 == 0 are held out: their labels are never read. Labels, lang, source and doc_id are no inputs
of a score.

Defined results: null and empty texts have advantage 0 and so the score of no evidence; a document labelled more than
once counts as bad if any label says so; null labels are ignored; where one class has no labelled text to train or to
calibrate with, every score is the share of good training labels, smoothed by one of either; repeated rows repeat (for
calibration, rows of equal document and advantage count once); an empty table gives no rows; other columns are ignored.
No text is shuffled: the sample of labels is joined by broadcast, pieces that train are at most ``PIECES`` per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, slices, table, text_of

SAMPLE, PIECES, PIECE, DICTIONARY, LEVEL, SHRINK, THRESHOLD = 20_000, 3_500, 2_048, 112_640, 3, 64, 0.3
#: A dictionary of fewer pieces than this is their plain text; training needs more.
LEAST_TRAINED = 64


def pieces_of(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary for texts like these; always the same for the same pieces."""
    import zstandard

    if len(pieces) >= LEAST_TRAINED:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, pieces)) // 8), pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text, or nothing that repeats
            pass
    return b"".join(pieces)[:DICTIONARY]


@dataclass(frozen=True)
class Model:
    """Dictionaries of either class (None: nothing to tell them apart by) and the logistic curve of the advantage."""

    good: bytes | None
    bad: bytes | None
    slope: float
    middle: float


@lru_cache(maxsize=4)
def compressor(content: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def advantage(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """How many bytes a byte of each text is shorter with the good dictionary than with the bad one."""
    short, long = compressor(good).compress, compressor(bad).compress
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        parts = pieces_of(text)
        if parts:
            out[i] = sum([len(long(p)) - len(short(p)) for p in parts]) / (sum(map(len, parts)) + SHRINK)
    return out


def logistic_curve(x: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (never falling) and middle of the chance of a good text, by Newton's method on smoothed labels."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.abs(x).mean()) or 1.0
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1.0, 1e-6])  # few texts give a flat curve, so that scores stay near the rate
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(ridge), a.T @ (target - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    if w[0] <= 0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and their places in the order of hashes."""
    from xxhash import xxh64_intdigest

    for whole in batches:
        for batch in slices(whole, 1):
            rows = [(g, p) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces_of(t)]
            places = [xxh64_intdigest(p) >> 1 for _, p in rows]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array(places, pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["good", "place", "piece"])


def _advantages(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(advantage(batch.column(2).to_pylist(), model.good, model.bad))], ["doc_id", "good", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and curve, from training rows only."""
    spark = ship(docs.sparkSession)
    usable = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toPandas()
    good = (known.good > 0).to_numpy()
    prior = float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
    nothing = Model(None, None, 0.0, prior)
    if not good.any() or good.all():
        return nothing
    marked = spark.createDataFrame([(int(a), int(b)) for a, b in zip(known.doc_id, good)], "doc_id long, good int")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marked), "doc_id").select("doc_id", "good", "text")
    trains = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(2)) == 0
    cut = saved(rows.where(trains).select("good", "text").mapInArrow(_cut, "good int, place long, piece binary"), "pieces")
    made = []
    for label in (1, 0):
        own = cut.where(F.col("good") == label)
        last = own.select("place").distinct().orderBy("place").limit(PIECES).agg(F.max("place")).first()[0]
        if last is None:
            return nothing
        found = own.where(F.col("place") <= last).groupBy("place").agg(F.first("piece").alias("piece")).toPandas().sort_values("place")
        made.append(dictionary([bytes(p) for p in found.piece]))
    model = Model(*made, 0.0, prior)
    seen = rows.where(~trains).mapInArrow(partial(_advantages, model=model), "doc_id long, good int, x double").distinct()
    got = seen.orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(SAMPLE).toPandas()
    y = got.good.to_numpy() > 0
    if not y.any() or y.all():
        return nothing
    return Model(*made, *logistic_curve(got.x.to_numpy(float), y))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            texts = pc.fill_null(batch.column(2), "").to_pylist()
            x = advantage(texts, model.good, model.bad) if model.good is not None else np.zeros(len(texts))
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.middle, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array(x)], ["doc_id", "held_out", "score", "advantage"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and advantage of every row."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(partial(_scores, model=model), "doc_id long, held_out boolean, score double, advantage double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "advantage")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
