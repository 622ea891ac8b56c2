"""Operator 9: quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is compressed with each, in
independent blocks of `BLOCK` bytes, so that a long text cannot hide behind its own repetitions; every block counts.
The difference of the two sizes over the text's size, put through a logistic curve fitted to labelled texts that the
dictionaries have not seen, is the score.

Labels are learned from about `PER_CLASS` labelled rows of either class, chosen by a hash of the id, and from about
`BLOCKS` of their blocks for either dictionary: a bounded sample. Ids whose crc32 modulo 3 is 1 are left out.

Cases: a null or empty text has the difference 0 and the score that the curve gives it; labels other than 0 and 1, and
ids labelled both ways, teach nothing; if either class is missing, every score is the share of good labels (0.5
without labels); repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, checkpointed, lean_batches, release, remainder, small_batches

BLOCK = 2048
DICTIONARY = 112_640
LEVEL = 3
PER_CLASS = 3000
BLOCKS = 5000


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or, of too little text to train on, the text."""
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@lru_cache(4)
def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if len(data) >= 8 else zstandard.DICT_TYPE_RAWCONTENT
    trained = zstandard.ZstdCompressionDict(data, dict_type=kind)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / size, for each text."""
    of_good, of_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if parts := blocks(text):
            out[k] = (sum(len(of_bad(p)) for p in parts) - sum(len(of_good(p)) for p in parts)) / sum(map(len, parts))
    return out


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = difference(texts, self.good, self.bad) if self.slope else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a light ridge."""
    scale = x.std() or 1.0
    rows = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / scale, w[1]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_blocks: int = BLOCKS) -> QualityModel:
    lean_batches(docs.sparkSession)
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max")).where("quality = _max").drop("_max")
    sizes = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    flat = QualityModel(b"", b"", 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if len(sizes) < 2:
        return flat
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    picked = own.where(place < F.when(F.col("quality") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0]))  # about per_class of each
    picked = picked.withColumn("_fit", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0)
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    counts = {r["quality"]: r["n"] for r in sample.where("_fit").groupBy("quality").agg(F.sum(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / BLOCK)).alias("n")).collect()}
    if not all(counts.get(k) for k in (0, 1)):
        return flat
    shares = {k: min(1.0, most_blocks / n) for k, n in counts.items()}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows: list[tuple[int, bytes]] = []
            for doc_id, text, quality in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "quality")), strict=True):
                rows += [(quality, part) for k, part in enumerate(blocks(text)) if xxhash.xxh64_intdigest(f"{doc_id}/{k}") < shares[quality] * 2**64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["quality", "part"])

    chosen = sample.where("_fit").withColumn("quality", F.col("quality").cast("int")).select("doc_id", "text", "quality").mapInArrow(choose, "quality int, part binary").collect()  # about 2 * most_blocks blocks
    good, bad = (dictionary([bytes(r["part"]) for r in chosen if r["quality"] == k]) for k in (1, 0))
    if not good or not bad:
        return flat

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch["quality"], pa.array(difference(batch["text"].to_pylist(), good, bad))], names=["quality", "x"])

    rest = sample.where("NOT _fit").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(differ, "quality int, x double").collect()  # about 2 * per_class rows
    y = np.array([r["quality"] for r in rest], float)
    if len(set(y)) < 2:
        return flat
    # the sample holds as many of either class; the offset goes back to their shares among all labels
    slope, offset = logistic(np.array([r["x"] for r in rest]), y)
    offset += np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(good, bad, float(slope), float(offset))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(batch["text"].to_pylist()))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@any_names
def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents of `docs`, whole rows, whose score is at least `least`."""
    model = train(docs, labels)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in small_batches(batches):
            yield batch.filter(pa.array(model.score(batch.column(column).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
