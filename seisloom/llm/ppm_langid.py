"""Operator 10: language by prediction by partial matching.

A tree of byte contexts of up to `ORDER` bytes holds, for each language, how often each byte followed each context. Its
statistics are frozen after training. A byte that a context has seen c times of n, with d different bytes, has the
probability c / (n + d); otherwise the context escapes with d / (n + d) to the distribution of the context shorter by a
byte, scaled to 1 without the bytes that the longer one has seen. Below the empty context all 256 bytes are alike. So
the probabilities after a context sum to 1, and the code length of a text under a language, the sum over its bytes, is
exact. The language with the shortest wins; the score is its posterior under equal priors.

Texts are lower-cased, and ASCII other than letters counts as one space, for training and prediction alike.

Training reads the texts of about `PER_LANGUAGE` labelled documents of each language, chosen by a hash of the id: a
bounded sample. All its grams are in the model, so what is broadcast is bounded by languages times sampled documents.

Cases: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing can be learned;
null languages are never learned; repeated rows are predicted each; whole texts count, however long; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, lean_batches, release, remainder, slices, small_batches

ORDER = 4
PER_LANGUAGE = 1500
#: Bytes whose code lengths are held at once, however long a text is.
WINDOW = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def symbols(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with `order` zero bytes before each, and where each text begins and ends."""
    pad = b"\0" * order
    plain = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]
    data = np.frombuffer(pad + pad.join(plain), np.uint8)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    begin = np.cumsum(sizes + order) - sizes
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    place = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], place[begin], place[begin + sizes]


def codes(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, `order` bytes before it and itself as one integer; what lies before the first is zero."""
    wide = data.astype(np.int64)
    code = np.zeros(len(wide), np.int64)
    for back in range(order, -1, -1):
        code <<= 8
        code[back:] |= wide[: len(wide) - back]
    return code


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `order` context bytes and the byte that follows, as integers, and their counts."""
    data, begin, end = symbols(texts, order)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    return np.unique(codes(data, order)[np.cumsum(inside[:-1]) > 0], return_counts=True)


@dataclass
class Contexts:
    """Contexts of one length. Only what was seen is stored; all arrays are sorted by their keys."""

    keys: np.ndarray  # a context's bytes and the byte that follows, as one integer
    bits: np.ndarray  # its code length under each language
    contexts: np.ndarray  # keys without the byte that follows
    escape: np.ndarray  # what a byte that is not among the context's keys costs before the context shorter by one is asked

    @staticmethod
    def of(code: np.ndarray, which: np.ndarray, count: np.ndarray, kinds: int, lower: Callable[[np.ndarray], np.ndarray]) -> tuple[Contexts, np.ndarray]:
        """And the probabilities of the keys. `lower` gives those that the next shorter contexts have for keys."""
        keys, inverse = np.unique(code, return_inverse=True)
        counts = np.bincount(inverse * kinds + which, weights=count, minlength=len(keys) * kinds).reshape(-1, kinds)
        contexts, first, owner = np.unique(keys >> 8, return_index=True, return_inverse=True)
        seen, below = counts > 0, lower(keys)
        total = np.add.reduceat(counts, first)
        different = np.add.reduceat(seen.astype(np.float64), first)
        rest = 1 - np.add.reduceat(np.where(seen, below, 0), first)  # of the shorter context, without the bytes excluded
        mass = np.where(different < 256, different, 0)  # nothing is left to escape to where all bytes were seen
        out = np.maximum(total + mass, 1)
        leave = np.where(total > 0, mass / out / np.maximum(rest, 1e-12), 1)
        chance = np.where(seen, counts / out[owner], leave[owner] * below)
        as_bits = lambda p: -np.log2(np.maximum(p, 1e-30)).astype(np.float32)
        return Contexts(keys, as_bits(chance), contexts, as_bits(leave)), chance


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted `table` holds each key, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class ContextTree:
    """levels[k]: the contexts of k bytes. Memory: for each key and each context, 8 bytes and 4 for each language."""

    languages: list[str]
    levels: list[Contexts]

    @staticmethod
    def build(languages: list[str], which: np.ndarray, code: np.ndarray, count: np.ndarray, order: int) -> ContextTree:
        """From grams (language's position, gram, count); not from none."""
        levels: list[Contexts] = []
        chance = np.zeros(0)
        for k in range(order + 1):
            mask = (1 << (8 * k)) - 1  # of the key with the context shorter by one

            def lower(keys: np.ndarray) -> np.ndarray:
                return chance[np.searchsorted(levels[-1].keys, keys & mask)] if levels else np.full((len(keys), len(languages)), 1 / 256)

            level, chance = Contexts.of(code & ((mask << 8) | 255), which, count, len(languages), lower)
            levels.append(level)
        return ContextTree(languages, levels)

    @property
    def order(self) -> int:
        return len(self.levels) - 1

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the others, under each language."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        left = np.arange(len(code))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            key = code[left] & ((1 << (8 * (k + 1))) - 1)
            at, hit = found(level.keys, key)
            out[left[hit]] += level.bits[at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            at, hit = found(level.contexts, key >> 8)
            out[left[hit]] += level.escape[at[hit]]
        out[left] += 8
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths in bits of each text (row) under each language (column), in windows of `WINDOW` bytes."""
        data, begin, end = symbols(texts, self.order)
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(self.order, len(data), WINDOW):
            to = min(len(data), at + WINDOW)
            code = codes(data[at - self.order : to], self.order)[self.order :]
            sums = np.zeros((len(code) + 1, len(self.languages)))
            np.cumsum(self.bits(code), axis=0, dtype=np.float64, out=sums[1:])
            out += sums[end.clip(at, to) - at] - sums[begin.clip(at, to) - at]
        return out

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The language with the shortest code for each text, and its posterior under equal priors: -1 and 0 of texts without letters."""
        best, chance = np.full(len(texts), -1), np.zeros(len(texts))
        for at, to in slices([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
            bits = self.lengths(texts[at:to])
            lettered = np.fromiter((bool(t and _LETTER.search(t)) for t in texts[at:to]), bool, to - at)
            best[at:to] = np.where(lettered, bits.argmin(1), -1)
            chance[at:to] = np.where(lettered, 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1), 0)
        return best, chance


def train(docs: DataFrame, order: int = ORDER, per_language: int = PER_LANGUAGE) -> ContextTree | None:
    """From (doc_id, text, lang); rows whose crc32(doc_id) modulo 3 is 1 are left out. None if there is nothing to learn."""
    known = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = known.where(F.col("text").isNotNull() & (place < share[F.col("lang")])).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for at, to in slices([t.encode("utf-8", "surrogatepass") for t in own]):
                    code, n = grams(own[at:to], order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frame = counted.toArrow()  # the model: the grams of a bounded sample
    if not frame.num_rows:
        return None
    languages = sorted(frame["lang"].unique().to_pylist())
    which = pc.index_in(frame["lang"], pa.array(languages)).to_numpy().astype(np.int64)
    return ContextTree.build(languages, which, frame["gram"].to_numpy(), frame["n"].to_numpy().astype(np.float64), order)


def predict(docs: DataFrame, tree: ContextTree | None) -> DataFrame:
    """`docs` (doc_id, text) with lang_pred and score; no shuffle."""
    lean_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tree = model.value
        for batch in small_batches(batches):
            texts = batch["text"].to_pylist()
            best, scores = tree.posteriors(texts) if tree else (np.full(len(texts), -1), np.zeros(len(texts)))
            names = [tree.languages[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs, train(docs)).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@any_names
def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents of `docs`, whole rows, whose language is known with a posterior of at least `least`."""
    lean_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    schema = docs.schema
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tree = model.value
        for batch in small_batches(batches):
            best, chance = tree.posteriors(batch.column(column).to_pylist()) if tree else (np.full(batch.num_rows, -1), 0)
            yield batch.filter(pa.array((best >= 0) & (chance >= least)))

    return docs.mapInArrow(run, schema)
