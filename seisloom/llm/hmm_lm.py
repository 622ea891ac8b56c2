"""Operator 5: language-model scores by a hidden Markov model.

Words are lower-cased; a text is its words and an end. All counts come from every training document: those whose crc32
of the id modulo 5 is not 1.

The model's symbols are classes of tokens. The `OWN` most frequent tokens and the end are classes of their own; other
words fall into `BUCKETS` classes by their last two bytes. A word has the probability (c + 0.5) / (N + 0.5 (V + 1))
within its bucket, with the bucket's tokens N and distinct words V, so that a word never seen has its share. A hidden
Markov chain over `STATES` latent states emits the classes. Baum-Welch trains it: each partition gathers the expected
counts of its sequences, which are summed by (state, state) and (state, class). Training cuts sequences every `SPAN`
tokens to keep its matrices even; scoring runs the scaled forward recursion over whole sequences, so the likelihood
is exact. The score is log10 P(classes) + the sum of log10 P(word | class).

Counts of the `HEAD` most frequent tokens are broadcast, a bounded table; occurrences of all other words meet their
counts in a join.

Words are known by 64-bit hashes. Cases: a null or empty text is the end alone; without training documents N and V are 0
and the model is uniform; repeated rows count and are scored each; a null id is in training; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import checkpointed, mix64, remainder, slices, small_batches, word_hashes

OWN = 1500
BUCKETS = 512
HEAD = 131_072
STATES = 8
ROUNDS = 6
SPAN = 256
SEED = 11
#: The hash that stands for the end of a text; the end's class is OWN.
END = int(mix64(np.array([0x656E64], np.uint64))[0])


def buckets(tail: np.ndarray) -> np.ndarray:
    """The bucket of words by their last two bytes."""
    return (mix64(tail.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """(h, bucket, c) of all tokens of `docs`; the bucket of the end is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(kinds)[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "bucket", "n"])

        for batch in small_batches(batches):
            texts = [t.lower() for t in C.raw_bytes(batch["text"])]
            for a, b in slices(texts):
                h, _, tail, _ = word_hashes(texts[a:b])
                held.append(np.concatenate([h, np.full(b - a, END, np.uint64)]))
                kinds.append(np.concatenate([buckets(tail), np.full(b - a, -1)]))
                size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                held, kinds, size = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, bucket int, n long").groupBy("h", "bucket").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The head's hashes in order, with counts and classes; what all tokens and each bucket sum up to."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    kinds: int
    bucket_log: np.ndarray

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.kinds + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of all counts; HEAD rows, and one for each bucket, reach the driver."""
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    h, bucket, c = (head[k].to_numpy() for k in ("h", "bucket", "c"))
    own = np.zeros(len(h), bool)
    own[np.flatnonzero(bucket >= 0)[:OWN]] = True
    classes = np.where(bucket < 0, OWN, np.where(own, np.cumsum(own) - 1, OWN + 1 + bucket))
    tokens, kinds = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # BUCKETS + 1 rows
        tokens[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    total, distinct = int(tokens.sum()), int(kinds.sum())
    np.subtract.at(tokens, bucket[own], c[own])
    np.subtract.at(kinds, bucket[own], 1)
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], c[order], classes[order], total, distinct, np.log10(tokens[:-1] + 0.5 * (kinds[:-1] + 1)))


def _coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """For each document: its class sequence, packed; sums over what the head knows; the hashes of the other words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pack = shared.value, zstandard.ZstdCompressor(level=1)
        logs = np.log10(v.counts + 0.5)
        for batch in small_batches(batches):
            texts = [t.lower() for t in C.raw_bytes(batch["text"])]
            seqs, tails, n_tokens, n_head, s_all, s_word = [], [], [], [], [], []
            for a, b in slices(texts):
                h, n, tail, _ = word_hashes(texts[a:b])
                ends = np.cumsum(n)
                h = np.insert(h, ends, np.uint64(END))  # after each text's words
                tail = np.insert(tail, ends, 0)
                cuts = np.concatenate([[0], ends + np.arange(1, b - a + 1)])
                at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
                known = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                group = buckets(tail)
                classes = np.where(h == END, OWN, OWN + 1 + group)
                classes[known] = v.classes[at[known]]
                inner = classes > OWN
                log = np.zeros(len(h))
                log[known] = logs[at[known]]
                if len(v.hashes) == 0:
                    log[h == END] = np.log10(0.5)
                within = np.where(inner, log - v.bucket_log[group], 0)
                s_all += np.add.reduceat(log, cuts[:-1]).tolist()
                s_word += np.add.reduceat(within, cuts[:-1]).tolist()
                n_head += np.add.reduceat(known.astype(np.int64), cuts[:-1]).tolist()
                n_tokens += (n + 1).tolist()
                rest = ~known & (h != END)
                small = classes.astype("<u2")
                for k in range(b - a):
                    own = slice(cuts[k], cuts[k + 1])
                    seqs.append(pack.compress(small[own].tobytes()))
                    tails.append(h[own][rest[own]].view(np.int64))
            arrays = [batch["doc_id"], batch["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(s_all), pa.array(s_word), pa.array(seqs, pa.binary()), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_head", "s_all", "s_word", "seq", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, s_all double, s_word double, seq binary, tail array<long>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @staticmethod
    def first(class_counts: np.ndarray) -> Chain:
        """Sticky states that emit the classes as often as all do, but for seeded noise."""
        rng = np.random.default_rng(SEED)
        emit = (class_counts[:, None] + 0.1) * np.exp(rng.normal(0, 1.0, (len(class_counts), STATES)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Chain(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    def expected(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (classes x states) of sequences of at most SPAN tokens."""
        seqs = sorted(seqs, key=len, reverse=True)
        sizes = np.array([len(s) for s in seqs])
        long, n = sizes[0], len(seqs)
        live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(long)]  # sequences of more than t tokens
        seen = np.zeros((long, n), np.int64)
        for k, s in enumerate(seqs):
            seen[: len(s), k] = s
        shown = self.emit.astype(np.float32)[seen]
        move = self.move.astype(np.float32)
        ahead = np.zeros((long, n, STATES), np.float32)
        scale = np.ones((long, n), np.float32)
        for t in range(long):
            m = live[t]
            a = (self.start.astype(np.float32) if t == 0 else ahead[t - 1, :m] @ move) * shown[t, :m]
            scale[t, :m] = a.sum(1)
            ahead[t, :m] = a / scale[t, :m, None]
        back = np.ones((n, STATES), np.float32)
        moves = np.zeros((STATES, STATES))
        weight = np.zeros((long, n, STATES), np.float32)
        for t in range(long - 1, -1, -1):
            m = live[t]
            weight[t, :m] = ahead[t, :m] * back[:m]
            if t:
                b = shown[t, :m] * back[:m] / scale[t, :m, None]
                moves += ahead[t - 1, :m].T @ b
                back[:m] = b @ move.T
        flat, used = seen.ravel(), weight.reshape(-1, STATES)
        emits = np.stack([np.bincount(flat, weights=used[:, s], minlength=len(self.emit)) for s in range(STATES)], 1)
        return weight[0].sum(0, dtype=np.float64), moves * self.move, emits

    def log10_likelihood(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Of whole sequences, by the scaled forward recursion."""
        out = np.zeros(len(seqs))
        order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
        while order:
            long = len(seqs[order[0]])
            part, order = order[: max(1, 1_000_000 // long)], order[max(1, 1_000_000 // long) :]
            sizes = np.array([len(seqs[k]) for k in part])
            seen = np.zeros((long, len(part)), np.int64)
            for j, k in enumerate(part):
                seen[: len(seqs[k]), j] = seqs[k]
            logs, a = np.zeros(len(part)), None
            for t in range(long):
                m = int(np.searchsorted(-sizes, -t, "left"))
                a = (self.start if a is None else a[:m] @ self.move) * self.emit[seen[t, :m]]
                total = a.sum(1)
                logs[:m] += np.log10(total)
                a /= total[:, None]
            out[part] = logs
        return out


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(s), "<u2") for s in batch["seq"].to_pylist()]


def _class_counts(coded: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(OWN + 1 + BUCKETS, np.int64)
        for batch in small_batches(batches):
            total += np.bincount(np.concatenate(_unpacked(batch)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    out = np.zeros(OWN + 1 + BUCKETS)
    for r in coded.select("seq").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def train(coded: DataFrame, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all training sequences; a round returns as many sums as the model has parameters."""
    own = coded.where("NOT held_out").select("seq")
    shares = _class_counts(own)
    chain = Chain.first(shares)
    shares = (shares + 0.1) / (shares + 0.1).sum()
    kinds = OWN + 1 + BUCKETS
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(chain)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((kinds, STATES))]
            for batch in small_batches(batches):
                spans = [s[k : k + SPAN] for s in _unpacked(batch) for k in range(0, len(s), SPAN)]
                for at in range(0, len(spans), 1500):
                    for total, part in zip(sums, shared.value.expected(spans[at : at + 1500]), strict=True):
                        total += part
            flat = np.concatenate([x.ravel() for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

        frame = own.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(STATES + STATES * STATES + kinds * STATES)
        flat[frame["cell"].to_numpy()] = frame["n"].to_numpy()
        start, move, emit = flat[:STATES] + 0.1, flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1, flat[STATES + STATES**2 :].reshape(kinds, STATES)
        emit = emit + 10 * shares[:, None]
        chain = Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return chain


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    counts = checkpointed(_counts(docs.where("NOT held_out")))
    words = vocabulary(counts)
    coded = checkpointed(_coded(docs, words).withColumn("_key", F.monotonically_increasing_id()))
    chain = docs.sparkSession.sparkContext.broadcast(train(coded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            logs = chain.value.log10_likelihood(_unpacked(batch))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns[:-1]), pa.array(logs)], names=columns)

    columns = ["_key", "doc_id", "held_out", "n_tokens", "n_head", "s_all", "s_word", "chain"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    likely = coded.select(*columns[:-1], "seq").mapInArrow(run, f"_key long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, s_all double, s_word double, chain double")
    rest = coded.select("_key", F.explode("tail").alias("h")).join(counts.select("h", "c"), "h", "left")
    # words beyond the head: the buckets' norms were taken off with the others
    sums = rest.groupBy("_key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s_rest"), F.count("c").alias("n_rest"))
    whole = likely.join(sums, "_key", "left")
    s_rest, n_rest = F.coalesce("s_rest", F.lit(0.0)), F.coalesce("n_rest", F.lit(0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + n_rest).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("s_all") + s_rest - F.col("n_tokens") * words.base_log).alias("base_score"), (F.col("chain") + F.col("s_word") + s_rest).alias("score"))
