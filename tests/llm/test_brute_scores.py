"""Scores of operators 5 and 9 against plain recomputations over whole tables."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash
import zstandard

from seisloom.llm import compression_quality, hmm_lm

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def spark_hash(doc_id: int, salt: int | None = None) -> int:
    """What xxhash64(doc_id) or xxhash64(doc_id, salt) is in Spark, unsigned."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return h if salt is None else xxhash.xxh64_intdigest(struct.pack("<i", salt), h)


def plain_difference(text, good, bad):
    data, total = (text or "").encode(), 0
    for k in range(0, len(data), 2048):
        sizes = []
        for trained in (good, bad):
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(z.compress(data[k : k + 2048])))
        total += sizes[1] - sizes[0]
    return total / len(data) if data else 0.0


def test_quality_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["quality"] in (0, 1)}
    fit = [i for i in own if i in texts and spark_hash(i, 7) % 2 == 0]
    rest = [i for i in own if i in texts and spark_hash(i, 7) % 2]
    parts = {q: [(i, k // 2048, t[k : k + 2048]) for i in fit if own[i] == q for t in [(texts[i] or "").encode()] for k in range(0, len(t), 2048)] for q in (0, 1)}
    chosen = {q: [p for i, k, p in of if xxhash.xxh64_intdigest(f"{i}/{k}") < min(1, 5000 / len(of)) * 2**64] for q, of in parts.items()}
    good, bad = (zstandard.train_dictionary(112_640, sorted(chosen[q])).as_bytes() for q in (1, 0))
    model = compression_quality.train(docs, labels)
    assert (model.good, model.bad) == (good, bad)
    x, y = np.array([plain_difference(texts[i], good, bad) for i in rest]), np.array([own[i] for i in rest], float)
    # the curve before its offset goes to the labels' shares: there the penalised likelihood is flat
    offset = model.offset - (math.log(sum(own.values()) / (len(own) - sum(own.values()))) - math.log(y.sum() / (len(y) - y.sum())))
    off = y - 1 / (1 + np.exp(-(model.slope * x + offset)))
    assert abs(off.sum() - 1e-3 * offset) < 1e-4 and abs((off * x / x.std()).sum() - 1e-3 * model.slope * x.std()) < 1e-4
    got = {r["doc_id"]: r for r in compression_quality.classified(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        score = 1 / (1 + math.exp(-max(-40, min(40, model.slope * plain_difference(text, good, bad) + model.offset))))
        assert math.isclose(got[i]["score"], score, abs_tol=1e-12) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_quality_with_clashing_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    odd = docs.select("*", F.lit(1).alias("quality"), F.lit("x").alias("score"), F.lit(True).alias("_fit"), F.lit(2).alias("predicted"))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(compression_quality.classified(odd, labels)) == key(compression_quality.classified(docs, labels))
    kept = compression_quality.keep_good(odd.withColumn("a.b", F.lit(3)), labels)
    assert kept.columns == [*odd.columns, "a.b"] and 0 < kept.count() < docs.count()


def test_language_model_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    # a very long text, words never seen, and no text at all; all held out or not by their ids
    docs = docs.union(spark.createDataFrame([(70001, "Never-seen words the the " * 20_000), (70002, "zzq zzq"), (70003, None), (70004, "")], docs.schema))
    chains, train = [], hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a: chains.append(train(*a)) or chains[-1])
    monkeypatch.setattr(hmm_lm, "HEAD", 1900)  # so that many words lie beyond the head
    got = {r["doc_id"]: r for r in hmm_lm.scored(docs).collect()}
    words = {r["doc_id"]: WORDS.findall((r["text"] or "").encode().lower()) for r in docs.collect()}
    training = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for w in training for x in w)
    kinds = sorted(set(x for w in words.values() for x in w))
    hashes, _, tails, _ = hmm_lm.word_hashes(kinds)
    signed, bucket = dict(zip(kinds, hashes.view(np.int64).tolist())), dict(zip(kinds, hmm_lm.buckets(tails).tolist()))
    end = (len(training), hmm_lm.END - (1 << 64) if hmm_lm.END >> 63 else hmm_lm.END, None)
    head = sorted([end, *((c, signed[w], w) for w, c in counts.items())], key=lambda r: (-r[0], r[1]))[:1900]
    own = {w: k for k, w in enumerate([w for _, _, w in head if w is not None][: hmm_lm.OWN])}
    mass, distinct = Counter(), Counter()
    for w, c in counts.items():
        if w not in own:
            mass[bucket[w]] += c
            distinct[bucket[w]] += 1
    share = lambda w: (counts[w] + 0.5) / (mass[bucket[w]] + 0.5 * (distinct[bucket[w]] + 1))
    # in each bucket the words and one word never seen have all of the probability
    for b in mass:
        assert math.isclose(sum(share(w) for w in counts if w not in own and bucket[w] == b) + 0.5 / (mass[b] + 0.5 * (distinct[b] + 1)), 1)
    (chain,) = chains
    assert np.allclose(chain.emit.sum(0), 1) and np.allclose(chain.move.sum(1), 1) and math.isclose(chain.start.sum(), 1)
    assert len(counts) > hmm_lm.OWN and any(w not in counts for w in kinds)
    for i, w in words.items():
        total, state = 0.0, None
        for x in [*w, None]:
            kind = hmm_lm.OWN if x is None else own.get(x, hmm_lm.OWN + 1 + bucket[x])
            state = (chain.start if state is None else state @ chain.move) * chain.emit[kind]
            total += math.log10(state.sum()) + (math.log10(share(x)) if x is not None and x not in own else 0)
            state = state / state.sum()
        assert math.isclose(got[i]["score"], total, rel_tol=1e-9) and got[i]["n_tokens"] == len(w) + 1


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    # two regimes that hold for a while, each with its own classes
    seqs = []
    for n in rng.integers(5, 200, 60):
        regime = np.cumsum(rng.random(n) < 0.1) % 2
        seqs.append(np.where(regime == 0, rng.integers(0, 6, n), rng.integers(6, 12, n)))
    chain = hmm_lm.Chain.first(np.bincount(np.concatenate(seqs), minlength=12).astype(float))
    reached = [chain.log10_likelihood(seqs).sum()]
    for _ in range(8):
        start, move, emit = chain.expected(seqs)
        chain = hmm_lm.Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        reached.append(chain.log10_likelihood(seqs).sum())
    assert all(b > a - 1e-3 for a, b in zip(reached, reached[1:])) and reached[-1] > reached[0] + 100
