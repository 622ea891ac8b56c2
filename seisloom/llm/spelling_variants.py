"""Operator 13: spelling variants of words by a rare-first prefix filter over positional bigrams.

Counting: each task counts the words of its documents and hands on partial counts; Spark adds them up.

Candidates: the bigrams of all words are put into one global order, rarest first, and a word is indexed by its three
rarest, each with its position. One edit changes two bigrams at most, so two near words share one of their three, and
the edit lies right of it or left of it: right of it, the bigram's position from the left is the same in both words and
so is all before it; left of it, its position from the right is the same and so is all behind it. Of the remaining
piece, where the edit is, the half that the edit leaves alone is the same too. Position and these equal parts are the
join key, so that only words meet that differ within a few code points, and no bigram is a hot key. `levenshtein`
verifies each pair.

Cases: a null text has no words; a null id counts as the empty string in the checksum; words are compared code point by
code point, only A-Z is lower-cased; rows that repeat count each; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import checkpointed, small_batches

#: Of so many code points, and so many occurrences, at least.
LENGTH, OCCURRENCES = 5, 3
#: A checksum that this divides spoils a run.
SPOILED = 97
#: A form has so many times the word's occurrences.
TIMES = 2
#: One edit changes two bigrams, so two words at distance 1 share one of so many rarest.
RAREST = 3
#: A task hands its counts on once it holds so many words.
HELD = 400_000
#: Forms at least double the count, so 63 steps reach the last, and six rounds of doubling reach 63 steps.
ROUNDS = 6


def _letters() -> bytes:
    """Each byte of Latin-1: letters as they are, A-Z lower-cased, all else a space."""
    kept = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
    return bytes((b | 0x20 if b < 0x5B else b) if b in kept else 0x20 for b in range(256))


_LETTERS = _letters()


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters in Latin-1, one byte for a code point. What is not in Latin-1 becomes a question mark, which ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def spoilt(doc_id: str, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Of a document's distinct runs, those that lose a code point, with what is left."""
    start = crc32(f"{doc_id}:".encode())
    distinct = list(set(words))
    as_utf8 = distinct if b"".join(distinct).isascii() else [w if w.isascii() else w.decode("latin-1").encode() for w in distinct]
    sums = np.fromiter(map(crc32, as_utf8, repeat(start)), np.int64, len(distinct))
    for k in np.flatnonzero(sums % SPOILED == 0).tolist():
        word = distinct[k]
        at = int(sums[k]) % len(word)
        yield word, word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that are long enough, however rare."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in seen.items() if n and len(w) >= LENGTH]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in small_batches(batches, 500):
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text:
                    continue
                words = runs(text)
                seen.update(words)
                for word, left in spoilt(doc_id, words):
                    n = words.count(word)
                    seen[word] -= n
                    seen[left] += n
                if len(seen) > HELD:
                    yield told()
        yield told()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(word: Column) -> Column:
    """(b, i) for each bigram of a word and its position from 0."""
    at = F.sequence(F.lit(1), F.length(word) - 1)
    return F.transform(at, lambda i: F.struct(F.substr(word, i, F.lit(2)).alias("b"), (i - 1).alias("i")))


def _keys(word: Column, i: Column) -> Column:
    """What two words have in common if one edit apart and the bigram at i stays: side, the shorter one's length of the piece with the edit, and all equal parts."""
    size = F.length(word)

    def of(side: str, most: Column) -> list[Column]:
        out = []
        for less in (0, 1):
            rest = most - less  # the piece that holds the edit, in the shorter word
            half = F.floor(rest / 2).cast("int")
            kept = size - most  # known to be equal
            if side == "L":  # the edit is behind the bigram
                near = F.concat(F.lit("La"), rest, F.lit(" "), F.left(word, kept + half))
                far = F.concat(F.lit("Lb"), rest, F.lit(" "), F.left(word, kept), F.lit(" "), F.right(word, rest - half))
            else:
                near = F.concat(F.lit("Ra"), rest, F.lit(" "), F.right(word, kept + half))
                far = F.concat(F.lit("Rb"), rest, F.lit(" "), F.left(word, rest - half), F.lit(" "), F.right(word, kept))
            out += [F.when(rest >= 0, near), F.when(rest >= 2, far)]
        return out

    return F.concat(F.array(*of("L", size - i - 2)), F.array(*of("R", i)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b, for all pairs of `words` (word, n) at distance 1."""
    bigrams = words.select(F.explode(F.transform(_places(F.col("word")), lambda x: x["b"])).alias("b")).groupBy("b").agg(F.count("*").alias("f"))
    placed = words.select("word", "n", F.explode(_places(F.col("word"))).alias("at")).select("word", "n", "at.b", "at.i")
    # a bigram is two of 94 letters: at most 8836 rows
    order = F.struct("f", "b", "i")
    rare = placed.join(F.broadcast(bigrams), "b").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(order)), 1, RAREST).alias("rare"))
    keys = F.array_distinct(F.flatten(F.transform("rare", lambda x: _keys(F.col("word"), x["i"]))))
    index = rare.select("word", "n", F.explode(F.array_compact(keys)).alias("key"))
    a, b = (index.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    C.lean_batches(docs.sparkSession)
    words = checkpointed(word_counts(docs).where(F.col("n") >= OCCURRENCES))
    pairs = near_pairs(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    # the largest count first, then the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = pairs.select(F.explode(both).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    own = words.join(found, "word", "left")
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    named = checkpointed(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    links = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpointed(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return named.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
