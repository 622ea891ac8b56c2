import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seisloom.llm import packing, token_files, trie_bpe
from seisloom.llm.tokens import library

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(1, "Hello world, hello."), (2, None), (3, ""), (4, "a" * 9000), (5, "word " * 5000), (6, " \n\t x  y<|endoftext|>z"), (1, "Hello world, hello."), (None, "no id"), (8, "中文 😀 é\x00")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, piece string, n_tokens int")  # clashing names


def test_trie_equals_library(tokenizer):
    bpe, chunked = trie_bpe.coder(PATH)
    random.seed(4)
    parts = ["a", "th", " ", "  ", "\n", "\t", "é", "中", "😀", "'s", "1", "!!", "<|endoftext|>", "　", "aaaa", "\x00", "\xa0", "word", "Word.", " and", "\n\n", "'", "...", "%%%", '").']
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["a" * n for n in range(40)]
    for encode in (chunked.encode, library(PATH).encode):
        for text, ids in zip(texts, encode(texts), strict=True):
            expected = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected
            assert bpe.decode(ids) == tokenizer.decode(expected, skip_special_tokens=False)


def test_trie_query(spark, tokenizer):
    rows = trie_bpe.round_trip(frame(spark), PATH).collect()
    assert len(rows) == len(TEXTS)
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in rows) == sorted((i or -1, t or "") for i, t in TEXTS)
    assert trie_bpe.digests(frame(spark, []), PATH).count() == 0


def test_packing(spark, tokenizer):
    rows = packing.packed(frame(spark), PATH).toPandas()
    by_sequence = rows.sort_values("offset").groupby("sequence_id")
    for _, g in by_sequence:
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    expected = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert rows["length"].sum() == expected
    assert rows["sequence_id"].nunique() == -(-expected // 2048)
    for r in rows[rows["doc_id"] == 5].itertuples():
        ids = (tokenizer.encode("word " * 5000, add_special_tokens=False).ids + [0])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.packed(frame(spark, []), PATH).count() == 0


def test_plan_is_whole_and_tight():
    random.seed(1)
    for _ in range(200):
        size = random.choice([10, 50, 2048])
        histogram = {}
        for _ in range(random.randint(1, 300)):
            n = random.randint(1, size)
            histogram[n] = histogram.get(n, 0) + 1
        used, ranks = {}, {}
        for length, rank, count, sequence, per, offset in packing.plan(histogram, size):
            ranks.setdefault(length, []).extend(range(rank, rank + count))
            for k in range(count):
                used.setdefault(sequence + k // per, []).append((offset + (k % per) * length, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        total = sum(n * c for n, c in histogram.items())
        assert len(used) <= 1.25 * -(-total // size) + 1


def test_sequences(spark):
    rows = packing.sequences(frame(spark), PATH).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 2048 for r in rows)


def test_token_files(spark, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(frame(spark), PATH, folder, files=3)
    rows = token_files.read(spark, folder, manifest).collect()
    at = 0
    for r, (_, text) in zip(sorted(rows, key=lambda r: r["start"]), sorted(TEXTS, key=lambda x: (x[0] if x[0] is not None else -1, x[1] or "")), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(frame(spark, []), PATH).count() == 0


def test_token_files_read_only_what_is_asked(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as out:
        writer = token_files.TokenWriter(out, frame_bytes=64)
        for k in range(50):
            writer.add(k, np.full(k + 1, k, "<u4").tobytes())
        writer.finish()
    with open(path, "rb") as source:
        reader = token_files.TokenReader(source)
        assert len(reader.frames) > 10
        got = {d: np.frombuffer(ids, "<u4").tolist() for d, _, ids in reader.read([3, 40])}
        assert got == {3: [3] * 4, 40: [40] * 41}
    data = bytearray(path.read_bytes())
    data[20] ^= 255
    path.write_bytes(data)
    with open(path, "rb") as source, pytest.raises(Exception):
        list(token_files.TokenReader(source).read())


@pytest.mark.parametrize("size", [1 << 23, 3000])
def test_each_distinct_chunk_is_looked_up_once(tokenizer, monkeypatch, size):
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    monkeypatch.setattr(trie_bpe, "PASS", size)
    random.seed(6)
    letters = ["a", "th", "E", "é", "ß", "中", "ж", "ℵ", "ƻ", "ª", "ǅ", "한", "ا", "ñ"]
    words = ["".join(random.choices(letters, k=random.randint(1, 6))) + random.choice(["", "", ",", "...", "'s", "9", "<|endoftext|>"]) for _ in range(300)]
    texts = [random.choice([" ", "\n", ""]) + "".join(random.choice(words) + random.choice([" ", " ", " ", "\n"]) for _ in range(n)) for n in [1000] * 20 + [0, 1, 2, 3]] + ["", " ", "x", "x ", "\n", "\n\nx y\n\nz", "a  b", "a\tb c"]
    encoder = library(PATH, 300_001 + size)
    encoder.young = Counted()
    encoder.encode(texts)
    Counted.asked = 0
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    if size > 1 << 20:
        assert Counted.asked < 2000  # of 20,000 words
