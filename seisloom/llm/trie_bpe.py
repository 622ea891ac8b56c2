"""Operator 6: byte-pair encoding over a trie of distinct words, and decoding.

The words of a batch are inserted in sorted order into a trie. Its nodes are visited depth first; each gets the last
token of the encoding of the prefix that ends there, so a prefix that many words share is encoded once. The last token
is the one vocabulary entry t, among those that end at the node, for which (last token where t begins, t) is a pair
that no merge would join: dropping the last token of a valid encoding leaves a valid encoding.

Cases: a null or empty text has no ids; a text that holds the end-of-text marker gets its id there, as the library
does; repeated rows give repeated results; very long words are encoded in linear time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import held, small_batches, texts_of

#: The pre-tokenisation pattern that byte-level vocabularies of this family are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Chunks remembered between batches, of at most LONG characters, some 250 bytes each: beyond MEMORY new ones, those not met since the last time go. So an encoder has at most some 500 bytes for each of them.
MEMORY = 300_000
LONG = 64
#: Characters that are split and numbered at once, unless one text has more.
PASS = 1 << 23
#: White space other than space and line feed; the first nine are ASCII.
_RARE = [*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\0", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        names = spec["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in names.items() if all(c in letters for c in s)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = names[a], names[b], names[a + b]
            self.rank[left, right] = order
            self.halves.setdefault(whole, (left, right, order))
        self.tails = lru_cache(1 << 17)(lambda t: self._spine(t, 1))
        self.heads = lru_cache(1 << 17)(lambda t: self._spine(t, 0))
        self._apart: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The tokens at one edge of `token` while it was built, each with the rank of the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return tuple(out)
            *both, ends = self.halves[token]
            token = both[side]

    def stay_apart(self, left: int, right: int) -> bool:
        """True if merging the bytes of both gives these two tokens: no merge over their border comes before those that build them."""
        key = (left, right)
        if (known := self._apart.get(key)) is None:
            rank = self.rank
            known = not any((r := rank.get((a, b))) is not None and r < ends_a and r <= ends_b for a, ends_a in self.tails(left) for b, ends_b in self.heads(right))
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words. The trie's nodes on the current path are `last`; its branches follow the sorted order."""
        ids, longest, apart, out = self.ids, self.longest, self.stay_apart, {}
        last: list[int] = [-1]  # by depth: the last token of the prefix of that many bytes
        size: list[int] = [0]
        before = b""
        for word in sorted(words):
            n = min(len(word), len(before))
            shared = next((k for k in range(n) if word[k] != before[k]), n) if word[:n] != before[:n] else n
            del last[shared + 1 :], size[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for begin in range(max(0, depth - longest), depth):
                    token = ids.get(word[begin:depth])
                    if token is not None and (begin == 0 or apart(last[begin], token)):
                        last.append(token)
                        size.append(depth - begin)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= size[at]
            out[word] = tokens[::-1]
            before = word
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of texts."""
        parts = [self._parts(c) for c in chunks]
        known = self.encode_words({w for p in parts for w in p if isinstance(w, bytes)})
        packed = {w: struct.pack(f"<{len(t)}I", *t) for w, t in known.items()}
        return [b"".join(packed[w] if isinstance(w, bytes) else struct.pack("<I", w) for w in p) for p in parts]

    def _parts(self, text: str) -> list[bytes | int]:
        """Words as bytes, special tokens as ids."""
        if self.split is None or not any(s in text for s in self.special):
            return [w.encode() for w in self.words.findall(text)]
        return [y for x in self.split.split(text) for y in ([self.special[x]] if x in self.special else [w.encode() for w in self.words.findall(x)])]

    def decode(self, packed: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


class ChunkedEncoder:
    """Encodes texts by their chunks between single spaces, which no pre-token crosses, remembering the ids of chunks.

    The ids of a word and the marks after it are those of both, so that a word is encoded once, whatever follows it. A
    text with white space next to a space, or with rare white space, is encoded as a whole, since chunks could differ.
    """

    MARKS = ".,;:!?%&#*'\"()[]{}<>|/\\^_~`@$+=-"

    def __init__(self, encode: Callable[[list[str]], list[bytes]], memory: int = MEMORY):
        self.encode_chunks, self.memory = encode, memory
        self.young: dict[str, bytes] = {}  # of a space and the key, or of a key that begins with a line feed
        self.old: dict[str, bytes] = {}  # what was young before

    @staticmethod
    def odd(text: str) -> bool:
        return "  " in text or " \n" in text or "\n " in text or any(c in text for c in (_RARE[:9] if text.isascii() else _RARE))

    def parts(self, text: str) -> tuple[str, str | None]:
        """The first chunk, and what comes after its space, if there is one. A line feed begins a chunk of its own, so it gets a space before it; of two line feeds the second may belong to the first."""
        if self.odd(text):
            return text, None
        head, space, rest = (text if "\n\n" in text else text.replace("\n", " \n")).partition(" ")
        return head, rest if space else None

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks that are not the first; the shorter ones are remembered."""
        young, old, marks = self.young, self.old, self.MARKS
        known: dict[str, bytes] = {}
        asked: list[str] = []
        ended: list[tuple[str, str]] = []
        for c in missing:
            if (ids := old.get(c)) is not None:
                known[c] = ids
            elif len(b := c.rstrip(marks)) < len(c) and (b.isalpha() or (b[:1] == "\n" and b[1:].isalpha())):
                ended.append((c, b))
            else:
                asked.append(c)
        words = {b: young.get(b) or old.get(b) for _, b in ended}
        asked = list({*asked, *(b for b, ids in words.items() if ids is None)})
        fresh = dict(zip(asked, self.encode_chunks([c if c[:1] == "\n" else f" {c}" for c in asked]), strict=True))
        known.update(fresh)
        runs = list({c[len(b) :] for c, b in ended})
        marked = dict(zip(runs, self.encode_chunks(runs), strict=True))
        for c, b in ended:
            known[c] = (words[b] or fresh[b]) + marked[c[len(b) :]]
        young.update(known if max(map(len, known), default=0) <= LONG else {c: ids for c, ids in known.items() if len(c) <= LONG})
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= PASS or k + 1 == len(texts):
                out += self._encode(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Arrow splits the texts and numbers the distinct chunks; only these are looked up, and Arrow lays out their ids in the order of the texts."""
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}
        heads, rests = zip(*map(self.parts, texts), strict=True)
        asked = list(set(heads))
        first = dict(zip(asked, self.encode_chunks(asked), strict=True))
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        if not len(numbered):
            return [first[h] for h in heads]
        # no chunk holds a space
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        ids = list(map(self.young.get, chunks))
        if missing := [c for c, x in zip(chunks, ids, strict=True) if x is None]:
            known = self.learn(missing)
            ids = [known[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
        laid = pa.array(ids, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1, laid.offset * 8)
        cuts = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        return [first[h] + data[a:b] for h, (a, b) in zip(heads, pairwise(cuts), strict=True)]


def coder(path: str) -> tuple[TrieBpe, ChunkedEncoder]:
    """One for each Python worker."""

    def make() -> tuple[TrieBpe, ChunkedEncoder]:
        bpe = TrieBpe(path)
        return bpe, ChunkedEncoder(bpe.encode_chunks)

    return held(f"coder {path}", make)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded string) of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunked = coder(tokenizer)
        for batch in small_batches(batches):
            ids = chunked.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.large_binary()).cast(pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = texts_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same with digests in place of ids and text, which need not reach the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunked = coder(tokenizer)
        for batch in small_batches(batches):
            ids = chunked.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = texts_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
