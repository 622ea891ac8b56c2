"""Token ids of whole texts by the tokenizers library, for packing and token files."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np

from .common import held
from .trie_bpe import MEMORY, ChunkedEncoder

#: Words that the library is given as lines of one text.
LINES = 32


def library(path: str, memory: int = MEMORY) -> ChunkedEncoder:
    """The library's encoder, called once for each distinct chunk between spaces; one for each Python worker."""
    return held(f"library {path} {memory}", lambda: _library(path, memory))


def _library(path: str, memory: int) -> ChunkedEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def each(texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 5000):
            for e in tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    feed = next(each(["\n"]))

    def encode(chunks: list[str]) -> list[bytes]:
        # a line feed between words is a token of its own, which no word has
        words = [c for c in chunks if (c[1:] if c[:1] == " " else c).isalpha()] if len(feed) == 4 else []
        known: dict[str, bytes] = {}
        lines = [words[at : at + LINES] for at in range(0, len(words), LINES)]
        for own, ids in zip(lines, each(["\n".join(x) for x in lines]), strict=True):
            cuts = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == int.from_bytes(feed, "little"))).tolist()
            known.update(zip(own, [ids[a + 4 : b] for a, b in pairwise([-4, *cuts, len(ids)])], strict=True))
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, each(rest), strict=True))
        return [known[c] for c in chunks]

    return ChunkedEncoder(encode, memory)
