"""Encoding with a public byte-level BPE, as a monoid over pieces of text.

A long text is halved recursively, the leaves are encoded, and neighbours are joined: a window around the seam grows
to both sides until it ends at positions where every left-to-right scan of the pre-tokenizer has a boundary; only the
window is encoded again. Such a position lies between a letter, a digit or another mark (but an apostrophe) and a
character of another class: the pre-token that holds the former can't hold the latter. Tokens outside the window are
therefore those of the whole text. Decoding concatenates bytes up the same tree.

Defined results: null and empty texts have no ids; what looks like a special token is ordinary text."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Folder of the vocabulary files.
TOKENIZER_DIR = os.environ.get("QUILLSTONE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, and of the first window to either side of a seam.
LEAF, WINDOW = 16_384, 32

_SURE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")


@functools.lru_cache(maxsize=4)
def encoding(name: str, folder: str = TOKENIZER_DIR) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(name: str, folder: str = TOKENIZER_DIR) -> list[int]:
    e = encoding(name, folder)
    return [len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)]


def _sure_left(text: str, a: int, seam: int) -> int:
    """Last sure boundary in (a, seam), by growing windows; a if there is none."""
    w = WINDOW
    while True:
        lo = max(a, seam - w)
        found = [m.start() for m in _SURE.finditer(text, lo + (lo > a), seam)]
        found = [p for p in found if lo < p < seam]
        if found:
            return found[-1]
        if lo == a:
            return a
        w *= 4


def _sure_right(text: str, seam: int, b: int) -> int:
    """First sure boundary in (seam, b); b if there is none."""
    m = _SURE.search(text, seam + 1, b)
    return m.start() if m else b


def _span(n_bytes: int, ids: list[int], sizes: list[int], backwards: bool) -> int:
    """How many ids from one end hold ``n_bytes``."""
    k = 0
    while n_bytes > 0:
        n_bytes -= sizes[ids[-1 - k] if backwards else ids[k]]
        k += 1
    if n_bytes:
        raise ValueError("a token crosses a sure boundary")
    return k


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, leaf: int = LEAF) -> list[int]:
    """Ids of a whole text."""
    if not text:
        return []
    enc = encoding(name, folder)
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    sizes = token_bytes(name, folder)

    def join(a: int, seam: int, b: int, left: list[int], right: list[int]) -> list[int]:
        p, q = _sure_left(text, a, seam), _sure_right(text, seam, b)
        drop = _span(len(text[p:seam].encode("utf-8", "surrogatepass")), left, sizes, True)
        skip = _span(len(text[seam:q].encode("utf-8", "surrogatepass")), right, sizes, False)
        del left[len(left) - drop :]
        left += enc.encode_ordinary(text[p:q])
        left += right[skip:]
        return left

    def tree(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return enc.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        return join(a, seam, b, tree(a, seam), tree(seam, b))

    return tree(0, len(text))


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    enc = encoding(name, folder)

    def tree(a: int, b: int) -> bytes:
        return enc.decode_bytes(ids[a:b]) if b - a <= 65_536 else tree(a, (a + b) // 2) + tree((a + b) // 2, b)

    return tree(0, len(ids)).decode("utf-8")


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, ids)`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({key: x[key], "ids": [encode(t, name, folder) for t in x[text]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def count_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, tokens)`` of every row, without sending the ids back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({key: x[key], "tokens": [len(encode(t, name, folder)) for t in x[text]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, tokens int")
