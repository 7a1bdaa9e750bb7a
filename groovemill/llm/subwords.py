"""Subword ids of whole texts by a public tokenizer: distinct chunks are encoded once, and remembered for a while."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .text import Memo, bounds_of, chunks

#: Strings given to a tokenizer at once.
_AT_ONCE = 20_000
#: Letters up to U+00FF, after one space at most: what the tokenizers' patterns leave in one piece, and normal forms leave alone.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch


class Encode(NamedTuple):
    """Encodes byte strings.

    ids: gives all ids in a row and the number of ids of each string. fold: whether white space and the case of letters make no difference.
    """

    ids: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    fold: bool = False


def _by_lists(ids_of: Callable[[list[str]], list[list[int]]], fold: bool = False) -> Encode:
    def ids(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = ids_of(pa.array(strings, pa.binary()).cast(pa.string()).to_pylist())
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(lengths.sum())), lengths

    return Encode(ids, fold)


def _shape(tokenizer, text: str) -> str | None:
    """What the tokenizer's model gets of a text, if that is one piece."""
    normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(normal) if tokenizer.pre_tokenizer else []
    return pieces[0][0] if len(pieces) == 1 else None


def _plain_forms(tokenizer) -> tuple[dict[int, str | None], bool] | None:
    """For tokenizers that work letter by letter: what each letter and a space before them become, and whether case and space are lost."""
    parts = {c: _shape(tokenizer, c) for c in LETTERS}
    lead = _shape(tokenizer, " a")
    if None in parts.values() or lead is None or not lead.endswith(parts["a"]):
        return None
    forms = parts | {" ": lead.removesuffix(parts["a"])}
    if _shape(tokenizer, " " + LETTERS) != "".join(forms[c] for c in " " + LETTERS):
        return None
    return str.maketrans(forms), forms[" "] == "" and all(parts[c] == parts[c.lower()] for c in LETTERS)


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> Encode:
    """The tokenizers library with the vocabulary file at ``path``, as it comes: special tokens' strings in a text are these tokens.

    Words of nothing but letters go to the library's model straight away, in the form that its normalizer and
    pre-tokenizer give them; all else takes the whole way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    forms, fold = _plain_forms(tokenizer) or (None, False)
    tokenize = tokenizer.model.tokenize

    def ids_of(texts: list[str]) -> list[list[int]]:
        out = [[t.id for t in tokenize(s.translate(forms))] if forms and _PLAIN(s) else None for s in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), _AT_ONCE):
            some = rest[at : at + _AT_ONCE]
            for i, x in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out

    return _by_lists(ids_of, fold)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> Encode:
    """The tiktoken library with the ranks at ``path``, without special tokens."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    def ids_of(texts: list[str]) -> list[list[int]]:
        return [encoding.encode_ordinary(s) for s in texts]

    return _by_lists(ids_of)


@functools.lru_cache(maxsize=8)
def _memo(encode: Encode) -> Memo:
    def compute(strings: list[bytes]) -> pa.Array:
        ids, lengths = encode.ids(strings)
        return pa.LargeListArray.from_arrays(pa.array(bounds_of(lengths)), pa.array(ids))

    return Memo(compute)


def encode_rows(data: np.ndarray, ends: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row's ids start and end."""
    pieces, firsts = chunks(data, ends, encode.fold)
    if not len(pieces):
        return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
    coded = pieces.dictionary_encode()
    lists = _memo(encode)(coded.dictionary)
    lengths = lists.value_lengths().to_numpy()[coded.indices.to_numpy()]
    return lists.take(coded.indices).flatten().to_numpy(), bounds_of(lengths)[firsts]


def count_rows(data: np.ndarray, ends: np.ndarray, encode: Encode) -> np.ndarray:
    """The number of ids of each row."""
    pieces, firsts = chunks(data, ends, encode.fold)
    if not len(pieces):
        return np.zeros(len(ends) - 1, np.int64)
    coded = pieces.dictionary_encode()
    lengths = _memo(encode)(coded.dictionary).value_lengths().to_numpy()
    return np.diff(bounds_of(lengths[coded.indices.to_numpy()])[firsts])
