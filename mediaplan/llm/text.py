"""Words and token ids of whole texts, for functions that run inside tasks."""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: a-z, 0-9 and every byte of a non-ASCII character; the rest parts words.
_WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
VOCABULARY = "byte_bpe_50k"


def words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters; A-Z lower-cased. Null has none."""
    return text.lower().translate(_WORD_BYTES).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space; A-Z lower-cased. Null has none."""
    return text.lower().split() if text else []


def ids_of(found: list[bytes], known: dict, unknown: int = 0) -> np.ndarray:
    return np.fromiter(map(known.get, found, repeat(unknown)), np.int64, len(found))


def utf8(text: str = "text") -> Column:
    """The text as bytes, which Arrow hands over without decoding."""
    return F.col(text).cast("binary")


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """Schema of a frame with more columns behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The frame with its own columns of these names renamed to free ones, and the columns that give all
    of them back in order."""
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in names:
            moved[c] = free_name(df, f"_own_{c.lower()}")
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def _encoder(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(name))


@lru_cache(maxsize=2)
def added_tokens(name: str = VOCABULARY) -> dict[str, int]:
    """Strings that the tokenizers file gives ids of their own, wherever they stand in a text."""
    with open(vocabulary_file(name), encoding="utf-8") as lines:
        added = json.load(lines)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that depend on what stands around them are not supported")
    return {t["content"]: t["id"] for t in added}


def token_ids(texts: list[str | None], name: str = VOCABULARY):
    """Ids of each whole text, with strings of added tokens as ordinary text. The rank file
    and the tokenizers file of a name hold one vocabulary (a test compares their ids); the
    rank file's library takes a fifth of the time."""
    encode = _encoder(name).encode_ordinary
    for text in texts:
        yield encode(text) if text else []


def file_ids(texts: list[str | None], name: str = VOCABULARY):
    """Ids of each whole text as the tokenizers file gives them by default: added tokens have their own ids."""
    encoder, added = _encoder(name), added_tokens(name)
    for text in texts:
        if text and any(t in text for t in added):
            yield encoder.encode(text, allowed_special=set(added), disallowed_special=())
        else:
            yield encoder.encode_ordinary(text) if text else []
