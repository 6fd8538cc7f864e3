"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the full length and then into the binary digits of
the rest, so every piece is a power of two long and a sequence by itself: no sequence
crosses documents and none is padded. Pieces of one length are one bucket."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaplan.functions.sequences import number_rows
from mediaplan.sources.tables import keep

from .text import VOCABULARY, file_ids

CHUNKS = 256
#: Rows of a chunk that is numbered in one piece, about, once there are more than CHUNKS of them.
CHUNK_ROWS = 50_000
END = 0


def piece_lengths(n: int, longest: int) -> list[int]:
    """Full pieces first, then the set bits of the rest from the highest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, longest: int = 1024, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, ``with_ids``, the ids of every piece.

    A document is the ids of its whole text and an end id; null and empty texts are the end
    id alone; repeated rows are cut one by one; other columns are ignored. ``longest`` is a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest is a power of two")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for i, found in enumerate(file_ids(part.column("text").to_pylist(), vocabulary)):
                    whole = np.array([*found, END], "<u4")
                    begin = 0
                    for n in piece_lengths(len(whole), longest):
                        own = whole[begin:begin + n]
                        doc.append(i)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                        begin += n
                    total += [len(whole)] * (len(doc) - len(total))
                columns = [part.column("doc_id").take(pa.array(doc, pa.int32())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, fields)


def pack(docs: DataFrame, longest: int = 1024, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """The pieces, each with sequence_id and offset (0: a piece is its whole sequence). Sequences are
    numbered bucket by bucket, the longest first, without gaps.

    Handles nulls, repeated rows and empty tables as ``pieces`` does."""
    cut = keep(pieces(docs, longest, vocabulary, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # 11 rows at most
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max([CHUNKS, *(n // CHUNK_ROWS for n in counts.values())])))
    numbered = number_rows(cut, ["length"], chunk, ["doc_id", "start", "ids_crc32", "doc_tokens"], "_n")
    base, before = F.lit(0), 0
    for length in sorted(counts, reverse=True):
        base = F.when(F.col("length") == length, before).otherwise(base)
        before += counts[length]
    return numbered.withColumn("sequence_id", (F.col("_n") + base).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_n")
