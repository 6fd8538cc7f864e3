"""Sharding by minimax contiguous partition.

Rows of equal text are one atomic group. Groups are ordered by a digest of the text, and the
order is cut into shards so that the largest shard is as small as it can be: the smallest
capacity at which greedy filling needs no more than the given number of shards.

Groups stay distributed. The driver only sees bins of the order, each with its total size:
cutting between bins gives a capacity that is enough, cutting anywhere inside a
bin one that no partition can beat. Where they differ, only bins that a cut can fall
into are read again, split in ``SPLIT``. Every reading holds at most a few thousand bins a
shard at any size of the corpus, and ends when the bins at the cuts are single groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from mediaplan.functions.sequences import number_rows
from mediaplan.sources.tables import keep

#: The order of groups has 2 ** 60 places.
SPACE = 60
FIRST_BITS, SPLIT_BITS = 12, 5
ROW_BYTES = 16
CHUNKS = 256
#: Rows of a chunk that is numbered in one piece, about, once there are more than CHUNKS of them.
CHUNK_ROWS = 50_000


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus a row's own bytes; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def place(text: str = "text") -> Column:
    """Where a text's group stands in the order."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, SPACE // 4), 16, 10).cast("long")


def fill(sizes: list[int], whole: list[bool], capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """Greedy cuts as (bin, bytes into it), None if more shards are needed. Bins not ``whole``
    can be cut anywhere."""
    upto = [0, *accumulate(sizes)]
    cuts, at = [], 0
    for _ in range(shards):
        if upto[-1] - at <= capacity:
            return cuts
        b = bisect_right(upto, at + capacity) - 1
        to = upto[b] if whole[b] else at + capacity
        if to <= at:
            return None
        cuts.append((b, to - upto[b]))
        at = to
    return None


def smallest_capacity(sizes: list[int], whole: list[bool], shards: int, least: int = 0) -> int:
    low, high = max(least, -(-sum(sizes) // shards), 0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if fill(sizes, whole, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _bins(groups: DataFrame, bits: int, parents: list[int] | None = None, parent_bits: int = 0) -> dict:
    at = F.shiftright("place", SPACE - bits)
    if parents is not None:
        groups = groups.filter(F.shiftright("place", SPACE - parent_bits).isin(parents))
    rows = groups.groupBy(at.alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest"))
    return {(r["bin"], bits): (r["size"], r["n"], r["largest"]) for r in rows.collect()}


def cut_places(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First places of the shards behind the first, and the smallest capacity.

    ``groups`` (place, size) has one row a group. The collected bins are 2 ** FIRST_BITS
    at first, then at most 2 ** SPLIT_BITS for each bin that a cut can fall into."""
    bins = _bins(groups, FIRST_BITS)
    while True:
        order = sorted(bins, key=lambda k: k[0] << (SPACE - k[1]))
        sizes, single = [bins[k][0] for k in order], [bins[k][1] == 1 for k in order]
        largest = max((bins[k][2] for k in order), default=0)
        enough = smallest_capacity(sizes, [True] * len(sizes), shards, largest)
        needed = smallest_capacity(sizes, single, shards, largest)
        if needed == enough:  # no partition is better than these cuts between bins
            cuts = fill(sizes, [True] * len(sizes), enough, shards)
            return [order[b][0] << (SPACE - order[b][1]) for b, _ in cuts], enough
        early = fill(sizes, [True] * len(sizes), needed, 2 * len(sizes) + shards) if needed >= max(sizes) else None
        late = fill(sizes, single, enough, shards)
        by_bits: dict[int, list[int]] = {}
        for b in _open_bins(sizes, single, early, late, needed, shards):
            by_bits.setdefault(order[b][1], []).append(order[b][0])
        for bits, parents in by_bits.items():
            for p in parents:
                del bins[p, bits]
            bins |= _bins(groups, min(SPACE, bits + SPLIT_BITS), parents, bits)


def _open_bins(sizes, single, early, late, needed, shards) -> set[int]:
    """Bins that the j-th cut can fall into at any capacity between the two."""
    upto, out = [0, *accumulate(sizes)], set()
    widest = max((s for s, one in zip(sizes, single) if not one), default=0)
    for j in range(1, shards):
        if early is not None:
            first = early[j - 1][0] if j <= len(early) else len(sizes)
        else:
            first = max(0, bisect_left(upto, j * (needed - widest)) - 1)
        last = late[j - 1][0] if j <= len(late) else len(sizes) - 1
        out |= {b for b in range(max(0, first - 1), min(last + 1, len(sizes))) if not single[b]}
    return out


def shard_rows(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, place, shard and slot (its number
    in the shard, without gaps from 0).

    Null and empty texts are one group. Rows of a text are always in one shard, so a text with
    more bytes than a shard's share makes its shard that large. Repeated rows get slots of their
    own; other columns are ignored; an empty table gives no rows."""
    rows = keep(docs.select("doc_id", row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                            place(text).alias("place")), "sized")
    groups = keep(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    firsts, _ = cut_places(groups, shards)
    shard = sum((F.when(F.col("place") >= first, 1).otherwise(0) for first in firsts), F.lit(0))
    dealt = rows.withColumn("shard", shard.cast("int"))
    # a shard, even one of a single text, is numbered in chunks by the hash of the document
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(CHUNKS, rows.count() // CHUNK_ROWS)))
    return number_rows(dealt, ["shard"], chunk, ["doc_id", "place", "size"], "slot")
