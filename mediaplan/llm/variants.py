"""Spelling variants: words one edit apart, found with Gram matrices of letter counts.

Two words one edit apart agree in their first half or in all behind it, halves being those of the shorter.
So words are dealt to blocks by length, side and that half; a block holds words of two
adjacent lengths and meets every pair once (a pair that agrees on both sides belongs to the first). In a block
one matrix product of letter counts gives all squared distances; pairs at 1 or 2 are kept and their edits
checked. The product also carries a term that puts words of different blocks out of
reach, so that many small blocks share one product.

A task reads its blocks in order and holds one at a time. A block of more than ``BLOCK_ROWS`` words is dealt to several
tasks as pairs of its parts. What leaves a task is a row a word with its number of near words and the best."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from mediaplan.functions.skew import by_merge, join_hot
from mediaplan.sources.tables import keep

LEAST_POINTS, LEAST_COUNT, FACTOR = 6, 5, 5
DAMAGE = 199
BLOCK_ROWS = 16_384
#: Rows of one product: of many small blocks together, of a tile of a large one. Characters of its longest words together.
CHUNK_ROWS, TILE_ROWS, CHUNK_CHARS = 256, 1024, 4_000_000
#: Distinct words that a task holds before it hands counts on.
HELD_WORDS = 400_000
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: Columns of a count matrix: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def runs_of(doc_id: int | None, text: str | None):
    """(word, occurrences) of a text, with the damage of the rule done. Null text has none; without
    a doc_id no run is damaged."""
    if not text:
        return
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, times in Counter(_RUNS.findall(text)).items():
        low = run.encode().lower()
        word = low.decode()
        if start is not None and (mark := zlib.crc32(low, start)) % DAMAGE == 0:
            at = mark % len(word)
            word = word[:at] + word[at + 1:]
        yield word, times


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows (doc_id, text): every distinct word of ``LEAST_POINTS`` code points with
    its occurrences. Repeated rows count each time."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, times in runs_of(doc_id, text):
                    if len(word) >= LEAST_POINTS:
                        held[word] += times
                if len(held) >= HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def blocked(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, short, side, part, word, n): every word in each of its blocks. ``short`` is the shorter length of a block;
    ``part`` is -1, or the word's part where the task compares two parts of a large block."""
    size = F.length("word")

    def places(short):
        half = F.floor(short / 2).cast("int")
        return [F.struct(short.alias("short"), F.lit("first").alias("side"), F.substring("word", F.lit(1), half).alias("half")),
                F.struct(short.alias("short"), F.lit("last").alias("side"), F.substring("word", half - short, short - half).alias("half"))]

    rows = words.select("word", "n", F.explode(F.array(*places(size), *places(size - 1))).alias("p")).select("word", "n", "p.*")
    rows = rows.filter(F.col("short") >= LEAST_POINTS)
    key = F.concat_ws("/", F.lpad(F.col("short").cast("string"), 9, "0"), "side", "half")
    rows = rows.withColumn("key", key)
    large = (rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > block_rows)
             .select("key", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts")))
    rows = rows.join(keep(large, "large-blocks"), "key", "left")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                         lambda k: F.struct(F.concat_ws("/", "key", F.least(k, own), F.greatest(k, own)).alias("key"),
                                            F.when(k == own, -1).otherwise(own).alias("part")))
    alone = F.array(F.struct(F.col("key").alias("key"), F.lit(-1).alias("part")))
    return (rows.withColumn("to", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(others)))
            .select(F.col("to.key").alias("key"), "short", "side", F.col("to.part").alias("part"), "word", "n"))


def count_matrix(points: np.ndarray) -> np.ndarray:
    """Letter counts (a row a word) of padded words, whose letters are numbered from 1."""
    rows = np.arange(len(points)) * (LETTERS + 1)
    return np.bincount((rows[:, None] + points).ravel(), minlength=len(points) * (LETTERS + 1)).reshape(len(points), -1)[:, 1:]


def numbered(words: list[str], sizes: np.ndarray) -> np.ndarray:
    """Padded words: letters a-z as 1 to 26, U+00C0 on as 27 on, 0 behind the end."""
    code = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int16)
    code = np.where(code < 128, code - 96, code - 0xC0 + 27)
    out = np.zeros((len(words), int(sizes.max())), np.int16)
    out[np.arange(out.shape[1]) < sizes[:, None]] = code
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, left_block: np.ndarray, right_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of two count matrices in the same block at a squared distance of 1 or 2, by one product."""
    # whole numbers below 2^24 are exact in single precision
    kind = np.float32 if max(left.sum(axis=1).max(), right.sum(axis=1).max()) <= 1000 else np.float64

    def wide(counts, block, first):
        block = (block - min(left_block.min(), right_block.min())).astype(kind)[:, None]
        counts = counts.astype(kind)
        own = (counts * counts).sum(axis=1, keepdims=True) + 4 * block * block
        one = np.ones_like(own)
        return np.hstack([-2 * counts, -8 * block, own, one] if first else [counts, block, one, own])

    square = wide(left, left_block, True) @ wide(right, right_block, False).T
    return np.nonzero((square >= 1) & (square <= 2))


def one_edit(long: np.ndarray, short: np.ndarray, long_size: np.ndarray, short_size: np.ndarray) -> np.ndarray:
    """Which rows of padded words (the longer first) are one replaced or inserted code point apart."""
    width = short.shape[1]
    differs = long[:, :width] != short
    replaced = (long_size == short_size) & (differs.sum(axis=1) == 1)
    # inserted at p: alike before p, and alike from p on with the longer word one ahead
    inside = np.arange(width) < short_size[:, None]
    first = np.where((differs & inside).any(axis=1), (differs & inside).argmax(axis=1), short_size)
    ahead = np.zeros_like(short)
    ahead[:, :min(width, long.shape[1] - 1)] = long[:, 1:width + 1]
    moved = (ahead != short) & inside
    last = np.where(moved.any(axis=1), width - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return replaced | ((long_size == short_size + 1) & (first > last))


class _Blocks:
    """Rows of whole blocks, in order of their keys."""

    def __init__(self, batch: pa.Table):
        self.words = batch.column("word").to_pylist()
        self.n = batch.column("n").to_numpy()
        self.sizes = np.array([len(w) for w in self.words])
        self.short, self.part = batch.column("short").to_numpy(), batch.column("part").to_numpy()
        self.first = np.asarray(pa.compute.equal(batch.column("side"), "first"))
        self.block = np.cumsum(np.asarray(changes(batch.column("key"))))
        self.near = np.zeros(len(self.words), np.int64)
        self.best: dict[int, tuple] = {}

    def compare(self, a: slice, b: slice) -> None:
        """Pairs of rows of ``a`` with rows of ``b`` (the same rows, or rows behind them)."""
        width = int(max(self.sizes[a].max(), self.sizes[b].max()))
        mine = numbered(self.words[a], self.sizes[a])
        theirs = mine if a == b else numbered(self.words[b], self.sizes[b])
        counts = count_matrix(mine)
        i, j = near_pairs(counts, counts if a == b else count_matrix(theirs), self.block[a], self.block[b])
        if a == b:
            i, j = i[i < j], j[i < j]
        i, j = i + a.start, j + b.start
        lengthen = self.sizes[i] < self.sizes[j]
        long, short = np.where(lengthen, j, i), np.where(lengthen, i, j)
        # two words of the longer length meet in the block of that length; parts meet other parts only
        fits = (self.sizes[short] == self.short[short]) & ((self.part[i] < 0) | (self.part[i] != self.part[j]))
        long, short = long[fits], short[fits]
        if not len(long):
            return
        both = np.zeros((len(self.words[a]) + (0 if a == b else len(self.words[b])), width), np.int16)
        both[:len(mine), :mine.shape[1]] = mine
        if a != b:
            both[len(mine):, :theirs.shape[1]] = theirs
        place = lambda k: np.where((k >= a.start) & (k < a.stop), k - a.start, k - b.start + (0 if a == b else len(mine)))
        for at in range(0, len(long), max(1, CHUNK_CHARS // width)):
            l, s = long[at:at + max(1, CHUNK_CHARS // width)], short[at:at + max(1, CHUNK_CHARS // width)]
            x, y = both[place(l)], both[place(s)]
            good = one_edit(x, y, self.sizes[l], self.sizes[s])
            half = self.short[s] // 2  # pairs alike on both sides belong to the block of the first
            alike = ((x == y) | (np.arange(width) >= half[:, None])).all(axis=1)
            good &= self.first[s] | ~alike
            self.link(l[good], s[good])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.near, i, 1)
        np.add.at(self.near, j, 1)
        for own, other in zip(np.concatenate([i, j]).tolist(), np.concatenate([j, i]).tolist()):
            found = (-self.n[other], self.words[other])
            if own not in self.best or found < self.best[own]:
                self.best[own] = found

    def run(self) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.diff(self.block, prepend=-1))
        ends = np.append(starts[1:], len(self.block))
        k = 0
        while k < len(starts):
            begin, longest = starts[k], self.sizes[starts[k]:ends[k]].max()
            stop = ends[k]
            if stop - begin > CHUNK_ROWS or longest * (stop - begin) > CHUNK_CHARS:
                tile = int(max(1, min(TILE_ROWS, CHUNK_CHARS // longest)))
                tiles = [slice(t, min(t + tile, stop)) for t in range(begin, stop, tile)]
                for x, a in enumerate(tiles):
                    for b in tiles[x:]:
                        self.compare(a, b)
                k += 1
                continue
            k += 1
            while k < len(starts):  # further small blocks in the same product
                longest = max(longest, self.sizes[starts[k]:ends[k]].max())
                if ends[k] - begin > CHUNK_ROWS or longest * (ends[k] - begin) > CHUNK_CHARS:
                    break
                stop = ends[k]
                k += 1
            self.compare(slice(begin, stop), slice(begin, stop))
        own = sorted(self.best)
        if not own:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([self.words[i] for i in own]), pa.array(self.near[own]), pa.array([int(-self.best[i][0]) for i in own], pa.int64()),
             pa.array([self.best[i][1] for i in own])], ["word", "n_near", "near_n", "near"])


def changes(keys: pa.ChunkedArray) -> list[bool]:
    """Where a key differs from the one before; the first does."""
    own = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return [True, *pa.compute.not_equal(own[1:], own[:-1]).to_pylist()] if len(own) else []


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, near_n, near) of every word (word, n; distinct) with a near one: how many, and the one of largest n (of ties the
    first in code-point order) with its n."""

    def link(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = len(rows) - 1
            turn = [i for i, new in enumerate(changes(rows.column("key"))) if new]
            if not turn or turn[-1] == 0:  # one block that goes on
                held = rows
                continue
            whole, held = rows.slice(0, turn[-1]), rows.slice(turn[-1], last + 1 - turn[-1])
            if (out := _Blocks(whole).run()) is not None:
                yield out
        if held is not None and len(held) and (out := _Blocks(held).run()) is not None:
            yield out

    placed = blocked(words, block_rows).repartition("key").sortWithinPartitions("key")
    found = placed.mapInArrow(link, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct(-F.col("near_n"), "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.col1")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms are followed to the last by doubling, a round for twice the steps. Only
    roots that lead on are copied for the words that share them, and none goes through the driver."""
    known = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = by_merge(known.select("root").distinct()).join(by_merge(step), "root")
        moved = join_hot(known, by_merge(step), ["root"], "word", how="left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = keep(moved, "roots")
        known = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return known


def variant_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each word of at least ``LEAST_POINTS`` code points that occurs ``LEAST_COUNT`` times in the rows (doc_id,
    text): word, form, root, n, n_near, form_n.

    Null and empty texts have no words; an empty table gives no rows; repeated rows count each time;
    other columns are ignored. Ties of form go to the first word in code-point order; forms grow in n, so following
    them ends."""
    words = keep(word_counts(docs).filter(F.col("n") >= LEAST_COUNT), "words")
    none = F.lit(None)
    merged = (words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("near_n"), none.cast("string").alias("near"))
              .unionByName(near_words(words, block_rows).withColumn("n", none.cast("long")))
              .groupBy("word").agg(*[F.max(c).alias(c) for c in ("n", "n_near", "near_n", "near")]))
    near = F.col("near_n") >= FACTOR * F.col("n")
    found = keep(merged.select("word", F.when(near, F.col("near")).alias("form"), "n", "n_near", F.when(near, F.col("near_n")).alias("form_n")), "forms")
    ends = by_merge(roots(found.filter("form IS NOT NULL")))
    return (found.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
