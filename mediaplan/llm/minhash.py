"""Near-dedup with b-bit MinHash.

1. One pass over the texts gives each document the digest of its shingle set, the low
   bits of its minima packed into longs, and a key for each band of whole minima.
   Documents with one set are one class, whose smallest doc_id stands for it.
2. Candidates: classes that share a band's key meet the centre of that key (never each
   other, so a key with a third of all classes gives as many pairs as it has classes). Pairs
   whose similarity, estimated by counting equal packed values and corrected for
   chance collisions, is far below the threshold are let go.
3. The rest are confirmed on full shingle sets; confirmed links make components.
4. Classes of one centre that are still in several components need more pairs. Those with too
   many shingles that nobody shares have no links; the others of a centre meet in blocks, where full sets
   are compared by what differs from the centre's. No pair leaves a block unless it joins two components.

Bands of 5 minima out of 120 lose a link at the threshold 0.85 with probability 8e-7."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mediaplan.sources.tables import keep

from .components import components
from .text import blank_words, utf8, with_fields

BANDS, ROWS, BITS = 24, 5, 4
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64 + (HASHES * BITS % 64 > 0)
#: Spread of the estimate at the threshold is 0.033; pairs are let go six spreads below.
MARGIN = 0.2
BLOCK = 256
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words if there are fewer."""
    found = blank_words(text)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * _FOLD + h[i:len(h) - size + 1 + i]
        out ^= out >> np.uint64(31)
    return np.unique(out + np.uint64(size))


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i:i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _sketch(batches, size):
    hashes = WordHashes()
    shift = (np.arange(HASHES) % (64 // BITS) * BITS).astype(np.uint64)
    word = np.arange(HASHES) // (64 // BITS)
    for batch in batches:
        digest, count, packed, bands = [], [], [], []
        for text in batch.column("_body").to_pylist():
            s = shingle_hashes(text, hashes, size)
            count.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            least = signature(s)
            low = (least & np.uint32(2**BITS - 1)).astype(np.uint64) << shift
            packed.append(np.bitwise_or.reduceat(low, np.flatnonzero(np.diff(word, prepend=-1))).view(np.int64))
            raw = least.reshape(BANDS, ROWS)
            bands.append([xxhash.xxh64_intdigest(raw[b].tobytes(), seed=b) - 2**63 for b in range(BANDS)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
             pa.array(bands, pa.list_(pa.int64())), *[pa.array([p[i] for p in packed], pa.int64()) for i in range(LONGS)]],
            ["doc_id", "n_shingles", "set_digest", "bands", *[f"s{i}" for i in range(LONGS)]])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    fields = "doc_id long, n_shingles long, set_digest binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(LONGS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_body"))
    return rows.mapInArrow(lambda b: _sketch(b, size), fields)


def estimated(a: str, b: str) -> Column:
    """Similarity from the packed low bits: equal values counted by bit counts, corrected
    for values that agree by chance once in 2 ** BITS."""
    lanes = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    same = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        used = min(64 // BITS, HASHES - i * (64 // BITS))
        same = same + used - F.bit_count(folded.bitwiseAND(lanes))
    chance = 2.0 ** -BITS
    return (same / HASHES - chance) / (1 - chance)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of some documents."""

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_hashes(t, hashes, size).view(np.int64) for t in batch.column("_body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("_body"))
    return texts.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"))
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    signs = classes.select("id", F.struct(*[f"s{i}" for i in range(LONGS)]).alias("sign"))
    return (pairs.join(signs.select(F.col("id").alias("a"), F.col("sign").alias("p")), "a")
            .join(signs.select(F.col("id").alias("b"), F.col("sign").alias("q")), "b")
            .filter(estimated("p", "q") >= percent / 100 - MARGIN).select("a", "b").distinct())


def _centred(keys: DataFrame) -> DataFrame:
    """(key, id): each class with the centre of each of its keys, the class that meets most others over
    all keys, as the text that the rest are copies of does; ties go to the smallest id."""
    weight = keys.groupBy("id").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("id")).alias("minus")))["minus"]
    centre = keep(keys.join(weight, "id").groupBy("key").agg((-best).alias("centre")), "centres")
    return keep(keys.join(centre, "key").select(F.col("centre").alias("key"), "id").distinct(), "centred")


def _unsettled(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label) of keys whose classes are in several components."""
    return _mixed(keep(keys.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")), "labelled"))


def _mixed(labelled: DataFrame) -> DataFrame:
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return keep(labelled.join(keep(split, "split-keys"), "key"), "unsettled")


def _own_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id, n (shingles) and own (those that no other member has) of each member."""
    held = keep(sets.join(members, "id", "left_semi"), "member-sets")
    single = held.select("id", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    return keep(held.select("id", F.size("shingles").alias("n")).join(own, "id", "left").fillna(0, ["own"]), "own-shingles")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (key, id, label, n) of each group with different labels. A
    group's members are dealt into blocks; each pair of blocks meets in one task's group of at most two blocks.

    Members travel as what differs between their sets and the centre's, which is little;
    x and y differ in what one of these differences has and the other has not, so counting common
    elements by one matrix product gives every similarity exactly. Of the links found between two
    blocks, only as many leave as are needed to join their labels."""
    counts = keep(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    mine = sets.select("id", F.col("shingles").alias("x"))
    centre = sets.select(F.col("id").alias("key"), F.col("shingles").alias("c"))
    differ = rows.join(mine, "id").join(centre, "key").select(
        "key", "id", "label", "n", F.concat(F.array_except("x", "c"), F.array_except("c", "x")).alias("d"))
    dealt = (keep(differ, "differences").join(counts, "key")
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")))

    def meet(pdf):
        size, row = pdf["d"].map(len).to_numpy(), np.repeat(np.arange(len(pdf)), pdf["d"].map(len))
        _, token, times = np.unique(np.concatenate(pdf["d"].to_numpy()), return_inverse=True, return_counts=True)
        several = times[token] > 1
        row, token = row[several], (np.cumsum(times > 1) - 1)[token[several]]
        left, right = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("first", "second"))
        n, label, ids = pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["id"].to_numpy()
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int((times > 1).sum()), 4096):  # a strip of elements at a time
            own = (token >= at) & (token < at + 4096)
            strip = np.zeros((len(pdf), 4096), np.float32)
            strip[row[own], token[own] - at] = 1
            common += strip[left] @ strip[right].T
        apart = size[left][:, None] + size[right][None, :] - 2 * common.astype(np.int64)
        link = (100 - percent) * (n[left][:, None] + n[right][None, :]) >= (100 + percent) * apart
        i, j = np.nonzero(link & (label[left][:, None] != label[right][None, :]))
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for a, b in zip(left[i].tolist(), right[j].tolist()):
            p, q = root(label[a]), root(label[b])
            if p != q:
                parent[p] = q
                out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return type(pdf)(out, columns=["a", "b"])

    columns = ["key", "first", "second", "block", "id", "label", "n", "d"]
    return dealt.select(*columns).groupBy("key", "first", "second").applyInPandas(meet, "a long, b long").distinct()


def near_components(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach, itself included) and kept.

    Documents are linked when their sets of ``size``-word shingles share at least ``percent``
    hundredths of their union. Null and empty texts have an empty set and no links; rows without
    doc_id are kept and have no component; rows that repeat a doc_id are one document with
    the links of all its texts, each with its own n_shingles; copies are one class. Other columns are ignored; an empty table gives no rows."""
    sketch = keep(sketches(docs, size), "sketches")
    filled = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    signs = [f"s{i}" for i in range(LONGS)]
    # copies of a set are counted out where they are read; bands and signs are equal within a class
    classes = keep(filled.groupBy("set_digest").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in signs]), "classes")
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = keep(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    keys = keep(keys.join(shared, "key"), "keys")
    centred = _centred(keys)
    met = centred.filter("id <> key").select(F.least("id", "key").alias("a"), F.greatest("id", "key").alias("b")).distinct()
    pairs = keep(_likely(met, classes, percent), "pairs")
    sets = keep(_sets(docs, keys.select("id").distinct(), size), "sets")  # the texts move once
    links = keep(_confirmed(pairs, sets, percent), "near-links")
    labels = keep(components(links), "labels")
    rest = _unsettled(centred, labels)
    if not rest.isEmpty():
        facts = _own_shingles(rest.select("id").distinct(), sets).filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
        rest = _mixed(keep(rest.join(facts, "id"), "linkable"))
        found = keep(_block_links(rest, sets, percent), "near-links")
        if not found.isEmpty():
            labels = keep(components(links.unionByName(found)), "labels")
    nodes = classes.select("set_digest", "id").join(labels, "id", "left").select(
        "set_digest", F.coalesce("component", "id").alias("component"))
    own = sketch.select("doc_id", "n_shingles", "set_digest")
    out = own.join(keep(nodes, "nodes"), "set_digest", "left")
    alone = F.col("component").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = near_components(docs, percent, size).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
