"""Benchmark decontamination: an FM-index of every training shard is searched for the
phrases of a benchmark.

A shard is what one task holds of the corpus at a time (at most ``SHARD_WORDS`` words, or
one document). Its text is a sequence of word numbers; words that no phrase has are one
symbol that ends a stretch, and a stretch shorter than the shortest phrase, which cannot
hold one, is left out. Suffixes are sorted within their stretch, equal ones by place, so
the last-to-first mapping holds. Phrases are searched backwards, all at once, with ranks in a
wavelet matrix of the last column; rows are located by walking to a sampled suffix.

Nothing is shuffled: a document's spans come from the task that read it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .text import free_name, ids_of, set_aside, utf8, with_fields, words

WINDOW = 13
#: Words of one index; about 60 bytes each in a task.
SHARD_WORDS = 1_000_000
#: Characters of benchmark text that are searched in one pass; a larger set takes more passes.
BLOCK_CHARS = 4_000_000
SAMPLE = 32


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        current = sequence.astype(np.int32)
        for shift in range(self.bits - 1, -1, -1):
            bit = ((current >> shift) & 1).astype(bool)
            zeros = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            current = np.concatenate([current[~bit], current[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` ends up on the last level when its symbol's bits are followed."""
        for level, (zeros, total) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            before = zeros[at]
            at = np.where(one, total + at - before, before)
        return at

    def follow(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and where they end up."""
        symbol = np.zeros(len(at), np.int64)
        for zeros, total in self.levels:
            before = zeros[at]
            one = zeros[at + 1] == before
            symbol = symbol * 2 + one
            at = np.where(one, total + at - before, before)
        return symbol, at


class FMIndex:
    def __init__(self, sequence: np.ndarray, symbols: int, shortest: int):
        known = sequence > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        long = end - start >= shortest
        start, end = start[long], end[long]
        size = end - start + 1  # with the symbol that ends the stretch
        first = np.cumsum(size) - size
        n = int(size.sum())
        self.place = np.repeat(start - first, size) + np.arange(n)
        stop = np.repeat(first + size - 1, size)
        text = np.append(sequence, 0)[self.place]
        text[first + size - 1] = 0
        suffixes = self._sorted_suffixes(text, stop, symbols, int(size.max(initial=1)))
        last = text[suffixes - 1]
        begins = np.zeros(n, bool)
        begins[first] = True
        last[begins[suffixes]] = 0
        self.n = n
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.ranks = WaveletMatrix(last, symbols)
        self.zero = self.ranks.place(np.arange(symbols), np.zeros(symbols, np.int64))
        self.sampled = begins[suffixes] | (suffixes % SAMPLE == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = suffixes[self.sampled]

    @staticmethod
    def _sorted_suffixes(text, stop, symbols, longest):
        n, here = len(text), np.arange(len(text))
        width = max(1, 62 // max(1, int(symbols).bit_length()))
        key, covered = np.zeros(n, np.int64), 0
        for covered in range(width):
            at = here + covered
            key = key * (symbols + 1) + np.where(at <= stop, text[np.minimum(at, n - 1)] + 1, 0)
        covered = width
        order = np.argsort(key, kind="stable")
        while covered < longest:
            new = np.empty(n, bool)
            new[:1] = True
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            at = here + covered
            key = rank * (n + 1) + np.where(at <= stop, rank[np.minimum(at, n - 1)], 0)
            order = np.argsort(key, kind="stable")
            covered *= 2
        return order

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with the phrases; these are right-aligned rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            active = np.flatnonzero((step < lengths) & (low < high))
            if not len(active):
                break
            symbol = phrases[active, phrases.shape[1] - 1 - step]
            base = self.below[symbol] - self.zero[symbol]
            low[active] = base + self.ranks.place(symbol, low[active])
            high[active] = base + self.ranks.place(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows."""
        found, steps = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        open_, at = np.arange(len(row)), row.copy()
        step = 0
        while len(open_):
            done = self.sampled[at]
            found[open_[done]] = self.samples[self.sample_rank[at[done]]]
            steps[open_[done]] = step
            open_, at = open_[~done], at[~done]
            symbol, place = self.ranks.follow(at)
            at = self.below[symbol] + place - self.zero[symbol]
            step += 1
        return self.place[found + steps]


def phrase_table(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict:
    """Word numbers of the distinct windows of all items, and which items have each."""
    known: dict[bytes, int] = {}
    owners: dict[tuple, set] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    for name, text in items:
        found = [known.setdefault(w, len(known) + 1) for w in words(text)]
        for i in range(max(len(found) - window + 1, min(1, len(found)))):
            owners.setdefault(tuple(found[i:i + window]), set()).add(number[name])
    lengths = np.array([len(p) for p in owners], np.int64)
    table = np.zeros((len(owners), window), np.int64)
    for i, phrase in enumerate(owners):
        table[i, window - len(phrase):] = phrase
    counts = np.array([len(o) for o in owners.values()], np.int64)
    return {"known": known, "names": names, "phrases": table, "lengths": lengths,
            "owners": np.array([i for o in owners.values() for i in sorted(o)], np.int64),
            "first": np.cumsum(counts) - counts, "counts": counts}


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def search_shard(texts: list[bytes | None], table: dict, spans=None, items=None):
    """For each text: number of words, merged hit spans, names of items found. ``spans`` and
    ``items`` are what earlier passes found."""
    numbers = [ids_of(words(t), table["known"]) for t in texts]
    size = np.array([len(x) for x in numbers], np.int64)
    first = np.cumsum(size + 1) - (size + 1)
    sequence = np.zeros(int((size + 1).sum()), np.int64)
    for at, x in zip(first, numbers):
        sequence[at:at + len(x)] = x
    change = np.zeros(len(sequence) + 1, np.int64)
    owned = [set(x) for x in items] if items else [set() for _ in texts]
    for at, known in zip(first, spans or ()):
        for s in known:
            change[at + s["start"]] += 1
            change[at + s["end"]] -= 1
    if len(table["lengths"]):
        index = FMIndex(sequence, len(table["known"]) + 1, int(table["lengths"].min()))
        low, high = index.search(table["phrases"], table["lengths"])
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        at = index.locate(_ranges(low, count))
        change += np.bincount(at, minlength=len(change))
        change -= np.bincount(at + table["lengths"][phrase], minlength=len(change))
        doc = np.searchsorted(first, at, side="right") - 1
        pair = np.unique(doc * len(count) + phrase)
        doc, phrase = pair // max(1, len(count)), pair % max(1, len(count))
        own = np.repeat(doc, table["counts"][phrase])
        item = table["owners"][_ranges(table["first"][phrase], table["counts"][phrase])]
        for d, i in zip(own.tolist(), item.tolist()):
            owned[d].add(table["names"][i])
    hit = (np.cumsum(change[:-1]) > 0).view(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(first, start, side="right") - 1
    merged: list[list] = [[] for _ in texts]
    for d, s, e in zip(doc.tolist(), (start - first[doc]).tolist(), (end - first[doc]).tolist()):
        merged[d].append({"start": s, "end": e})
    return size.tolist(), merged, [sorted(x) for x in owned]


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_chars`` characters, split by a hash of the id."""
    named = benchmark.select(F.col("item_id").cast("string").alias("name"), utf8().alias("body")).dropna()
    total = named.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = 1 + total // block_chars
    for b in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        yield [(r.name, bytes(r.body)) for r in part.toLocalIterator()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = True,
                       window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``), then n_words, spans
    (merged [start, end) word spans covered by benchmark windows) and items (ids found).

    Null and empty texts have no words, no spans and no items; repeated rows are judged one
    by one; an empty benchmark or item matches nothing; items with a null id or text are
    passed over; own columns named like the new ones are replaced."""
    added = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    out = docs.drop("n_words", "spans", "items")
    plain = [c for c in out.columns if c != text or keep_text]
    body = free_name(out, "_body")
    out = out.select(*[F.col(f"`{c}`") for c in plain], utf8(text).alias(body))
    context, rest = docs.sparkSession.sparkContext, len(plain)
    for number, block in enumerate(benchmark_blocks(benchmark, block_chars)):
        shared = context.broadcast(phrase_table(block, window))

        def search(batches, shared=shared, again=number > 0):
            for batch in batches:
                size = np.asarray(pa.compute.binary_length(batch.column(body)).fill_null(0))
                # a word takes two bytes at least, with what parts it from the next
                shard = (np.cumsum(size) // (2 * shard_words)).tolist()
                begin = [i for i, s in enumerate(shard) if not i or s != shard[i - 1]]
                for a, b in zip(begin, [*begin[1:], len(shard)]):
                    part = batch.slice(a, b - a)
                    earlier = [part.column(c).to_pylist() for c in ("spans", "items")] if again else ()
                    n, spans, items = search_shard(part.column(body).to_pylist(), shared.value, *earlier)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:rest + 1], pa.array(n, pa.int64()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array(items, pa.list_(pa.string()))],
                        [*part.schema.names[:rest + 1], "n_words", "spans", "items"])

        head = out.select(*[F.col(f"`{c}`") for c in [*plain, body]])
        out = out.mapInArrow(search, with_fields(head, added))
    return out.drop(body)


def hit_words(spans: str = "spans"):
    """Number of words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit):
    """Some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, own ones named like
    those of ``find_contamination`` included."""
    moved, own = set_aside(docs, "n_words", "spans", "items")
    return find_contamination(moved, benchmark).filter(~contaminated(hit_words())).select(*own)
