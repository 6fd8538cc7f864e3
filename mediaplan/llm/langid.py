"""Language identification with segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. The
probability of a text sums over all ways to segment it; pieces do not cross words, so it is the
product over words, and a forward pass over a word's characters sums its segmentations, however long the word.
Characters that no piece covers have the same small probability in every language.

Training is expectation maximisation on word counts of a sample (about ``SAMPLE_DOCS``
documents a language, whole texts): tasks run forward and backward passes over distinct words and
sum expected piece counts; the driver holds the piece table (vocabulary x languages) only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F

from mediaplan.sources.tables import keep

from .text import set_aside, with_fields

PIECES = "piece_bpe_32k"
SAMPLE_DOCS = 3000
ROUNDS = 3
FLOOR = 1e-7
#: Where all probabilities of a word's beginning are below this, they are carried on as multiples of it.
TINY = 1e-100
#: What a task holds at a time: bytes of text, characters of words in one forward pass, words with known scores.
PART_BYTES, STEP_CHARS, KNOWN_WORDS = 4_000_000, 320_000, 400_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
START = "▁"
TABLE_CLASSES = 128


def vocabulary_pieces(name: str = PIECES) -> list[str]:
    """Lower-cased pieces of letters, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return sorted({p.lower() for p in found if p.lstrip(START).isalpha()})


class PieceTrie:
    """States for prefixes of pieces; state 0 is dead, state 1 the root, and each names the piece
    that ends there (0: none). Steps on the characters with most steps are in one table (state, class);
    steps on the many characters of large scripts are in a sorted list."""

    def __init__(self, pieces: list[str]):
        uses = Counter(c for p in pieces for c in p)
        self.longest = max(map(len, pieces), default=1)
        self.classes = {c: i + 1 for i, c in enumerate(sorted(uses, key=lambda c: (-uses[c], c)))}
        steps, ends = [{}, {}], [0, 0]
        for number, piece in enumerate(pieces, 1):
            at = 1
            for c in piece:
                at = steps[at].setdefault(self.classes[c], len(steps))
                if at == len(steps):
                    steps.append({})
                    ends.append(0)
            ends[at] = number
        self.width, self.ends = len(self.classes) + 1, np.array(ends, np.int32)
        pairs = sorted((s * self.width + c, to) for s, own in enumerate(steps) for c, to in own.items())
        self.keys, self.goals = np.array([k for k, _ in pairs], np.int64), np.array([g for _, g in pairs], np.int32)
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self._table is None:
            common = self.keys % self.width < TABLE_CLASSES
            self._table = np.zeros((len(self.ends), TABLE_CLASSES), np.int32)
            self._table[self.keys[common] // self.width, self.keys[common] % self.width] = self.goals[common]
        rare = code >= TABLE_CLASSES
        if not rare.any():
            return self._table[state, code].astype(np.int64)
        out = self._table[state, np.where(rare, 0, code)].astype(np.int64)
        key = state[rare] * self.width + code[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[rare] = np.where(self.keys[at] == key, self.goals[at], 0)
        return out

    def codes(self, words: list[str], length: int) -> np.ndarray:
        """Character classes of words of one length; shorter ones are filled up with what no piece holds."""
        points = np.frombuffer("".join(w.ljust(length, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
        distinct, inverse = np.unique(points, return_inverse=True)
        mapped = np.array([self.classes.get(chr(p), 0) for p in distinct], np.int64)
        return mapped[inverse.reshape(points.shape)]

    def edges(self, codes: np.ndarray):
        """(begin, end, words, pieces) of all pieces found in words of one length."""
        n, length = codes.shape
        if n * 16 < length:  # a few long words: all places take each step together
            yield from self._long_edges(codes)
            return
        for begin in range(length):
            rows, state = np.arange(n), np.ones(n, np.int64)
            for end in range(begin, min(length, begin + self.longest)):
                state = self.step(state, codes[rows, end])
                alive = state > 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = self.ends[state]
                done = piece > 0
                if done.any():
                    yield begin, end + 1, rows[done], piece[done]

    def _long_edges(self, codes: np.ndarray):
        n, length = codes.shape
        row, begin = (x.ravel() for x in np.indices((n, length)))
        state, found = np.ones(n * length, np.int64), []
        for size in range(1, self.longest + 1):
            inside = begin + size <= length
            row, begin, state = row[inside], begin[inside], state[inside]
            state = self.step(state, codes[row, begin + size - 1])
            alive = state > 0
            row, begin, state = row[alive], begin[alive], state[alive]
            piece = self.ends[state]
            done = piece > 0
            found.append((begin[done], begin[done] + size, row[done], piece[done]))
        begin, end, row, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([row, end, begin])
        begin, end, row, piece = begin[order], end[order], row[order], piece[order]
        turns = np.flatnonzero(np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))) if len(begin) else []
        for i, j in zip(turns, [*turns[1:], len(begin)]):
            yield int(begin[i]), int(end[i]), row[i:j], piece[i:j]


def forward(trie: PieceTrie, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[k], and the logarithm to add to its own: probability of the first k characters, a row a
    word and a column a language."""
    n, length = codes.shape
    alpha, scale = np.zeros((length + 1, n, table.shape[1])), np.zeros((length + 1, n))
    alpha[0] = 1.0
    reached = 0

    def reach(place):
        nonlocal reached
        while reached < place:  # every piece that ends there is in
            reached += 1
            alpha[reached] += alpha[reached - 1] * FLOOR
            scale[reached] = scale[reached - 1]
            small = alpha[reached].max(axis=1) < TINY
            if small.any():  # all that is still added to goes by the same scale
                alpha[reached:reached + trie.longest + 1, small] /= TINY
                scale[reached, small] += np.log(TINY)

    for begin, end, rows, piece in trie.edges(codes):
        reach(begin)
        alpha[end, rows] += alpha[begin, rows] * table[piece]
    reach(length)
    return alpha, scale


def expected_counts(trie: PieceTrie, codes: np.ndarray, table: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Expected uses of each piece in each language, words (``sizes`` long, if they are filled up) weighted by ``counts``."""
    alpha, ahead = forward(trie, codes, table)
    n, length = codes.shape
    if n * 16 < length:
        total = np.zeros_like(table)
        for i in range(n):
            size = length if sizes is None else int(sizes[i])
            _count_long(trie, codes[i:i + 1, :size], table, counts[i], alpha[:, i], ahead[:, i], total)
        return total
    last = np.full(n, length) if sizes is None else sizes, np.arange(n)
    by_begin: dict[int, list] = {}
    for edge in trie.edges(codes):
        by_begin.setdefault(edge[0], []).append(edge)
    beta, behind = np.zeros_like(alpha), np.zeros_like(ahead)
    beta[last] = 1.0
    total = np.zeros_like(table)
    weight, whole = counts / np.maximum(alpha[last], 1e-300), ahead[last]
    for begin in range(length - 1, -1, -1):
        beta[begin] += beta[begin + 1] * FLOOR
        behind[begin] = behind[begin + 1]
        for _, end, rows, piece in by_begin.get(begin, ()):
            # what lies further on may have been scaled less often
            through = table[piece] * beta[end, rows] * np.exp(behind[end, rows] - behind[begin, rows])[:, None]
            beta[begin, rows] += through
            share = alpha[begin, rows] * through * weight[rows] * np.exp(ahead[begin, rows] + behind[begin, rows] - whole[rows])[:, None]
            if len(piece) < len(total) // 16:  # few words, as long ones are
                np.add.at(total, piece, share)
            else:
                for lang in range(table.shape[1]):
                    total[:, lang] += np.bincount(piece, share[:, lang], len(total))
        small = (beta[begin].max(axis=1) < TINY) & (begin <= last[0])
        if small.any():
            beta[begin, small] /= TINY
            behind[begin, small] += np.log(TINY)
    return total


def _count_long(trie: PieceTrie, codes: np.ndarray, table: np.ndarray, count: np.ndarray, alpha: np.ndarray, ahead: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses of one long word: the pieces of a place are summed together, and all shares at the end."""
    size = codes.shape[1]
    edges = [(b, e, p[0]) for b, e, _, p in trie.edges(codes)]
    begin, end, piece = (np.array(x, np.int64) for x in zip(*edges)) if edges else [np.zeros(0, np.int64)] * 3
    first = np.searchsorted(begin, np.arange(size + 1)).tolist()
    chance = table[piece]
    beta, behind = np.zeros((size + 1, table.shape[1])), np.zeros(size + 1)
    beta[size] = 1.0
    for b in range(size - 1, -1, -1):
        i, j = first[b], first[b + 1]
        value, scale = beta[b + 1] * FLOOR, behind[b + 1]
        if j > i:
            to = end[i:j]
            value = value + (chance[i:j] * beta[to] * np.exp(behind[to] - scale)[:, None]).sum(axis=0)
        if value.max() < TINY:
            value, scale = value / TINY, scale + np.log(TINY)
        beta[b], behind[b] = value, scale
    weight = count / np.maximum(alpha[size], 1e-300)
    share = alpha[begin] * chance * beta[end] * np.exp(ahead[begin] + behind[end] - ahead[size])[:, None] * weight
    np.add.at(total, piece, share)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """Places of words that are scored together: those of one length, from 40 on of lengths up to a quarter apart."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        size = 40
        while len(w) > size:
            size += size // 4
        groups.setdefault(len(w) if len(w) <= 40 else size, []).append(i)
    return groups


class Model:
    def __init__(self, languages: list[str], trie: PieceTrie, table: np.ndarray):
        self.languages, self.trie, self.table = languages, trie, table

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.languages)))
        marked = [START + w for w in words]
        for length, at in _by_length(marked).items():
            step = max(1, STEP_CHARS // length)
            for i in range(0, len(at), step):
                own = at[i:i + step]
                alpha, scale = forward(self.trie, self.trie.codes([marked[k] for k in own], length), self.table)
                last = np.array([len(marked[k]) for k in own]), np.arange(len(own))
                out[own] = np.log(np.maximum(alpha[last], 1e-300)) + scale[last][:, None]
        return out


def letters(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def parts_of(batch: pa.RecordBatch, column: int):
    """The batch in parts of about PART_BYTES of text, at least a row each."""
    size = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
    part = (np.cumsum(size) // PART_BYTES).tolist()
    begin = [i for i, p in enumerate(part) if not i or p != part[i - 1]]
    for a, b in zip(begin, [*begin[1:], len(part)]):
        yield batch.slice(a, b - a)


def _word_counts(rows: DataFrame) -> DataFrame:
    def count(batches):
        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            per: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                per.setdefault(lang, Counter()).update(START + w for w in letters(text))
            for lang, words in per.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())],
                    ["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, pieces: str = PIECES) -> Model | None:
    """Fit piece probabilities on labelled rows (text, lang); rows without either are passed over.
    About ``sample_docs`` documents of every language are drawn by a hash of doc_id. None if no
    row is labelled."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample_docs / counts[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = keep(_word_counts(labelled.filter(draw < share)), "word-counts")
    trie = PieceTrie(vocabulary_pieces(pieces))
    size = int(trie.ends.max()) + 1
    table = np.full((size, len(languages)), 1.0 / size)
    column = {lang: i for i, lang in enumerate(languages)}
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((trie, table))

        def expect(frames, shared=shared):
            trie, table = shared.value
            total = np.zeros_like(table)
            for pdf in frames:
                found, weights = pdf["word"].tolist(), pdf["n"].to_numpy(float)
                lang = pdf["lang"].map(column).to_numpy()
                for length, at in _by_length(found).items():
                    step = max(1, STEP_CHARS // length)
                    for i in range(0, len(at), step):
                        own = np.array(at[i:i + step])
                        weight = np.zeros((len(own), table.shape[1]))
                        weight[np.arange(len(own)), lang[own]] = weights[own]
                        total += expected_counts(trie, trie.codes([found[k] for k in own], length), table, weight, np.array([len(found[k]) for k in own]))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        uses = np.full(table.shape, 0.05)  # a piece not seen keeps a little
        for r in sums.collect():
            uses[r["piece"], r["lang"]] += r["n"]
        uses[0] = 0
        table = uses / uses.sum(axis=0)
    return Model(languages, trie, table)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then lang_pred and score (the posterior of the language under equal
    priors, 0 to 1).

    ``und`` with score 0 for null texts and texts without a letter, and for all if there is no
    model. Ties go to the first language in order. Repeated rows are judged one by one; own
    columns with the new names are replaced."""
    out = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = out.columns.index(text)

    def judge(batches):
        model, place = shared.value, {}
        scores = np.zeros((KNOWN_WORDS, len(model.languages) if model else 0))
        for whole in batches:
            for batch in parts_of(whole, at):
                found, best, sure = [Counter(letters(t)) for t in batch.column(at).to_pylist()], [], []
                if model:  # words not scored before are scored together
                    new = [w for w in dict.fromkeys(w for words in found for w in words) if w not in place]
                    if len(place) + len(new) > KNOWN_WORDS:
                        place = {}
                        new = list(dict.fromkeys(w for words in found for w in words))
                        scores = scores if len(new) <= len(scores) else np.zeros((len(new), len(model.languages)))
                    if new:
                        scores[len(place):len(place) + len(new)] = model.word_scores(new)
                        place.update(zip(new, range(len(place), len(place) + len(new))))
                for words in found:
                    if not words or not model:
                        best.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    rows = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    total = np.fromiter(words.values(), float, len(words)) @ scores[rows]
                    posterior = np.exp(total - total.max())
                    k = int(total.argmax())
                    best.append(model.languages[k])
                    sure.append(float(posterior[k] / posterior.sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())],
                                                 [*batch.schema.names, "lang_pred", "score"])

    return out.mapInArrow(judge, with_fields(out, "lang_pred string, score double"))


def held_out():
    """Rows that a model is judged on and never learns from: a quarter by a checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def drop_unidentified(docs: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language, one of ``wanted`` if some are named, with all their columns, own
    ones named like those of ``predict`` included.

    Without ``wanted``, what goes are null texts and texts without a letter. Where no row is labelled there is no
    model, and no text with a letter goes, whatever is wanted. Repeated rows stay or go alike."""
    model = train(docs.filter(~held_out()))
    if model is None:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    moved, own = set_aside(docs, "lang_pred", "score")
    judged = predict(moved, model)
    stays = F.col("lang_pred") != UNKNOWN if wanted is None else F.col("lang_pred").isin(list(wanted))
    return judged.filter(stays).select(*own)
