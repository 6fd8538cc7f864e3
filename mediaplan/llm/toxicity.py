"""Toxicity by class-conditional Kneser-Ney models of characters.

Toxic and ordinary labelled rows each give n-gram counts over a small fixed alphabet (letters, one
symbol for digits, four for bytes beyond ASCII, one for everything between words), so a table has
``1 << BITS * ORDER`` cells at most, however large the corpus is. The highest order takes counts,
lower orders take continuation counts (distinct symbols seen to the left). How much mass
a context hands down comes from the counts of both classes together, and so does the lowest
order: an n-gram that is rare or new gets the same share from the same counts in both classes.

A text's evidence is the difference of its two log-likelihoods by length. ``FOLDS``
models that leave a fold of labelled rows out score that fold; a logistic curve fitted to those
scores turns evidence into a probability. All labelled rows are counted; the curve is
fitted to about ``CURVE_DOCS`` of them, drawn by a hash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaplan.sources.tables import keep

from .text import free_name, with_fields

ORDER, BITS, FOLDS = 4, 5, 5
SYMBOLS, CELLS = 1 << BITS, 1 << BITS * ORDER
CURVE_DOCS = 40_000
#: Bytes of a text that are looked up at a time.
STEP = 1 << 20
BOUND = 0.7
_LETTERS = bytes(b if 97 <= b < 123 else 48 if 48 <= b < 58 else b if b >= 128 else 32 for b in range(256))
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 4
_CODE[48] = 31


def ngrams(text: bytes | None):
    """Codes of all n-grams of a whole text, in arrays of at most ``STEP``. Runs of other characters
    count as one boundary; the text begins and ends with boundaries. No word, no n-gram."""
    found = text.lower().translate(_LETTERS).split() if text else []
    if not found:
        return
    line = b" " * (ORDER - 1) + b" ".join(found) + b" "
    for begin in range(0, len(line) - ORDER + 1, STEP):
        at = _CODE[np.frombuffer(line[begin:begin + STEP + ORDER - 1], np.uint8)]
        code = np.zeros(len(at) - ORDER + 1, np.uint32)
        for k in range(ORDER):
            code = code << BITS | at[k:k + len(code)]
        yield code


def count_ngrams(rows: DataFrame) -> DataFrame:
    """Counts (code, n0, n1, ...) over rows (text, label, fold): a column for each label and fold."""
    names = [f"n{i}" for i in range(2 * FOLDS)]

    def count(batches):
        total: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold"))):
                own = total.setdefault(label * FOLDS + fold, np.zeros(0, np.int32))
                for code in ngrams(text):
                    if not len(own):
                        own = total[label * FOLDS + fold] = np.zeros(CELLS, np.int32)
                    if len(code) * 64 < CELLS:
                        np.add.at(own, code, 1)
                    else:
                        own += np.bincount(code, minlength=CELLS).astype(np.int32)
                    held += len(code)
                    if held > 1 << 30:  # before a count can pass 32 bits
                        yield from counted(total)
                        total, held, own = {}, 0, np.zeros(0, np.int32)
        yield from counted(total)

    def counted(total):
        total = {k: own for k, own in total.items() if len(own)}
        seen = np.zeros(CELLS, bool)
        for own in total.values():
            seen |= own > 0
        seen = np.flatnonzero(seen)
        for i in range(0, len(seen), 1 << 15):
            part = seen[i:i + (1 << 15)]
            none = np.zeros(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[k][part].astype(np.int64) if k in total else none) for k in range(2 * FOLDS))],
                                             ["code", *names])

    parts = rows.select(F.col("text").cast("binary").alias("text"), "label", "fold").mapInArrow(
        count, ", ".join(f"{c} long" for c in ["code", *names]))
    return parts.groupBy("code").agg(*[F.sum(c).alias(c) for c in names])


def discount(counts: np.ndarray) -> float:
    """Absolute discount by the numbers of n-grams seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def continuations(counts: np.ndarray) -> np.ndarray:
    """For each n-gram without its first symbol, how many first symbols it has been seen with."""
    return (counts.reshape(SYMBOLS, -1) > 0).sum(axis=0).astype(float)


def log_probabilities(ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the last symbol of every n-gram after the others, in each class."""
    levels = [(ordinary.astype(float), toxic.astype(float), (ordinary + toxic).astype(float))]
    while len(levels) < ORDER:
        levels.append(tuple(continuations(c) for c in levels[-1]))
    shared = levels[-1][2] + 0.5
    known = [shared / shared.sum()] * 2
    for *classes, pooled in reversed(levels[:-1]):
        d, grid = discount(pooled), pooled.reshape(-1, SYMBOLS)
        handed = np.where(grid.any(axis=1), d * (grid > 0).sum(axis=1) / np.maximum(grid.sum(axis=1), 1), 1.0)[:, None]
        for k, own in enumerate(classes):
            left = np.maximum(own.reshape(-1, SYMBOLS) - d, 0)
            mass = left.sum(axis=1, keepdims=True)
            lower = np.tile(known[k].reshape(-1, SYMBOLS), (SYMBOLS if known[k].size > SYMBOLS else len(left), 1))
            known[k] = np.where(mass > 0, (1 - handed) * left / np.where(mass > 0, mass, 1) + handed * lower, lower).ravel()
    return np.log(known[0]), np.log(known[1])


def evidence_table(counts: np.ndarray, leave_out: int | None = None) -> np.ndarray:
    """Toxic less ordinary log probability of every n-gram, with a fold's rows left out if one is named."""
    folds = [f for f in range(FOLDS) if f != leave_out]
    ordinary, toxic = log_probabilities(counts[folds].sum(axis=0), counts[[FOLDS + f for f in folds]].sum(axis=0))
    return (toxic - ordinary).astype(np.float32)


def evidence(text: bytes | None, table: np.ndarray) -> tuple[float, int]:
    """Sum of the table over a text's n-grams, and their number."""
    total, size = 0.0, 0
    for code in ngrams(text):
        total += float(table[code].sum(dtype=np.float64))
        size += len(code)
    return total, size


def features(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Evidence a symbol, the same against chance (which falls with the root of the length), and the length."""
    size = np.maximum(size, 1)
    return np.stack([total / size, total / np.sqrt(size), np.log(size)], axis=1)


@dataclass
class Curve:
    """A logistic curve over features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> Curve:
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
        pull = np.diag([ridge] * x.shape[1] + [1e-6])
        w = np.zeros(z.shape[1])
        loss = lambda w: float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + w @ pull @ w / 2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            move = np.linalg.solve((z.T * (p * (1 - p))) @ z + pull + 1e-9 * np.eye(len(w)), z.T @ (p - y) + pull @ w)
            step = 1.0
            while step > 1e-4 and loss(w - step * move) > loss(w):
                step /= 2
            w = w - step * move
            if np.abs(step * move).max() < 1e-9:
                break
        return cls(mean, spread, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1], -30, 30)))


@dataclass
class Model:
    """``table`` and ``curve`` are None where one class has no labelled text; all texts then get ``share``."""

    share: float
    table: np.ndarray | None = None
    curve: Curve | None = None

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        found = np.array([evidence(t, self.table) for t in texts], float).reshape(-1, 2)
        return np.where(found[:, 1] > 0, self.curve(features(found[:, 0], found[:, 1])), self.share)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label, fold) of the rows of ``docs`` that have a text and a label. A document with several
    labels is toxic if one of them says so; null labels and ids are passed over."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")))
    # texts move to their labels once, at every size of either table, and are read again from where they are stored
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").hint("merge").join(known, "doc_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, curve_docs: int = CURVE_DOCS) -> Model:
    """Fits a model to the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks. Repeated rows
    count as often as they are there."""
    rows = keep(labelled_rows(docs, labels), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(share)
    found = count_ngrams(rows).toArrow()  # one row a cell at most
    counts = np.zeros((2 * FOLDS, CELLS), np.int64)
    code = found.column("code").to_numpy()
    for i in range(2 * FOLDS):
        counts[i, code] = found.column(f"n{i}").to_numpy()
    tables = docs.sparkSession.sparkContext.broadcast(np.stack([evidence_table(counts, f) for f in range(FOLDS)]))
    draw = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, curve_docs / total) * (1 << 20)))

    def judge(batches):
        for batch in batches:
            own = [evidence(t, tables.value[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in own], pa.float64()), pa.array([n for _, n in own], pa.int64()),
                                              batch.column("label")], ["total", "size", "label"])

    drawn = rows.filter(draw).select(F.col("text").cast("binary").alias("text"), "label", "fold").mapInArrow(
        judge, "total double, size long, label int").filter("size > 0").toArrow()
    x, y = features(drawn.column("total").to_numpy(), drawn.column("size").to_numpy()), drawn.column("label").to_numpy()
    order = np.lexsort([*x.T, y])  # the same sums whatever order rows come in
    if len(set(y.tolist())) < 2:
        return Model(share)
    return Model(share, evidence_table(counts), Curve.fit(x[order], y[order].astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then score (0 to 1) and predicted (1 from ``BOUND`` on, else 0).

    Null texts and texts without a word get the share of toxic rows among those trained on; without rows
    of both classes all texts do (0 without any). Repeated rows are judged one by one; own
    columns with the new names are replaced; an empty table gives no rows."""
    out = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body = free_name(out, "_bytes")
    given = out.withColumn(body, F.col(f"`{text}`").cast("binary"))

    def judge(batches):
        for batch in batches:
            found = shared.value.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= BOUND).astype(np.int32))],
                                             [*batch.schema.names[:-1], "score", "predicted"])

    return given.mapInArrow(judge, with_fields(out, "score double, predicted int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that a model is judged on and never learns from: a third by a checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
