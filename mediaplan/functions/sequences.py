"""Ordered work on long series without putting a whole series into one task.

A video, a track or a project can hold a large part of all rows, so no window
here is partitioned by that key alone over detail rows. These forms cover every
ordered rule:

* ``with_halo``: for rules that look a fixed number of rows back or ahead. Rows
  carry a dense index; blocks of the index are the partitions, and the few rows a
  neighbouring block needs are copied into it.
* ``number_ranged``: for the place of a row among all of its key, when many rows of a key may tie.
* ``running``: for rules that depend on everything before. Each chunk runs on its
  own; one summary row per chunk is carried forward and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import keep
from .blocks import map_blocks
from .expr import col
from .skew import by_merge

BLOCK_ROWS = 8192
#: Rows of one key that are sorted in one task.
MANY_ROWS = 100_000


def chunk_of(at, width: float) -> Column:
    """Chunk number of a position; grows with the position."""
    return F.floor(col(at) / F.lit(float(width))).cast("long")


def with_halo(df: DataFrame, index: str, before: int = 0, after: int = 0,
              size: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks of ``size`` indexes, copying ``before`` rows ahead of a
    block and ``after`` rows behind it. Use with ``halo_window`` and ``core_rows``."""
    first = F.floor((F.col(index) - F.lit(after)) / F.lit(size)).cast("long")
    last = F.floor((F.col(index) + F.lit(before)) / F.lit(size)).cast("long")
    own = F.floor(F.col(index) / F.lit(size)).cast("long")
    return (df.withColumn("_block", F.explode(F.sequence(first, last)))
            .withColumn("_core", F.col("_block") == own))


def halo_window(key: Sequence[str], index: str):
    return Window.partitionBy(*key, "_block").orderBy(index)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_block", "_core")


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, ahead: Column, local: Column) -> Column:
    if kind == "sum":
        zero = F.lit(0)
        return F.coalesce(ahead, zero) + F.coalesce(local, zero)
    return F.greatest(ahead, local) if kind == "max" else F.least(ahead, local)


def running(df: DataFrame, key: Sequence[str], chunk: Column | None, order: Sequence,
            specs: dict[str, tuple[str, Column, bool]], keep_chunk: bool = False) -> DataFrame:
    """Running sum/max/min per key in ``order``.

    ``specs`` maps an output column to (kind, value, inclusive). ``chunk`` must not
    decrease along ``order``. The chunk totals come from a pruned second read with
    partial aggregation, so only the local pass shuffles the rows. A second pass over
    the same chunks (``keep_chunk`` first, then ``chunk=None``) keeps that placement."""
    cols = [*key, "_chunk"]
    d = df if chunk is None else df.withColumn("_chunk", chunk)
    upto = Window.partitionBy(*cols).orderBy(*order)
    totals = d.groupBy(*cols).agg(
        *[_FOLD[k](v).alias(f"_t_{n}") for n, (k, v, _) in specs.items()])
    earlier = (Window.partitionBy(*key).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*cols, *[
        _FOLD[k](F.col(f"_t_{n}")).over(earlier).alias(f"_a_{n}")
        for n, (k, _, _) in specs.items()])
    for n, (k, v, inclusive) in specs.items():
        frame = upto.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        d = d.withColumn(f"_l_{n}", _FOLD[k](v).over(frame))
    d = d.join(by_merge(carry), cols)
    for n, (k, _, _) in specs.items():
        d = d.withColumn(n, _combine(k, F.col(f"_a_{n}"), F.col(f"_l_{n}")))
    d = d.drop(*[f"_{p}_{n}" for n in specs for p in "al"])
    return d if keep_chunk else d.drop("_chunk")


def number_rows(df: DataFrame, key: Sequence[str], chunk: Column, order: Sequence,
                name: str = "n") -> DataFrame:
    """Zero-based dense row index per key in ``order``."""
    out = running(df, key, chunk, order, {name: ("sum", F.lit(1), False)})
    return out.withColumn(name, F.col(name).cast("long"))


def number_ranged(df: DataFrame, key: Sequence[str], order: Sequence, name: str = "n", many: int = MANY_ROWS) -> DataFrame:
    """Zero-based dense row index per key in a total ``order``, however the rows of a key are spread over it.

    Rows are stored and keys counted. Keys of at most ``many`` rows are numbered where they meet; the others, one for
    ``many`` rows at most, by ranges (``_in_ranges``), so that no task holds a whole large key."""
    stored = keep(df, "unnumbered")
    large = keep(stored.groupBy(*key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > many).select(*key), "keys")
    place = (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long")
    if large.isEmpty():
        return stored.withColumn(name, place)
    of = lambda how: stored.join(F.broadcast(large), [stored[k].eqNullSafe(large[k]) for k in key], how)
    return of("left_anti").withColumn(name, place).unionByName(_in_ranges(of("left_semi"), key, order, name))


def _in_ranges(df: DataFrame, key: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``number_ranged`` for keys of any size.

    Rows go to tasks by sampled ranges of (key, order): a key, or one value of the order, that holds a large part
    of all rows takes as many tasks as it needs. A task counts within its range; what a key had in the ranges before
    is one number a range, which only the first key of a range needs."""
    # the place in a range is counted while it is written, so no later step can see other ranges
    ranged = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumns(
        {"_range": F.spark_partition_id().cast("long"), "_local": F.lit(0).cast("long")})
    at = ranged.columns.index("_local")

    def count(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in key]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                same = pa.compute.equal(k[1:], k[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                none = np.asarray(k.is_null())
                new[1:] |= ~(same | (none[1:] & none[:-1]))
            new[0] = last is None or [k[0].as_py() for k in keys] != last
            place = np.arange(batch.num_rows)
            since = np.maximum.accumulate(np.where(new, place, -1))
            local = np.where(since < 0, place + seen, place - since)
            last, seen = [k[-1].as_py() for k in keys], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(local), *batch.columns[at + 1:]], batch.schema.names)

    stored = keep(ranged.mapInArrow(count, ranged.schema), "numbered")
    own = F.struct(*key)
    ends = stored.groupBy("_range").agg(F.min_by(own, F.struct(*key, "_local")).alias("first"), F.max_by(
        F.struct(own.alias("key"), F.col("_local").alias("at")), F.struct(*key, "_local")).alias("last")).collect()  # a row a range
    carried, rows, before = 0, [], None
    for e in sorted(ends, key=lambda e: e["_range"]):
        carried = carried if before is not None and before == e["first"] else 0
        if carried:
            rows.append((e["_range"], *e["first"], carried))
        carried = e["last"]["at"] + 1 + (carried if e["first"] == e["last"]["key"] else 0)
        before = e["last"]["key"]
    kinds = ", ".join(f"`{k}` {stored.schema[k].dataType.simpleString()}" for k in key)
    ahead = df.sparkSession.createDataFrame(rows, f"_range long, {kinds}, _carried long")
    same = [stored["_range"] == ahead["_range"], *(stored[k].eqNullSafe(ahead[k]) for k in key)]
    out = stored.join(F.broadcast(ahead), same, "left").select(stored["*"], ahead["_carried"])
    return out.withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0).cast("long"))).drop("_range", "_local", "_carried")


def previous_row(df: DataFrame, key: Sequence[str], chunk: Column, order: Sequence,
                 values: dict[str, Column]) -> DataFrame:
    """Values of the row before, for series that have no dense index."""
    cols = [*key, "_chunk"]
    d = df.withColumn("_chunk", chunk)
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    pos = F.struct(*[col(o) for o in order])
    tails = d.groupBy(*cols).agg(F.max_by(row, pos).alias("_tail"))
    carry = tails.select(*cols, F.lag("_tail").over(
        Window.partitionBy(*key).orderBy("_chunk")).alias("_carried"))
    local = F.lag(row).over(Window.partitionBy(*cols).orderBy(*order))
    d = d.withColumn("_prev", local).join(by_merge(carry), cols)
    d = d.withColumn("_prev", F.coalesce("_prev", "_carried"))
    for n in values:
        d = d.withColumn(n, F.col("_prev")[n])
    return d.drop("_chunk", "_prev", "_carried")


def runs(df: DataFrame, key: Sequence[str], at: str, holds: Column, chunk: Column,
         order: Sequence) -> DataFrame:
    """Maximal runs of consecutive rows where ``holds``. A run ends at the position of
    the first row where it fails, or at the last row if none does.

    Output: key, run_start, run_end, run_rows, closed."""
    d = df.withColumn("_h", F.coalesce(holds, F.lit(False)))
    d = running(d, key, chunk, order,
                {"_fails": ("sum", F.when(F.col("_h"), 0).otherwise(1), True)})
    # a failing row closes the run before it, so no look-ahead is needed
    d = d.withColumn("_run", F.when(F.col("_h"), F.col("_fails"))
                     .otherwise(F.col("_fails") - 1))
    out = d.groupBy(*key, "_run").agg(
        F.min(F.when(F.col("_h"), F.col(at))).alias("run_start"),
        F.max(F.when(F.col("_h"), F.col(at))).alias("_last"),
        F.min(F.when(~F.col("_h"), F.col(at))).alias("_stop"),
        F.count(F.when(F.col("_h"), 1)).alias("run_rows"))
    return (out.filter(F.col("run_start").isNotNull())
            .select(*key, "run_start", F.coalesce("_stop", "_last").alias("run_end"),
                    "run_rows", F.col("_stop").isNotNull().alias("closed")))


def spaced_points(points: DataFrame, key: Sequence[str], at: str, gap: float,
                  chunk_gaps: int = 512) -> DataFrame:
    """Keep points greedily in ascending order, each at least ``gap`` after the last kept.

    The rule is sequential, but a chunk only needs to know the last point kept before
    it. Whatever that was, the first point kept inside a chunk lies within one ``gap``
    of the chunk's start (or is the first one after that), so each chunk is summarised
    as "first kept -> last kept" for those few entries. That makes every entry point to one of a later chunk;
    the entries that the first point leads to are found by doubling pointers, a round for twice the chunks, and every
    chunk is then thinned on its own. Points must be distinct."""
    width = float(gap) * chunk_gaps
    kinds = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in key)
    cells = points.select(*key, F.col(at).cast("double").alias("_at"), chunk_of(at, width).alias("_cell"))

    def summarise(rows, begins):
        found = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            p = rows.column("_at")[a:b].to_numpy()
            first = int(np.searchsorted(p, rows.column("_cell")[a].as_py() * width + gap, "left"))
            entry = p[:first + 1]
            last = np.arange(len(p))
            follow = np.searchsorted(p, p + gap, "left").tolist()
            for i in range(len(p) - 1, -1, -1):
                if follow[i] < len(p):
                    last[i] = last[follow[i]]
            found.append((a, p, entry, p[last[:len(entry)]]))
        if found:
            heads = rows.take(pa.array([f[0] for f in found]))
            yield pa.table([*(heads.column(c) for c in (*key, "_cell")), *(pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in (1, 2, 3))],
                           [*key, "_cell", "_pts", "_entry", "_exit"])

    lists = ", ".join(f"{c} array<double>" for c in ("_pts", "_entry", "_exit"))
    blocks = keep(map_blocks(cells, [*key, "_cell"], ["_at"], summarise, f"{kinds}, _cell long, {lists}"), "points")
    # what no entry of a chunk can follow passes it by: an entry without a point, before all of the next chunk
    ahead = previous_row(blocks, key, F.floor(F.col("_cell") / BLOCK_ROWS), ["_cell"], {"_from": F.col("_cell")})
    ahead = ahead.filter("_from IS NOT NULL").select(*key, F.col("_from").alias("_cell"), F.col("_cell").alias("_to"), F.col("_entry").alias("_next"))
    nothing = F.array(F.lit(float("inf")))
    nodes = blocks.select(*key, "_cell", F.explode(F.arrays_zip(F.concat("_entry", nothing).alias("e"), F.concat("_exit", F.array(F.lit(float("-inf")))).alias("x"))).alias("n"))
    links = nodes.join(ahead, [*key, "_cell"]).select(*key, "_cell", F.col("n.e").alias("_entry"), F.col("_to").alias("_to_cell"), F.coalesce(
        F.get(F.filter("_next", lambda p: p - F.col("n.x") >= gap), F.lit(0)), F.lit(float("inf"))).alias("_to_entry"))
    links = keep(links, "links")
    begin = blocks.groupBy(*key).agg(F.min(F.struct("_cell", F.get("_entry", F.lit(0)).alias("_entry"))).alias("s"))
    reached = keep(begin.select(*key, "s._cell", "s._entry"), "reached")
    node = [*key, "_cell", "_entry"]
    while not links.isEmpty():
        step = reached.join(links, node).select(*key, F.col("_to_cell").alias("_cell"), F.col("_to_entry").alias("_entry"))
        reached = keep(reached.unionByName(step), "reached")
        over = links.select(*key, F.col("_cell").alias("_to_cell"), F.col("_entry").alias("_to_entry"), F.col("_to_cell").alias("_c"), F.col("_to_entry").alias("_e"))
        links = keep(links.join(over, [*key, "_to_cell", "_to_entry"]).select(*node, F.col("_c").alias("_to_cell"), F.col("_e").alias("_to_entry")), "links")

    def thin(batches):
        for batch in batches:
            rows, kept = [], []
            for i, (p, entry) in enumerate(zip(batch.column("_pts"), batch.column("_entry").to_pylist())):
                p = p.values.to_numpy()
                follow = np.searchsorted(p, p + gap, "left").tolist()
                at_ = int(np.searchsorted(p, entry, "left"))
                while at_ < len(p):
                    rows.append(i)
                    kept.append(p[at_])
                    at_ = follow[at_]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in key), pa.array(kept, pa.float64())], [*key, at])

    return blocks.drop("_entry", "_exit").join(reached, [*key, "_cell"]).mapInArrow(thin, f"{kinds}, `{at}` double")
