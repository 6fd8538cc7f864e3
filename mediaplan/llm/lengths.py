"""Token counts from an exact histogram of encoded lengths.

Documents are encoded whole and reduced to one row per length before anything moves.
Suffix sums over the lengths then answer, for every context limit, how many documents are longer, how many
tokens they hold, and what truncation leaves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaplan.functions.sequences import running
from mediaplan.sources.tables import keep

from .text import VOCABULARY, file_ids

CHUNK = 4096


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(tokens) for each row; null and empty texts have none."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in file_ids(batch.column("text").to_pylist(), vocabulary)], pa.int64())], ["tokens"])

    return docs.select("text").mapInArrow(count, "tokens long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per length that occurs: tokens, docs."""
    return token_counts(docs, vocabulary).groupBy("tokens").agg(F.count("*").alias("docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: docs and docs_tokens of that length, docs_upto and tokens_upto (at most
    L), docs_over and tokens_over (longer), truncated_tokens (left when texts are cut at L), and totals.

    Repeated lengths are summed; an empty histogram gives no rows."""
    one = keep(histogram.groupBy("tokens").agg(F.sum("docs").alias("docs")), "histogram")
    rows = one.withColumn("all", F.lit(0)).withColumn("docs_tokens", F.col("tokens") * F.col("docs"))
    sums = running(rows, ["all"], F.floor(-F.col("tokens") / F.lit(CHUNK)), [F.col("tokens").desc()],
                   {"docs_over": ("sum", F.col("docs"), False), "tokens_over": ("sum", F.col("docs_tokens"), False)})
    totals = one.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total_docs"),
                     F.coalesce(F.sum(F.col("tokens") * F.col("docs")), F.lit(0)).alias("total_tokens")).first()
    total, tokens = F.lit(totals["total_docs"]), F.lit(totals["total_tokens"])
    return sums.select("tokens", "docs", "docs_tokens", (total - F.col("docs_over")).alias("docs_upto"), (tokens - F.col("tokens_over")).alias("tokens_upto"),
                       "docs_over", "tokens_over", (tokens - F.col("tokens_over") + F.col("tokens") * F.col("docs_over")).alias("truncated_tokens"),
                       total.alias("total_docs"), tokens.alias("total_tokens"))


def truncated_at(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over and truncated_tokens for context limits that need not occur as lengths."""
    wanted = table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    sums = []
    for i, x in enumerate(limits):
        over = F.col("tokens") > x
        sums += [F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias(f"d{i}"),
                 F.coalesce(F.sum(F.least("tokens", F.lit(x)) * F.col("docs")), F.lit(0)).alias(f"t{i}")]
    row = table.agg(*sums).first()
    return wanted.sparkSession.createDataFrame([(int(x), row[f"d{i}"], row[f"t{i}"]) for i, x in enumerate(limits)],
                                               "limit long, docs_over long, truncated_tokens long")


def quantile(table: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    reached: Column = F.col("docs_upto") >= F.ceil(F.lit(share) * F.col("total_docs"))
    return table.filter(reached).agg(F.min("tokens").alias("q")).first()["q"]
