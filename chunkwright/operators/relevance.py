"""TF-IDF of terms in groups: term counts, group counts, and the score on every row of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_frequency(rows: DataFrame, group: str, term: str) -> DataFrame:
    return rows.groupBy(group, term).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(rows: DataFrame, group: str, term: str) -> DataFrame:
    """Groups in which each term occurs; distinct pairs are formed map-side first."""
    return rows.select(group, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def corpus_size(rows: DataFrame, group: str) -> DataFrame:
    return rows.select(group).distinct().agg(F.count(F.lit(1)).alias("n_docs"))


def tfidf(rows: DataFrame, group: str, term: str) -> DataFrame:
    """Per (group, term): tf, df, and tf * ln(N / (df + 1)); the score of a term found in all groups is negative.

    df comes from the term counts (one row per pair), so the rows are shuffled once; N is a one-row table.
    """
    tf = term_frequency(rows, group, term)
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    n = tf.select(group).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    score = F.col("tf") * F.log(F.col("n_docs").cast("double") / (F.col("df") + 1))
    return tf.join(df, term).crossJoin(F.broadcast(n)).select(group, term, "tf", "df", score.alias("score"))  # n is one row


def tfidf_rows(rows: DataFrame, group: str, term: str) -> DataFrame:
    """Every row with its term's score in its group."""
    return rows.join(tfidf(rows, group, term), [group, term])


def term_count_on_rows(rows: DataFrame, group: str, term: str) -> DataFrame:
    """Every row with its term's count in its group, by a window in place of a join back."""
    return rows.withColumn("tf", F.count(F.lit(1)).over(Window.partitionBy(group, term)))
