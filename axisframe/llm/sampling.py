"""Bounded samples of labelled rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels that may be met; more raise an error, as what is fitted grows with them.
LABELS = 64
_RANGE = 1 << 40


def ranked(rows: DataFrame, key_col: str, label_col: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, those whose keys hash lowest; Spark keeps no more of a label in any task before it shuffles."""
    order = Window.partitionBy(label_col).orderBy(F.pmod(F.xxhash64(key_col), F.lit(_RANGE)), key_col)
    return rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= per_label).drop("__at")


def bounded_rows(rows: DataFrame, id_col: str, label_col: str, per_label: int, labels: int | None = None) -> DataFrame:
    """``ranked``, after a bound on the hash that lets about twice as many rows of each label through.

    So the last ranking sees few rows of a label however many it has. More than ``labels`` labels (LABELS) raise an error.
    """
    labels = LABELS if labels is None else labels
    sizes = rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(labels + 1).collect()
    if len(sizes) > labels:
        raise ValueError(f"more than {labels} labels in column {label_col}")
    bound = F.lit(_RANGE)
    for row in sizes:
        share = min(1.0, (2 * per_label + 64) / row["n"])
        bound = F.when(F.col(label_col).eqNullSafe(F.lit(row[label_col])), F.lit(int(share * _RANGE))).otherwise(bound)
    return ranked(rows.where(F.pmod(F.xxhash64(id_col), F.lit(_RANGE)) < bound), id_col, label_col, per_label)


def stretch(text_col: str, id_col: str, chars: int):
    """A whole text of up to ``chars`` characters, else so many from a place that the id's hash gives."""
    over = F.char_length(text_col) - chars
    return F.when(over > 0, F.substring(F.col(text_col), (F.pmod(F.xxhash64(id_col), F.greatest(over, F.lit(1))) + 1).cast("int"), F.lit(chars))).otherwise(F.col(text_col))


def fold(id_col: str, parts: int):
    """crc32 of the id's decimal text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
