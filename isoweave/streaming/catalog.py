"""The protein catalog's counts over a stream of records: the batch aggregation, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residue_counts(proteins: DataFrame) -> DataFrame:
    """species, gene, n_seqs, n_residues of a batch or a stream (in complete or update mode)."""
    return proteins.groupBy("species", "gene").agg(F.count("*").alias("n_seqs"), F.sum(F.length("residues")).alias("n_residues"))
