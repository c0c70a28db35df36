"""How much one question to a knowledge graph can stand in for: communities of files, their largest and their median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def community_corpus(files: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, communities, largest_files, largest_tokens, typical_tokens) of repositories whose files name communities.

    ``files``: one row a distinct file, with tokens; a file without tokens could not be read and counts for nothing.
    """
    per = files.where("tokens > 0 and community is not null").groupBy(*repo, "community").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    largest = F.max(F.struct("t", "n"))
    return per.groupBy(*repo).agg(F.count(F.lit(1)).alias("communities"), largest["n"].alias("largest_files"), largest["t"].alias("largest_tokens"), F.floor(F.median("t")).alias("typical_tokens"))


def repo_ceiling(files: DataFrame, repo: list[str]) -> DataFrame:
    """The largest community bounds the ceiling; without communities it is the whole corpus, and said to be unbounded."""
    whole = files.where("tokens > 0").groupBy(*repo).agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("corpus_tokens"))
    both = whole.join(community_corpus(files, repo), repo, "left")
    bounded = F.col("communities").isNotNull()
    pick = lambda c, other: F.when(bounded, F.col(c)).otherwise(F.col(other))
    return both.select(
        *repo, bounded.alias("bounded"), "files", "corpus_tokens", F.coalesce("communities", F.lit(0)).alias("communities"),
        pick("largest_files", "files").alias("ceiling_files"), pick("largest_tokens", "corpus_tokens").alias("ceiling_tokens"), pick("typical_tokens", "corpus_tokens").alias("typical_tokens"),
    )
