"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

language -> lines -> near copies -> packing.  Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from preciario.llm import jaccard_join, language, line_dedup, packing, queries
from preciario.llm.shared import discard, table, written

#: Texts without letters and texts whose likeliest language has less than this probability are rejected.
LEAST_SCORE = 0.3
#: Near copies: hundredths of shared shingles, and words of a shingle.  Five words and 80 give right results as well (tests),
#: but the join's candidates outgrow the check tool's disk; see the README.
COPY_SHARE, COPY_WORDS = 90, 3


def known_language(spark, docs, sf_dir):
    """Language ID (operator 9): documents without a recognisable language go."""
    found = language.identify(docs, language.train(docs), keep=tuple(docs.columns), names=("__lang", "__score"))
    return found.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(docs.columns)


def without_boilerplate(spark, docs, sf_dir):
    """Line dedup (operator 7): lines that many sites share are taken out of the texts; every document stays."""
    cleaned = line_dedup.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """N-gram Jaccard join (operator 4) on three words from 0.9 on: of each component the document of the smallest doc_id stays."""
    return jaccard_join.representatives(docs, COPY_SHARE, COPY_WORDS).select(docs.columns)


def packed(spark, docs, sf_dir):
    """Packing (operator 8) of all documents that are left."""
    return packing.pack(docs, queries.RANKS_50K, queries.SPECIAL_50K)


STAGES = [("language", known_language), ("lines", without_boilerplate), ("near copies", one_of_each_group), ("packing", packed)]

#: Language, components and packing can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
