"""A corpus from documents to training sequences: language, near duplicates, repeated passages, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of docs as they came, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import common, langid, packing, shingles, suffixes

#: A document goes if no language of the corpus reaches this probability.
LEAST_SCORE = 0.4


def _named(df: DataFrame, docs: DataFrame, changed: dict | None = None) -> DataFrame:
    """The columns c0, c1, ... under the names of docs again."""
    changed = changed or {}
    return df.select(*[changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language the network tells with at least LEAST_SCORE.

    With nothing to learn from (no text with a language), only texts without a letter go.
    """
    network = langid.fit(docs)
    found = langid.predict(docs, network)
    text = F.col(f"c{docs.columns.index('text')}")
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)) if network else found.where(text.rlike(r"\p{L}"))
    return _named(kept, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: SimHash candidates with a Jaccard of five-word shingles of 0.8 or more.

    It is the row with the smallest doc_id, of these the one with the least hash of the text; a null doc_id comes after
    all others. Of rows equal in doc_id and text any one stays. Rows, not doc_ids, go: other texts of a doc_id stay.
    """
    found = common.keep(shingles.near_duplicates(docs))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "of_text")
    rows = found.groupBy("component", "doc_id", "of_text").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    judged = rows.join(best, "component").select("doc_id", "of_text", "n", (order == F.col("best")).alias("stays"))
    judged = common.keep(judged.where("not stays or n > 1").select(F.col("doc_id").alias("of_doc"), "of_text", "stays"))
    own = common.numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    here = doc_id.cast("long").eqNullSafe(F.col("of_doc")) & (F.xxhash64(text) == F.col("of_text"))
    kept = own.join(common.sent_out(judged), here, "left_anti")
    repeated = own.join(common.sent_out(judged.where("stays")), here).groupBy("of_doc", "of_text").agg(F.min_by(F.struct(*own.columns), text).alias("row"))
    return _named(kept.unionByName(repeated.select("row.*")), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out each passage of 50 bytes or more that a document with a smaller doc_id has; n_chars follows.

    A character that loses a byte goes as a whole. A document of which nothing is left goes; empty ones stay.
    """
    done = suffixes.remove_repeats(docs).where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"c{docs.columns.index('text')}"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        old = F.col(f"c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return _named(done, docs, changed)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place, as packing.pack_documents gives them."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", sequences),
]

#: SQL can express none of the four; each is tested against a plain version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
