"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

1. toxicity: documents that the network scores at or above its threshold go.
2. SimHash near-duplicates: of every group of linked documents the one with the lowest id stays.
3. benchmark decontamination: documents that hold a passage of the benchmark go; an item of fewer than
   ``decontam.MIN_CHARS`` characters, such as a single word, is no passage.
4. secrets: reported spans are replaced in the text, and ``n_chars`` follows; every document stays.
5. packing: one row per piece with its place in a sequence.

Rows with null ids or texts pass like others (a null text is an empty one), repeated rows are copies of one
group, further columns of documents are handed through whatever their names, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylens.llm import decontam, packing, secret_scan, simhash, toxicity
from storylens.llm.common import prepare, store, table

#: Toxicity and near-duplicates can't be said in SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def _folded(docs: DataFrame, *own: str) -> DataFrame:
    """``doc_id``, ``text``, the columns ``own``, and all others in a struct that clashes with no operator."""
    named = {"doc_id", "text", *own}
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in named]
    return docs.select(*(c for c in docs.columns if c in named), F.struct(F.lit(0).alias("z"), *others).alias("_rest"))


def _unfolded(folded: DataFrame, like: DataFrame, *own: str) -> DataFrame:
    named = {"doc_id", "text", *own}
    return folded.select(
        *(F.col(c) if c in named else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(like.columns))
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_folded(docs).withColumn("_text", F.col("text")), model)
    kept = scored.filter("predicted = 0").withColumnRenamed("_text", "text")
    return _unfolded(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    marked = simhash.with_fingerprint(_folded(docs).withColumn("_text", F.col("text")))
    marked = marked.withColumnRenamed("_text", "text").withColumn("_row", F.monotonically_increasing_id())
    marked = store(marked, "pipeline-marked")
    grouped = simhash.components(marked.select("doc_id", "fp"))
    # One row of each group: the lowest id, then the lowest fingerprint; of equal rows any one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("first")
    lowest = grouped.groupBy("component_id", "group").agg(first)
    chosen = lowest.select(F.col("first.doc_id").alias("_id"), F.col("first.fp").alias("_fp"))
    # Of the rows of a chosen id and fingerprint (repeated rows, however many) the one of the lowest row number stays.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    firsts = marked.groupBy(key.alias("_key")).agg(F.min("_row").alias("_row"))
    chosen = chosen.select(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("doc_id"), F.col("_fp").alias("fp")).alias("_key"))
    # Row numbers are unique, so texts are joined on keys of which none is hot.
    rows = firsts.join(chosen, "_key", "left_semi").select("_row")
    return _unfolded(marked.join(rows, "_row", "left_semi"), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontam.matches(_folded(docs), table(spark, sf_dir, "benchmark"), short=False)
    return _unfolded(found.filter(F.size("matches") == 0), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    own = ["n_chars"] if "n_chars" in docs.columns else []
    return _unfolded(secret_scan.redact(_folded(docs, *own)), docs, *own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.op4(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{name}")
    return docs
