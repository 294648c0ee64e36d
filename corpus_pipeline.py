"""The corpus pipeline: documents to a mix of clean, distinct text.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the
last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bayes_minhash, decontamination, language_id, source_mixing, substring_dedup
from tallyframe.llm.grouped import fresh, named_texts, others
from tallyframe.session import saved_table, work_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with letters, at a probability of one half."""
    import public_tokenizers

    pieces = language_id.public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.train(docs.where(~language_id.held_out()), pieces)
    carried = fresh(docs, "carried")
    slim = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias(carried))
    found = language_id.predict(slim, model, keep_text=True)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= 0.5))
    return kept.select(*[F.col("text") if c == "text" else F.col(carried)[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the one with the smallest doc_id, null ids last.
    Unlike texts stay, also those that share an id or have none. Of rows equal in id and text the
    first by its other columns' JSON text stays."""
    kept = saved_table(bayes_minhash.distinct_texts(docs), "pipeline-kept")
    named = named_texts(docs, "doc_id", "text", docs.columns).select("doc", "mark", "row")
    rest = [F.col(f"row.`{c}`").alias(c) for c in others(docs, "doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    one = named.join(kept, ["doc", "mark"]).groupBy("doc", "mark").agg(F.min_by("row", order).alias("row"))
    return one.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; texts that lose none stay as they are."""
    carried = fresh(docs, "carried")
    slim = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias(carried))
    cut = substring_dedup.remove_repeats(slim, untouched_as_is=True)
    row = {c: F.col(carried)[c].alias(c) for c in docs.columns if c != "text"}
    row["text"] = F.col("text")
    if "n_chars" in row:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        row["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(F.col(carried)["n_chars"]).alias("n_chars")
    return cut.select(*[row[c] for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality"))
    mixed = source_mixing.mix(docs, quality=quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
]

#: Language scores and MinHash groups are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
