"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    bayes_minhash,
    chat_format,
    decontamination,
    language_id,
    lattice_dedup,
    ordinal_quality,
    ranked_search,
    source_mixing,
    sql,
    substring_dedup,
    token_counts,
    turn_repair,
    url_filter,
    warc,
)
from tallyframe.session import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The table has no capture times: page k counts as captured k seconds into 2024.
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    folder = work_path(spark, "warc")
    warc.write_archives(pages, folder, captured=captured)
    index = warc.merge_runs(warc.read_runs(spark, folder))
    return index.select(
        F.expr("try_cast(record_id AS BIGINT)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Grades: a point for good text and one for text that is not toxic.
    grade = F.col("quality") + 1 - F.col("toxic")
    labels = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    rated = docs.join(labels.where(~language_id.held_out()), "doc_id")
    grader = ordinal_quality.fit(rated, grades=3)
    graded = ordinal_quality.grade(docs, grader, at_least=2, keep_from=0.3)
    return graded.select("doc_id", "expected_grade", "tail", "kept")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality"))
    mixed = source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), quality=labels)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_token", "item_token", "matched", "stretch").distinct()


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", kept)


URL_RULES = (
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = token_counts.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = language_id.public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.train(docs.where(~language_id.held_out()), pieces)
    found = language_id.predict(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


#: A conversation that quotes the marks of the format.
QUOTING = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "conv_id long, turn long, role string, text string"
    quoting = spark.createDataFrame([(-7, 0, "user", QUOTING), (-7, 1, "assistant", QUOTING)], kinds)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    return format_report(chat_format.read_back(chat_format.format_parts(turns)))


def format_report(back: DataFrame) -> DataFrame:
    """Digests of what a formatted conversation says. Conversations of one part, that is nearly all,
    stay where they are; only longer ones have their parts brought together."""
    said = back.select(
        "conv_id",
        "part",
        "alone",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("trained", "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    values = ("n_turns", "said", "loss", "formatted_chars")
    parts = said.where(~F.col("alone")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "said", "loss"))).alias("parts"),
        F.sum("n_turns").alias("n_turns"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    joined = parts.select(
        "conv_id",
        "n_turns",
        F.array_join("parts.said", "").alias("said"),
        F.array_join("parts.loss", "").alias("loss"),
        "formatted_chars",
    )
    whole = said.where("alone").select("conv_id", *values).unionByName(joined)
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=10)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a checksum of conversation and turn. Dropped rows are marked
    ``gone``."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    named = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("fate"),
    )
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    harmed = named.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (fate == 0).alias("gone"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return harmed.drop("copy")


_REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def repair_report(edited: DataFrame) -> DataFrame:
    """One row a conversation from its edits, which pass by in order; texts are hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Passing | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if at is None or row["conv_id"] != at.conv:
                    if at is not None:
                        done.append(at.report())
                    at = _Passing(row["conv_id"])
                at.take(row)
            yield _reports(done)
        if at is not None:
            yield _reports([at.report()])

    return edited.mapInArrow(run, _REPORT)


class _Passing:
    """The figures of the conversation that passes by."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.faults = {name: 0 for name in ("blank", "duplicate", "truncated")}
        self.first = self.last = None
        self.numbers = self.illegal = self.cost = 0
        self.before = None
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def take(self, row: dict) -> None:
        edit = row["edit"]
        if edit is None:
            return
        self.cost += row["cost"]
        self.audit.append(edit)
        if edit != "I":
            self._faults_of(row)
        if edit != "D":
            line = f"{row['role']}:{row['text']}"
            self.digest.update((f"\n{line}" if self.begun else line).encode())
            self.begun = True

    def _faults_of(self, row: dict) -> None:
        if row["fault"] in self.faults:
            self.faults[row["fault"]] += 1
        turn, initial = row["turn"], row["old_role"][:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.numbers = turn, self.numbers + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.numbers
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _reports(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows)) if rows else [()] * 9
    names = [part.split()[0] for part in _REPORT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damaged_turns(table(spark, sf_dir, "conversations"))
    return repair_report(turn_repair.repair(damaged, absent="gone"))


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_source_mixing": op3_source_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_vocabulary": op6_url_vocabulary,
    "op7_lattice_dedup": op7_lattice_dedup,
    "op8_bayes_minhash": op8_bayes_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_chat_format": op11_chat_format,
    "op12_ranked_search": op12_ranked_search,
    "op13_turn_repair": op13_turn_repair,
}
SQL: dict[str, str] = {
    "op1_warc_index": sql.WARC,
    "op3_source_mixing": sql.MIXING,
    "op5_substring_dedup": sql.PASSAGES,
    "op6_url_vocabulary": sql.url_vocabulary(URL_RULES),
    "op7_lattice_dedup": sql.VECTORS,
    "op8_bayes_minhash": sql.NEAR_DOCUMENTS,
    "op11_chat_format": sql.chat_format(QUOTING),
    "op12_ranked_search": sql.RANKED,
    "op13_turn_repair": sql.TURN_REPAIR,
}
