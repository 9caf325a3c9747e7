"""One query for each operator, over its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, html_blocks, langid, merkle, mixing, pii, quality, sentencepiece_bpe, sharding, simhash, toxicity, turns, warc
from .common import table

SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.placed(docs, F.col("doc_id"), SHARD_NAMES, instead=F.col("text")).select("doc_id", "slot", "shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "sampled")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.encoded(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))


    def number_of(kind: str):
        return F.size(F.filter(each, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [number_of(k) for k in pii.KINDS[:4]]
    all_spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_join(in_order(F.concat(each, F.split("terms", ","))), ","))
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), all_spans.alias("spans"))


def in_order(spans):
    """Spans by start, then kind."""
    kinds = F.array(*map(F.lit, pii.KINDS))
    key = F.transform(spans, lambda s: F.struct(F.element_at(F.split(s, ":"), 2).cast("int").alias("a"), F.array_position(kinds, F.element_at(F.split(s, ":"), 1)).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda x: x["s"])


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ms = lambda x: F.round(x, 0).cast("long").cast("string")
    spans = F.array_join(F.transform("segments", lambda s: F.concat(ms(s["from_ms"]), F.lit("-"), ms(s["to_ms"]))), ",")
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "n_tensors", F.sha2("mel", 256).alias("tensors_sha256"), spans.alias("spans_ms"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [F.col("n_chars").cast("long") + 1 if i == 3 else c for i, c in enumerate(fields)]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields).alias("leaf"), F.when(changed, merkle.leaf(*tampered)).alias("claimed"))
    made = merkle.manifest(rows, "lang", "doc_id").withColumn("claimed", F.coalesce("claimed", "leaf"))
    out = merkle.refolded(made, "claimed")
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = turns.summary(turns.edits(turns.damaged(rows))).withColumnRenamed("conv_id", "__conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *turns.FAULTS, "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = langid.identified(docs, learn=fold != 2, calibrate=fold == 3)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", F.round("entropy", 4).alias("entropy"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_mixing, op3_sentencepiece, op4_toxicity, op5_html, op6_warc, op7_quality, op8_simhash, op9_pii, op10_audio, op11_merkle, op12_turns, op13_langid)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
