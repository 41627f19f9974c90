"""The registered queries of the corpus operators; each runs its operator over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quaymaster.llm import byte_bpe, language_id, minhash, mixing, periodic_runs, permutation_index, phrase_automata, pii, ppm, quality_rules
from quaymaster.llm import suffix_repeats, url_reputation, whitening
from quaymaster.llm.common import crc_remainder, whole, written
from quaymaster.llm.oracle import MIXING, URL_REPUTATION
from quaymaster.llm.registry import query, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op2_source_mixing", MIXING)
def source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_language_id")
def language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(crc_remainder(F.col("doc_id")) != 0))
    return language_id.predict(docs, model).select(
        "doc_id", (crc_remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query("op8_url_reputation", URL_REPUTATION)
def url_filter(spark, sf_dir):
    """A page is good if the label of its number is of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"),
                             ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_byte_bpe")
def byte_level_bpe(spark, sf_dir):
    path = public_tokenizers.path(VOCABULARY)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return byte_bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op1_quality_rules")
def quality(spark, sf_dir):
    measured = written(quality_rules.measure(table(spark, sf_dir, "documents")), "measures")
    return quality_rules.judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                "base_failed", "kept", "votes", "quality")


@query("op5_minhash_near_dedup")
def near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op7_permutation_index")
def neighbours(spark, sf_dir):
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query("op9_ppm_scoring")
def language_model_scores(spark, sf_dir):
    return ppm.score_documents(table(spark, sf_dir, "documents"), train=crc_remainder(F.col("doc_id")) != 1)


@query("op6_phrase_automata")
def repeated_passages(spark, sf_dir):
    return phrase_automata.remove_repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_suffix_repeats")
def repeated_bytes(spark, sf_dir):
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def whitened_embeddings(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), shift=1_000_000)
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    return white.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


@query("op12_personal_data")
def personal_data(spark, sf_dir):
    spans = F.col("spans")
    counts = [F.size(pii.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(pii.listed(pii.of_kind(spans, *pii.BASE)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op13_periodic_runs")
def periodic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.looped(whole(), F.col("doc_id")).alias("text")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].cast("long").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"].cast("long") / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
