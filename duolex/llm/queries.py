"""The registered queries of this folder, each over its whole table."""

import public_tokenizers

from duolex.llm import (
    conversations, decontamination, host_rules, language_id, minhash, mixing, quality, sharding, suffix_dedup, token_counts, toxicity, warc, whitening)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_source_mix", mixing.MIX_SQL)
def op2_source_mix(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_extendible_shards", sharding.SHARD_SQL)
def op7_extendible_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sharded = sharding.shard_by_bytes(docs.select("doc_id", "text"))
    return sharded.select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", "oversize")


@query("op9_decontamination", decontamination.DECONTAMINATION_SQL)
def op9_decontamination(spark, sf_dir):
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_host_rules", host_rules.HOST_SQL)
def op6_host_rules(spark, sf_dir):
    judged = host_rules.judge_by_host(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_warc_derivatives")
def op4_warc_derivatives(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc.derivatives(warc.responses_from_pages(pages))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.ToxicityModel(docs, table(spark, sf_dir, "labels")).score(docs)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.Whitening(vectors).transform(vectors)


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


@query("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
