"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from bitlake.llm import ann, id_coder, lm_scoring, mixing, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts
from bitlake.llm.common import table


def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_ann_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_token_id_files(spark, sf_dir):
    return id_coder.round_trip(table(spark, sf_dir, "documents"))


def op9_simhash_neardup(spark, sf_dir):
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix_sources": op3_mix_sources,
    "op4_ann_search": op4_ann_search,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_id_files": op8_token_id_files,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLES = {
    "op2_quality_rules": quality_rules.sql(),
    "op3_mix_sources": mixing.SQL,
}
