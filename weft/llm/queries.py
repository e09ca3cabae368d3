"""Thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from . import chat, decontam, html_extract, langid, licences, mixing, near_dup, prefix_trie, quality, ranked_search, substring, toxicity, vector_search
from .common import table


def op1_source_mix(spark, sf_dir):
    return mixing.op1(table(spark, sf_dir, "documents"))


def op2_main_text(spark, sf_dir):
    return html_extract.op2(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark, sf_dir):
    return near_dup.op3(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring.op4(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark, sf_dir):
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark, sf_dir):
    return licences.op7(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return langid.op8(table(spark, sf_dir, "documents"))


def op9_chat_turns(spark, sf_dir):
    return chat.op9(table(spark, sf_dir, "conversations"))


def op10_decontaminate(spark, sf_dir):
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_search(spark, sf_dir):
    return vector_search.op11(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.op12(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_main_text": op2_main_text,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_chat_turns": op9_chat_turns,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_search": op11_vector_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE: dict[str, str] = {
    "op11_vector_search": vector_search.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
