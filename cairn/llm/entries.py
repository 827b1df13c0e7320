"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from cairn.llm import bpe, conversation_repair, neighbours, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, sentence_pieces, suffix_dedup, token_store, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_store": token_store.op2_token_store,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    "op10_ngram_jaccard_links": ngram_join.op10_ngram_jaccard_links,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_warc": warc.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
