"""Queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from codeweir.llm import centroids, chat, exact_dedup, lexical, lm_scoring, minmax, mixing, neighbours, ngram_join, packing, secrets, span_sql, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_chat_format": chat.op3_chat_format,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_mixing": mixing.op5_mixing,
        "op6_packing": packing.op6_packing,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm_scores": lm_scoring.op10_lm_scores,
        "op11_search": lexical.op11_search,
        "op12_minmax": minmax.op12_minmax,
        "op13_clusters": centroids.op13_clusters,
        "mix_by_words": mixing.mix_by_words,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.SQL,
        "op2_secret_scan": span_sql.secret_sql(),
        "op3_chat_format": span_sql.chat_sql(),
        "mix_by_words": mixing.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op8_neighbours": neighbours.SQL,
        "op10_lm_scores": lm_scoring.SQL,
        "op11_search": lexical.SQL,
        "op12_minmax": minmax.SQL,
        "op13_clusters": centroids.SQL,
    }
