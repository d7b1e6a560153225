"""Operators for preparing training data: joins on n-grams, secret scans, chat
formatting, token counts, mixing, packing, exact dedup, nearest neighbours,
toxicity, language-model scores, ranked search,
min-max near-dedup and clusters. Nothing else in the library imports it."""
