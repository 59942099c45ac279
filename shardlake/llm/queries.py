"""The registered queries of the training-data operators, over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, decontam, html, langid, license, mixing, periodic, quality, simhash, substring, topk, trie
from .common import table

QUERIES = {
    "op1_preference_format": lambda s, d: chat.op1(table(s, d, "conversations")),
    "op2_html_mincut": lambda s, d: html.op2(table(s, d, "pages")),
    "op3_language_bloom": lambda s, d: langid.op3(table(s, d, "documents")),
    "op4_topk_accumulate": lambda s, d: topk.op4(table(s, d, "embeddings")),
    "op5_mix_histogram": lambda s, d: mixing.op5(table(s, d, "documents")),
    "op6_quality_fm": lambda s, d: quality.op6(table(s, d, "documents"), table(s, d, "labels")),
    "op7_sentence_spans": lambda s, d: substring.op7(table(s, d, "documents")),
    "op8_simhash_pigeonhole": lambda s, d: simhash.op8(table(s, d, "documents")),
    "op9_license_diagonals": lambda s, d: license.op9(table(s, d, "documents")),
    "op10_benchmark_wand": lambda s, d: decontam.op10(table(s, d, "documents"), table(s, d, "benchmark")),
    "op11_periodic_grid": lambda s, d: periodic.op11(table(s, d, "documents")),
    "op12_bpe_boundaries": lambda s, d: bpe.op12(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op13_prefix_trie": lambda s, d: trie.op13(table(s, d, "conversations")),
}
SQL = {"op1_preference_format": chat.SQL, "op4_topk_accumulate": topk.SQL, "op5_mix_histogram": mixing.SQL, "op9_license_diagonals": license.SQL, "op13_prefix_trie": trie.SQL}
