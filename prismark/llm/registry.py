"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from prismark.llm.brown_lm import op9_brown_lm
from prismark.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from prismark.llm.hamming_search import OP8_SQL, op8_hamming_topk
from prismark.llm.license_scan import OP5_SQL, op5_license_scan
from prismark.llm.near_dedup import OP3_SQL, op3_near_dedup
from prismark.llm.packing import op4_packing
from prismark.llm.toxicity import op10_toxicity
from prismark.llm.trie_bpe import op7_trie_bpe
from prismark.llm.url_filter import op1_url_filter
from prismark.llm.warc import OP6_SQL, op6_warc_revisits

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_trie_bpe": op7_trie_bpe,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_brown_lm": op9_brown_lm,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op8_hamming_topk": OP8_SQL,
}
