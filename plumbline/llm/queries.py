"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from plumbline.llm.bpe import op7_bpe
from plumbline.llm.decontaminate import OP11_SQL, op11_decontaminate
from plumbline.llm.exact import OP2_SQL, op2_exact_dedup
from plumbline.llm.language import op1_language_id
from plumbline.llm.licences import OP9_SQL, op9_licence_scan
from plumbline.llm.mixing import OP8_SQL, op8_mix_sources
from plumbline.llm.nearcopies import OP3_SQL, op3_near_copies
from plumbline.llm.negatives import OP13_SQL, op13_hard_negatives
from plumbline.llm.toxicity import op10_toxicity
from plumbline.llm.trie import OP12_SQL, op12_prefix_trie
from plumbline.llm.urls import op4_url_filter
from plumbline.llm.vectors import OP5_SQL, op5_near_embeddings
from plumbline.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_exact_dedup, op3_near_copies, op4_url_filter, op5_near_embeddings, op6_warc, op7_bpe, op8_mix_sources,
        op9_licence_scan, op10_toxicity, op11_decontaminate, op12_prefix_trie, op13_hard_negatives,
    )
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL, "op3_near_copies": OP3_SQL, "op5_near_embeddings": OP5_SQL, "op6_warc": OP6_SQL, "op8_mix_sources": OP8_SQL,
    "op9_licence_scan": OP9_SQL, "op11_decontaminate": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
