"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pactline.llm.decontamination import op3_decontamination
from pactline.llm.embedding_dedup import op2_embedding_near_dedup
from pactline.llm.filter_audit import OP11_SQL, op11_filter_interaction
from pactline.llm.line_dedup import op8_line_dedup
from pactline.llm.minhash_dedup import op1_minhash_near_dedup
from pactline.llm.pii_surrogates import op9_pii_surrogates
from pactline.llm.prefix_trie import OP12_SQL, op12_conversation_trie
from pactline.llm.secret_scan import op4_secret_scan
from pactline.llm.sentencepiece_codec import op5_sentencepiece
from pactline.llm.substring_dedup import op6_substring_dedup
from pactline.llm.token_output import op10_token_output
from pactline.llm.topk_search import OP13_SQL, op13_topk_search
from pactline.llm.toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_pii_surrogates": op9_pii_surrogates,
        "op10_token_output": op10_token_output,
        "op11_filter_interaction": op11_filter_interaction,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_topk_search": op13_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_interaction": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_topk_search": OP13_SQL}
