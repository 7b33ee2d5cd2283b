"""Registry of this subpackage's queries and of their SQL, for the repository's entry module."""

from __future__ import annotations

from . import chat, exactdup, htmlmain, lexical, mih, packing, ppm, sigtree, simhash, spm, substring, toxicity, whiten

QUERIES = {
    f.__name__: f
    for f in (
        spm.op1_sentencepiece,
        toxicity.op2_toxicity,
        simhash.op3_simhash,
        mih.op4_topk,
        ppm.op5_language_id,
        chat.op6_chat,
        packing.op7_packing,
        substring.op8_substring,
        htmlmain.op9_html,
        sigtree.op10_jaccard,
        exactdup.op11_exact_dedup,
        whiten.op12_whitening,
        lexical.op13_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_topk": mih.OP4_SQL, "op11_exact_dedup": exactdup.OP11_SQL, "op13_search": lexical.OP13_SQL}
