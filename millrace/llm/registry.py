"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, lines, minhash, negatives, packed, pii, resample, topk, urlfilter, vectors


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_url_filter": urlfilter.op3_url_filter,
        "op4_bpe": bpe.op4_bpe,
        "op5_language_id": langid.op5_language_id,
        "op6_preference_format": chat.op6_preference_format,
        "op7_pii": pii.op7_pii,
        "op8_minhash_dedup": minhash.op8_minhash_dedup,
        "op9_vector_dedup": vectors.op9_vector_dedup,
        "op10_packed_ids": packed.op10_packed_ids,
        "op11_importance_resample": resample.op11_importance_resample,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_exact_topk": topk.op13_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op6_preference_format": chat.OP6_SQL,
        "op8_minhash_dedup": minhash.OP8_SQL,
        "op9_vector_dedup": vectors.OP9_SQL,
        "op11_importance_resample": resample.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
        "op13_exact_topk": topk.OP13_SQL,
    }
