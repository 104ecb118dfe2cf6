"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from arcline.llm import codes, collocations, decontaminate, jaccard, licenses, lines, mixing, pieces, pitman_yor, pseudonyms, topk, toxicity, warc


def queries() -> dict:
    return {"op1_mixing": mixing.op1, "op2_pseudonyms": pseudonyms.op2, "op3_topk": topk.op3, "op4_warc": warc.op4, "op5_lines": lines.op5, "op6_pitman_yor": pitman_yor.op6, "op7_toxicity": toxicity.op7, "op8_decontaminate": decontaminate.op8, "op9_licenses": licenses.op9, "op10_jaccard": jaccard.op10, "op11_collocations": collocations.op11, "op12_pieces": pieces.op12, "op13_codes": codes.op13}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.OP3_SQL, "op4_warc": warc.OP4_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op11_collocations": collocations.OP11_SQL, "op13_codes": codes.OP13_SQL}
