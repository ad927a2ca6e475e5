"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from llm import bytebpe, decontam, dualtree, langid, licenses, mixing, nndescent, orderminhash, pii, repeats, spelling, suffixtree, tokens

QUERIES = {
    "op1_suffix_tree": suffixtree.op1_suffix_tree,
    "op2_nn_descent": nndescent.op2_nn_descent,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_order_minhash": orderminhash.op4_order_minhash,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_language": langid.op6_language,
    "op8_token_shards": tokens.op8_token_shards,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_personal_data": pii.op10_personal_data,
    "op7_mixing": mixing.op7_mixing,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_vector_codes": dualtree.op12_vector_codes,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op2_nn_descent": nndescent.ORACLE,
    "op3_decontamination": decontam.ORACLE,
    "op12_vector_codes": dualtree.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
