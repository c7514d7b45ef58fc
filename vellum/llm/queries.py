"""The queries of this subpackage and their SQL."""

from vellum.llm.codes import OP11_SQL, op11_vector_codes
from vellum.llm.collocations import OP13_SQL, op13_collocations
from vellum.llm.decontaminate import OP7_SQL, op7_decontaminate
from vellum.llm.dedup import OP3_SQL, op3_exact_dedup
from vellum.llm.langid import op1_language
from vellum.llm.mix import OP2_SQL, op2_mix
from vellum.llm.neardup import OP6_SQL, op6_near_duplicates
from vellum.llm.pii import op5_personal_data
from vellum.llm.quality import op10_quality
from vellum.llm.secrets import op12_secrets
from vellum.llm.shards import op4_shards
from vellum.llm.substrings import op9_substring_dedup
from vellum.llm.tokens import op8_token_ids

QUERIES = {
    "op1_language": op1_language,
    "op2_mix": op2_mix,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_shards": op4_shards,
    "op5_personal_data": op5_personal_data,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_ids": op8_token_ids,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op2_mix": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
