"""Queries of the training-data operators over a folder of tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .language import op8_language_id
from .language_model import op5_language_model
from .licences import OP9_SQL, op9_licences
from .minhash_dedup import op4_minhash_dedup
from .mixing import op2_mixing
from .passages import op6_repeated_passages
from .token_files import op10_token_files
from .toxicity import op3_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_language_model": op5_language_model,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_licences": op9_licences,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL = {"op7_embedding_dedup": OP7_SQL, "op9_licences": OP9_SQL}
