"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import op10_chat
from .decontam import op7_decontamination
from .hyperdim import op8_language_id
from .lmscore import op9_lm_score
from .mixing import op13_mixing
from .neardup import op4_near_duplicates
from .oracles import ORACLES
from .packing import op3_packing
from .pii import op6_pii
from .quality import op2_quality
from .sharding import op1_sharding
from .spelling import op12_spelling
from .tokenfile import op5_token_file
from .trie import op11_trie


def queries():
    every = (op1_sharding, op2_quality, op3_packing, op4_near_duplicates, op5_token_file, op6_pii, op7_decontamination, op8_language_id, op9_lm_score, op10_chat, op11_trie, op12_spelling, op13_mixing)
    return {f.__name__: f for f in every}


def oracle_sql():
    return dict(ORACLES)
