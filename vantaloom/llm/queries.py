"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP6_SQL, op6_format_chats
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .fingerprints import op3_fingerprints
from .jaccard_join import OP8_SQL, op8_ngram_jaccard
from .language_id import op9_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op4_mix_sources
from .packing import op2_pack_sequences
from .quality import op7_quality
from .token_files import op5_token_files


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_pack_sequences": op2_pack_sequences,
        "op3_fingerprints": op3_fingerprints,
        "op4_mix_sources": op4_mix_sources,
        "op5_token_files": op5_token_files,
        "op6_format_chats": op6_format_chats,
        "op7_quality": op7_quality,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_language_id": op9_language_id,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op6_format_chats": OP6_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_line_dedup": OP10_SQL}
