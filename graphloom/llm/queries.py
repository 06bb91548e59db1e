"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from graphloom.llm.audio import op1_audio
from graphloom.llm.byte_bpe import op2_byte_bpe
from graphloom.llm.digest import op10_digest
from graphloom.llm.html_text import op9_html_text
from graphloom.llm.packing import op3_best_fit_packing
from graphloom.llm.pii import op6_pii
from graphloom.llm.preference import OP8_SQL, op8_preference
from graphloom.llm.quality import op7_quality
from graphloom.llm.simhash import op5_simhash
from graphloom.llm.token_counts import op4_token_counts

QUERIES = {
    "op1_audio": op1_audio,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_preference": op8_preference,
    "op9_html_text": op9_html_text,
    "op10_digest": op10_digest,
}

#: The other queries hash, tokenise, learn or iterate in ways that SQL has no words for; they are held against brute force in tests.
SQL: dict[str, str] = {"op8_preference": OP8_SQL}
