"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from leafmill.llm.chat import OP8_SQL, op8_chat
from leafmill.llm.decontaminate import op7_decontamination
from leafmill.llm.embeddings import op1_embedding_dedup
from leafmill.llm.language import op4_language
from leafmill.llm.ngram_join import op3_ngram_join
from leafmill.llm.pieces import op6_pieces
from leafmill.llm.quality import op5_quality
from leafmill.llm.secrets import op2_secret_scan
from leafmill.llm.sql import EMBEDDINGS, NGRAMS
from leafmill.llm.token_counts import op9_token_counts
from leafmill.llm.token_files import op10_token_files

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_decontamination": op7_decontamination,
    "op8_chat": op8_chat,
    "op9_token_counts": op9_token_counts,
    "op10_token_files": op10_token_files,
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op3_ngram_join": NGRAMS,
    "op8_chat": OP8_SQL,
}
