"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, embeddings, lines, repair
from .chat import op8_chat
from .decontaminate import op2_decontaminate
from .divergence import op13_divergence
from .embeddings import op9_embeddings
from .html_text import op7_html
from .language import op3_language
from .lines import op11_lines
from .packing import op4_packing
from .pii import op1_pii
from .repair import op12_repair
from .secrets import op5_secrets
from .simhash import op10_simhash
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_embeddings": op9_embeddings,
    "op10_simhash": op10_simhash,
    "op11_lines": op11_lines,
    "op12_repair": op12_repair,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op8_chat": chat.ORACLE,
    "op9_embeddings": embeddings.ORACLE,
    "op11_lines": lines.ORACLE,
    "op12_repair": repair.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
