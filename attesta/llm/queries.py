"""The operators bound to the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .decontam import op5_decontam
from .divergence import OP13_SQL, op13_divergence
from .lines import op2_lines
from .media import op1_media
from .mixing import op12_mixing
from .neardup import op7_neardup
from .oracles import OP2_SQL, OP7_SQL, OP10_SQL
from .packing import op3_packing
from .quality import op8_quality
from .repair import OP11_SQL, op11_repair
from .suffix import op10_suffix
from .urls import op9_urls
from .warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_media, op2_lines, op3_packing, op4_chat, op5_decontam, op6_warc, op7_neardup, op8_quality, op9_urls, op10_suffix, op11_repair, op12_mixing, op13_divergence)}

#: The others' results can't be had from SQL: a binary container, tokenizers, edit distances at any place
#: of a text, trained models. ``tests/llm`` holds these queries against brute force.
ORACLE_SQL = {"op2_lines": OP2_SQL, "op4_chat": OP4_SQL, "op6_warc": OP6_SQL, "op7_neardup": OP7_SQL, "op10_suffix": OP10_SQL, "op11_repair": OP11_SQL, "op13_divergence": OP13_SQL}
