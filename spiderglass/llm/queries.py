"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP10_SQL, op10_perspectives
from .decontaminate import op9_decontaminate
from .extract import op1_extract
from .fingerprint import op4_fingerprint
from .lines import op2_line_dedup
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP6_SQL, op6_mix
from .neardup import op5_neardup
from .packing import op13_packing
from .periodic import op11_runs
from .quality import op8_quality
from .repeats import op7_repeats
from .secrets import op3_secrets

QUERIES = {
    "op1_extract": op1_extract,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_fingerprint": op4_fingerprint,
    "op5_neardup": op5_neardup,
    "op6_mix": op6_mix,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_perspectives": op10_perspectives,
    "op11_runs": op11_runs,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}
ORACLE_SQL = {"op6_mix": OP6_SQL, "op10_perspectives": OP10_SQL, "op12_merkle": OP12_SQL}
