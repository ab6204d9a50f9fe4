"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

_WHERE = {
    "op1_secret_scan": "secret_scan",
    "op2_lm_score": "lm_score",
    "op3_html_extract": "html_extract",
    "op4_near_dup": "near_dup",
    "op5_warc": "warc",
    "op6_ann": "ann",
    "op7_sharding": "sharding",
    "op8_mixing": "mixing",
    "op9_toxicity": "toxicity",
    "op10_decontamination": "decontamination",
    "op11_lexical_search": "lexical",
    "op12_sentencepiece": "pieces",
    "op13_merkle_manifest": "merkle",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from .decontamination import OP10_SQL
    from .lexical import OP11_SQL
    from .merkle import OP13_SQL
    from .mixing import OP8_SQL
    from .sharding import op7_sql
    from .warc import OP5_SQL

    return {"op5_warc": OP5_SQL, "op7_sharding": op7_sql(), "op8_mixing": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
