"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, html, linededup, mixing, secrets, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_secrets": secrets.op2_secrets,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html": html.op5_html,
    "op6_ann": ann.op6_ann,
    "op7_linededup": linededup.op7_linededup,
    "op8_warc": warc.op8_warc,
    "op9_sharding": sharding.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES: dict[str, str] = {
    "op7_linededup": linededup.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
