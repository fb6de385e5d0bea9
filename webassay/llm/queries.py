"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webassay.llm import langid, licenses, linktrust, mixing, neardup, ordermin, packing, pieces, pii, quality, toxicity, turns, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_linktrust": linktrust.query,
    "op2_langid": langid.query,
    "op3_mixing": mixing.query,
    "op4_sentencepiece": pieces.query,
    "op5_licenses": licenses.query,
    "op6_quality": quality.query,
    "op7_neardup": neardup.query,
    "op8_toxicity": toxicity.query,
    "op9_pii": pii.query,
    "op10_fingerprint": ordermin.query,
    "op11_packing": packing.query,
    "op12_vafile": vafile.query,
    "op13_turns": turns.query,
}
ORACLES: dict[str, str] = {"op6_quality": quality.SQL, "op7_neardup": neardup.SQL, "op12_vafile": vafile.SQL, "op13_turns": turns.SQL}
