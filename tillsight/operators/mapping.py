"""Header mapping onto the standard sales columns (M1).

Resolution works on header names only (driver-side metadata); the data
move in a single ``select``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import COLUMN_SYNONYMS


def normalise_header(name: str) -> str:
    return str(name).lower().replace("_", " ").replace("-", " ")


def resolve_mapping(columns: list[str], synonyms=COLUMN_SYNONYMS) -> dict[str, str | None]:
    """Standard column -> source header (or None).

    Headers are compared after lower-casing and turning ``_``/``-`` into
    spaces; of two headers with one normalised form the later wins; per
    standard column the first synonym (in list order) that exists is used.
    """
    by_norm: dict[str, str] = {}
    for c in columns:
        by_norm[normalise_header(c)] = c
    out: dict[str, str | None] = {}
    for std, syns in synonyms.items():
        out[std] = next((by_norm[normalise_header(s)] for s in syns if normalise_header(s) in by_norm), None)
    return out


def map_columns(df: DataFrame, keep=("_row",), synonyms=COLUMN_SYNONYMS) -> tuple[DataFrame, dict]:
    """Project to the standard columns; unmatched ones are all-null text.
    Columns named in ``keep`` (row order, dataset keys) pass through."""
    m = resolve_mapping([c for c in df.columns if c not in keep], synonyms)
    cols = [F.col(f"`{k}`") for k in keep if k in df.columns]
    for std, src in m.items():
        cols.append((F.col(f"`{src}`") if src else F.lit(None).cast("string")).alias(std))
    return df.select(*cols), m
