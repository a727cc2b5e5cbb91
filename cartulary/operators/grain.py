"""Row grain of the entity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartulary.functions.jsonx import quote
from cartulary.semantics import VARIANT, Semantics

ASSET = "asset"
ASSET_TAG = "asset_tag"


def apply_grain(
    df: DataFrame, grain: str, semantics: Semantics = VARIANT, as_text: bool = False
) -> DataFrame:
    """Finish rows that carry ``tag_names`` and ``n_tags``.

    ``asset`` keeps one row per entity. ``asset_tag`` repeats it once per tag, and once when
    it has none. An untagged entity has no names; where NULL elements are kept it has the one
    NULL its own row contributes. With ``as_text`` the names are one text already, empty without names.
    """
    if grain not in (ASSET, ASSET_TAG):
        raise ValueError(f"grain must be {ASSET!r} or {ASSET_TAG!r}, not {grain!r}")
    empty = "array(CAST(NULL AS STRING))" if semantics.keep_null_elements else "array()"
    if as_text:
        empty = "''"
    kept = [quote(name) for name in df.columns if name not in ("tag_names", "n_tags")]
    kept.append(f"coalesce(tag_names, {empty}) AS governedTagIds_tag_names")
    if grain == ASSET:
        return df.selectExpr(*kept)
    copies = "explode(sequence(1, CAST(greatest(coalesce(n_tags, 1), 1) AS INT))) AS __copy"
    return df.selectExpr(*kept, copies).drop("__copy")
