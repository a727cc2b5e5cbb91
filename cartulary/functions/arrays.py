"""Objects and the arrays that collect them, as SQL expressions."""

from __future__ import annotations

from collections.abc import Mapping

from cartulary.semantics import VARIANT, Semantics


def make_object(fields: Mapping[str, str], semantics: Semantics = VARIANT) -> str:
    """One object of named expressions; never NULL, even when all its fields are."""
    members = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    record = f"named_struct({members})"
    if semantics.keep_null_fields:
        return f"to_json({record}, map('ignoreNullFields', 'false'))"
    return record


def collect(value: str, semantics: Semantics = VARIANT, where: str | None = None) -> str:
    """Aggregate of ``value`` into an array, skipping NULLs unless they are kept.

    With ``where`` only the rows that meet the condition are collected.
    """
    chosen = f" FILTER (WHERE {where})" if where else ""
    if semantics.keep_null_elements:
        return f"transform(collect_list(struct({value} AS e)){chosen}, x -> x.e)"
    return f"collect_list({value}){chosen}"


def null_if_empty(array: str) -> str:
    return f"CASE WHEN size({array}) > 0 THEN {array} END"
