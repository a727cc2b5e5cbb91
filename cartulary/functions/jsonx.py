"""Reading fields out of JSON documents.

A document column holds text or a variant. Text is parsed by one ``from_json`` with a schema of only
the wanted fields, always, so that a field's value does not depend on what else is read; where a
value's JSON form matters, by one ``try_parse_json``. A variant is read in place and never written
out as text. The parse is its own projection, so the optimizer does not repeat it for each field.

JSON null, a missing field and malformed text read as NULL; an object or array read as text gives
compact JSON. Text after the end of a document is not read. Of a repeated key the last value counts;
where the JSON form matters such a document is malformed, as it can be no variant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.semantics import VARIANT, Semantics

SCALAR = "scalar"
VALUE = "value"


@dataclass(frozen=True)
class Field:
    """``column`` is the text at ``path`` of the document ``doc``.

    ``kind`` matters only for quoted semantics: a scalar is NULL for objects and arrays, a
    value is JSON text.
    """

    column: str
    doc: str
    path: str
    kind: str = SCALAR


def quote(name: str) -> str:
    return f"`{name}`"


def document_schema(paths: Sequence[str]) -> str:
    """Smallest schema, as DDL, that reaches every path; leaves are strings."""
    return ", ".join(f"{name} {kind}" for name, kind in _schema_fields(paths))


def _schema_fields(paths: Sequence[str]) -> list[tuple[str, str]]:
    children: dict[tuple[str, bool], list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        name, bracket, _ = head.partition("[")
        children.setdefault((name, bool(bracket)), []).append(rest)
    names = [name for name, _ in children]
    if len(set(names)) != len(names):
        raise ValueError(f"a field is read both as an array and not: {sorted(paths)}")
    fields = []
    for (name, is_array), rests in children.items():
        inner = [rest for rest in rests if rest]
        if inner and len(inner) != len(rests):
            raise ValueError(f"{name!r} is read both as text and as an object")
        kind = "STRING"
        if inner:
            members = ", ".join(f"{member}: {of}" for member, of in _schema_fields(inner))
            kind = f"STRUCT<{members}>"
        fields.append((quote(name), f"ARRAY<{kind}>" if is_array else kind))
    return fields


def reach(parsed: str, path: str) -> str:
    """Expression for the value at ``path`` of a document parsed with ``document_schema``."""
    parsed = f"({parsed})"
    for part in path.split("."):
        name, bracket, index = part.partition("[")
        parsed = f"{parsed}.{quote(name)}"
        if bracket:
            parsed = f"get({parsed}, {int(index.rstrip(']'))})"
    return parsed


#: Text that is no JSON, as a variant would have it.
_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"


def _is_object(text: str) -> str:
    """Whether a JSON text starts as an object; the parser would take the first of an array for it."""
    return f"startswith(trim(LEADING ' \\n\\t\\r' FROM {text}), '{{')"


def parse_text(text: str, paths: Sequence[str]) -> str:
    """Expression that parses a text expression, to be read with ``reach``; NULL unless an object."""
    parsed = f"from_json({text}, '{document_schema(paths)}', {_STRICT})"
    return f"CASE WHEN {_is_object(text)} THEN {parsed} END"


def parse(doc: str, paths: Sequence[str]) -> str:
    return parse_text(quote(doc), paths)


def is_variant(df: DataFrame, doc: str) -> bool:
    return isinstance(df.schema[doc].dataType, T.VariantType)


def variant_text(variant: str, path: str) -> str:
    """Text at a path of a variant; an object or array gives compact JSON."""
    return f"try_variant_get({variant}, '$.{path}', 'string')"


def text_in(text: str, path: str) -> str:
    """Expression for the text at one path of a text expression."""
    return reach(parse_text(text, [path]), path)


def text_at(df: DataFrame, doc: str, path: str) -> str:
    """Expression for the text at one path of a document that is read for nothing else."""
    return variant_text(quote(doc), path) if is_variant(df, doc) else text_in(quote(doc), path)


def elements(text: str) -> str:
    """Expression for the elements of a JSON array, each as text; NULL unless it is an array."""
    return f"from_json({text}, 'ARRAY<STRING>', {_STRICT})"


def variant_elements(variant: str, path: str, kind: str = "string") -> str:
    """As ``elements``, of the array at a path of a variant."""
    return f"try_variant_get({variant}, '$.{path}', 'array<{kind}>')"


def text_array(df: DataFrame, doc: str, name: str) -> str:
    """Expression for the array under ``name`` with each element as text.

    NULL unless it is an array.
    """
    if is_variant(df, doc):
        return variant_elements(quote(doc), name)
    parsed = f"from_json({quote(doc)}, '{quote(name)} ARRAY<STRING>', {_STRICT}).{quote(name)}"
    return f"CASE WHEN {_is_object(quote(doc))} THEN {parsed} END"


def _quoted(variant: str, field: Field) -> str:
    as_json = f"to_json(try_variant_get({variant}, '$.{field.path}', 'variant'))"
    if field.kind == VALUE:
        return f"nullif({as_json}, 'null')"
    as_text = f"try_variant_get({variant}, '$.{field.path}', 'string')"
    return f"CASE WHEN left({as_json}, 1) NOT IN ('{{', '[') THEN {as_text} END"


def value_text(holder: str, field: Field, variant: bool, semantics: Semantics = VARIANT) -> str:
    """Expression for a field of a document held as a variant, or as the text already read."""
    if semantics.json_quoted:
        return _quoted(holder, field)
    return variant_text(holder, field.path) if variant else holder


def may_mention(df: DataFrame, doc: str, word: str) -> str:
    """Condition that is false only for documents in which no string can contain ``word``.

    A cheap test to put before a parse. JSON text spells ASCII letters as they are, unless it
    escapes them, so a document with any escape of that kind passes. A variant needs no parse and
    always passes.
    """
    if is_variant(df, doc):
        return "true"
    return f"(contains({quote(doc)}, '{word}') OR contains({quote(doc)}, concat(chr(92), 'u')))"


def _by_document(fields: Sequence[Field]) -> dict[str, list[Field]]:
    by_doc: dict[str, list[Field]] = {}
    for field in fields:
        by_doc.setdefault(field.doc, []).append(field)
    return by_doc


def read_for_filter(df: DataFrame, keep: Sequence[str], fields: Sequence[Field]) -> DataFrame:
    """As ``read_fields`` in plain text, when filters on the fields follow.

    The parsed documents come out of one generator, below which no filter is pushed. Otherwise
    the optimizer would copy a parse into every condition on a field.
    """
    parsed, leaves = [], {}
    for doc, wanted in _by_document(fields).items():
        if is_variant(df, doc):
            parsed.append(f"'{doc}', {quote(doc)}")
            leaves |= {f.column: variant_text(f"__docs.{quote(doc)}", f.path) for f in wanted}
        else:
            parsed.append(f"'{doc}', {parse(doc, [f.path for f in wanted])}")
            leaves |= {f.column: reach(f"__docs.{quote(doc)}", f.path) for f in wanted}
    once = f"explode(array(named_struct({', '.join(parsed)}))) AS __docs"
    listed = [f"{leaves[f.column]} AS {quote(f.column)}" for f in fields]
    held = df.selectExpr(*kept_columns(df, keep), once)
    return held.selectExpr(*(quote(name) for name in keep), *listed)


def kept_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Expressions for columns passed through; a whole document is given as JSON text."""
    return [
        f"to_json({quote(n)}) AS {quote(n)}" if is_variant(df, n) else quote(n) for n in names
    ]


def read_fields(
    df: DataFrame,
    keep: Sequence[str],
    fields: Sequence[Field],
    semantics: Semantics = VARIANT,
) -> DataFrame:
    """Columns ``keep`` followed by every field, parsing each document once."""
    parsed: list[str] = []
    leaves: dict[str, str] = {}
    for doc, wanted in _by_document(fields).items():
        holder = quote(f"__{doc}")
        variant = is_variant(df, doc)
        if semantics.json_quoted:
            parsed.append(f"{quote(doc) if variant else f'try_parse_json({quote(doc)})'} AS {holder}")
            leaves |= {f.column: _quoted(holder, f) for f in wanted}
        elif variant:
            parsed.append(f"{quote(doc)} AS {holder}")
            leaves |= {f.column: variant_text(holder, f.path) for f in wanted}
        else:
            parsed.append(f"{parse(doc, [f.path for f in wanted])} AS {holder}")
            leaves |= {f.column: reach(holder, f.path) for f in wanted}
    return df.selectExpr(*kept_columns(df, keep), *parsed).selectExpr(
        *map(quote, keep), *(f"{leaves[f.column]} AS {quote(f.column)}" for f in fields)
    )
