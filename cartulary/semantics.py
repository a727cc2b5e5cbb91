"""Options that decide what a report means and how its joins are laid out."""

from __future__ import annotations

from dataclasses import dataclass

from cartulary.operators.uniqueness import LookupCheck


@dataclass(frozen=True)
class Semantics:
    """Where the two source dialects disagree.

    keep_null_elements
        Collected arrays keep NULL elements instead of skipping them.
    keep_null_fields
        Collected objects become JSON text with explicit nulls. Otherwise they are structs,
        whose ``to_json`` text leaves null fields out.
    json_quoted
        Fields read as JSON values stay JSON text (strings keep their quotes) and fields read
        as scalars are NULL when the path holds an object or array. Otherwise every field is
        plain text.
    """

    keep_null_elements: bool = False
    keep_null_fields: bool = False
    json_quoted: bool = False


VARIANT = Semantics()
PRESTO = Semantics(keep_null_elements=True, keep_null_fields=True, json_quoted=True)


@dataclass(frozen=True)
class Tuning:
    """Layout of joins and groups. No setting changes a result.

    broadcast_bytes
        A lookup estimated above this, or above the session's
        ``spark.sql.autoBroadcastJoinThreshold``, is not broadcast by the library; None means the
        session's limit alone.
    hot_rows
        A key with at least this many rows is hot and split into pieces of about this size. So hot
        keys are at most one for each ``hot_rows`` rows.
    hot_pairs
        Where two sides fan out against each other, a key that makes more rows than this is hot as
        well, and its pieces make about this many rows each.
    lookups
        Told the rows and distinct keys of every look-up, see ``LookupCheck``.
    """

    broadcast_bytes: int | None = None
    hot_rows: int = 1_000_000
    hot_pairs: int = 1_000_000
    lookups: LookupCheck | None = None


DEFAULT_TUNING = Tuning()
