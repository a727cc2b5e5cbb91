"""Whether look-up keys are unique, seen by the job that looks them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class LookupCheck:
    """Counts rows and distinct keys of every look-up of a report, within the report's own job.

    Give it as ``Tuning(lookups=check)``, run the report, then ask ``counts`` or ``verify``. The
    rows of a watched look-up are grouped by key, so a look-up that would have been broadcast is
    shuffled first; one that is shuffled anyway is grouped where it lies. No row is changed.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, lookup: DataFrame, key: str) -> DataFrame:
        others = [name for name in lookup.columns if name != key]
        seen = Observation()
        self._watched.append((key, seen))
        held = F.collect_list(F.struct(*others) if others else F.struct(F.lit(1).alias("__one")))
        grouped = lookup.groupBy(key).agg(held.alias("__rows"))
        counted = grouped.observe(
            seen, F.sum(F.size("__rows")).alias("rows"), F.count(F.lit(1)).alias("keys")
        )
        return counted.select(key, F.inline("__rows")).select(*lookup.columns)

    def counts(self) -> list[tuple[str, int, int]]:
        """``key, rows, distinct keys`` of each look-up, in the order of the plan; waits for the job.

        A look-up that the job left out, as nothing met it, has no rows.
        """
        found = [(key, seen.get) for key, seen in self._watched]
        return [(key, of.get("rows") or 0, of.get("keys") or 0) for key, of in found]

    def verify(self) -> None:
        """An error that names the look-ups in which a key occurs more than once."""
        repeated = [f"{key}: {rows} rows, {keys} keys" for key, rows, keys in self.counts() if rows > keys]
        if repeated:
            raise ValueError(f"look-up keys are not unique ({'; '.join(repeated)})")
