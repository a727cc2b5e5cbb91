"""Building blocks of the reports: skew-safe joins, reference resolution, row grain."""
