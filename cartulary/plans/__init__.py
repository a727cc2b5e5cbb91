"""The reports: entity enrichment, users, curated datasets, domains and usage."""
