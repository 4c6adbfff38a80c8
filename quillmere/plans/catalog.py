"""All queries and their SQL."""

from __future__ import annotations

from quillmere.plans import assembly, audits, experimental, features, ledgers, more, registry, resampled, scoring, shaped, stable, wider  # noqa: F401  (each module adds its queries)

QUERIES, SQL, FLAGSHIP = registry.QUERIES, registry.SQL, registry.FLAGSHIP
