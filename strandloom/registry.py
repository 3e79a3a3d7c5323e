"""Driver queries of the sequence engine."""

from __future__ import annotations

from strandloom.plans import algebra, base, counting, graphs, mates, scalars  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
