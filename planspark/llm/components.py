"""Connected components for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from planspark.operators import rounds


def components(nodes: DataFrame, links: DataFrame, id: str, name: str = "comp") -> DataFrame:
    """``nodes`` with the smallest id of their component as ``name``; ``links`` has ``a`` and ``b``.

    The rounds of ``planspark.operators.rounds`` without keys: joins are
    shuffled, since every table broadcast in a round stays with the driver
    until it is collected, and chunks of links are shortened first.
    """
    return rounds.components(nodes, links, [], id, name)
