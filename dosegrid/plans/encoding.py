"""Dense panel to sparse rows with catalogue identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dosegrid.operators.harmonise import refresh_rsids
from dosegrid.operators.sparse import to_sparse
from dosegrid.sources.genotypes import GenotypePanel


def refresh_panel(
    panel: GenotypePanel, catalogue: DataFrame, keep: bool = False, multi: str = "all"
) -> GenotypePanel:
    """Panel with rsIDs by position.

    If the positions are too many to broadcast, reference calls are removed
    before the sites are shuffled.
    """
    return panel._replace(calls=refresh_rsids(panel.calls, catalogue, keep, multi))


def encode_panel(
    panel: GenotypePanel,
    catalogue: DataFrame,
    keep: bool = False,
    multi: str = "all",
    **sparse_options: object,
) -> DataFrame:
    """Sparse rows of a whole panel; options as for ``to_sparse``."""
    refreshed = refresh_panel(panel, catalogue, keep, multi)
    return to_sparse(refreshed.calls, refreshed.headers, **sparse_options)
