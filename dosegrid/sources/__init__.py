from dosegrid.sources.associations import clean_associations, read_associations
from dosegrid.sources.blocks import read_blocks, write_blocks
from dosegrid.sources.catalogue import (
    BucketedCatalogue,
    parse_catalogue,
    read_catalogue,
    unique_catalogue,
    write_catalogue,
)
from dosegrid.sources.genotypes import (
    GenotypePanel,
    WideTable,
    header_columns,
    header_table,
    merge_wide,
    pack_wide,
    panel_from_lines,
    parse_calls,
    read_panel,
    sample_table,
    write_panel,
)
from dosegrid.sources.lines import read_lines, read_lines_capped
from dosegrid.sources.load import load_variants, merge_by_name
from dosegrid.sources.sinks import write_counted, write_parquet, write_tsv

__all__ = [
    "BucketedCatalogue",
    "GenotypePanel",
    "WideTable",
    "clean_associations",
    "header_columns",
    "header_table",
    "load_variants",
    "merge_by_name",
    "merge_wide",
    "pack_wide",
    "panel_from_lines",
    "parse_calls",
    "parse_catalogue",
    "read_associations",
    "read_blocks",
    "read_catalogue",
    "read_lines",
    "read_lines_capped",
    "read_panel",
    "sample_table",
    "unique_catalogue",
    "write_blocks",
    "write_catalogue",
    "write_counted",
    "write_panel",
    "write_parquet",
    "write_tsv",
]
