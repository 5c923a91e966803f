from dosegrid.functions.alleles import allele_list, pack_calls, reference_cells, two_codes
from dosegrid.functions.chromosomes import accession_code, chrom_code, chrom_code_or_number
from dosegrid.functions.text import rsid_number, whole_number

__all__ = [
    "accession_code",
    "allele_list",
    "chrom_code",
    "chrom_code_or_number",
    "pack_calls",
    "reference_cells",
    "rsid_number",
    "two_codes",
    "whole_number",
]
