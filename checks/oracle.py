"""The same results in plain SQL, written row by row over the same tables."""

from __future__ import annotations

import re

from checks import inputs

_CHR = (
    "CASE {c} WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 "
    "ELSE CASE WHEN TRY_CAST({c} AS INT) BETWEEN 1 AND 22 THEN TRY_CAST({c} AS INT) END END"
)


def _catalogue(raw: str) -> str:
    return f"""
SELECT chr, pos, rsID, code, allele, annot FROM (
 SELECT *, row_number() OVER (PARTITION BY rsID, code ORDER BY chr, pos, allele, annot) AS rn FROM (
  SELECT CAST(CASE WHEN n BETWEEN 1 AND 24 THEN n WHEN n = 12920 THEN 25 END AS INT) AS chr, pos,
   CAST(substr(rsID, 3) AS BIGINT) AS rsID, CAST(unnest(range(len(l))) AS INT) AS code, unnest(l) AS allele, annot
  FROM (SELECT *, TRY_CAST(regexp_extract(chr, 'NC_0+(\\d+).', 1) AS INT) AS n, string_split(ref || ',' || alt, ',') AS l FROM {raw}) a
  WHERE n BETWEEN 1 AND 24 OR n = 12920) b) c
WHERE rn = 1"""


def _unique(rows: str, columns: str, tie: str) -> str:
    return f"""
SELECT {columns} FROM (
 SELECT *, row_number() OVER (PARTITION BY trait, rsID, alt ORDER BY date DESC NULLS LAST, pubmedID NULLS LAST, "OR" DESC NULLS LAST{tie}) AS rn
 FROM ({rows}) a) b
WHERE rn = 1"""


def _fill(rsid: str) -> str:
    return _unique(
        f"""SELECT {rsid} AS rsID, g.alt, g."OR", g.chr, g.pos, g.trait, g.date, g.pubmedID
 FROM gwas g LEFT JOIN lookup l ON g.chr = l.chr AND g.pos = l.pos""",
        'rsID, alt, "OR", chr, pos, trait, date, pubmedID',
        ", chr NULLS LAST, pos NULLS LAST",
    )


def _refreshed(join: str, lookup: str) -> str:
    return f"""
SELECT s.source, s.contig, s.chr, s.pos, s.id AS oldID, l.rsID, s.ref, s.alt, s.qual, s.filter, s.k
FROM placed s {join} JOIN {lookup} l ON s.chr = l.chr AND s.pos = l.pos"""


def _codes(sites: str, phased: bool = False) -> str:
    cell = "gt" if phased else "replace(split_part(gt, ':', 1), '/', '|')"
    return f"""
SELECT r.*, g.sample, g.sample_name,
 coalesce(TRY_CAST(split_part({cell}, '|', 1) AS INT), 0) AS a, coalesce(TRY_CAST(split_part({cell}, '|', 2) AS INT), 0) AS b
FROM {sites} r JOIN gt g ON r.k = g.k"""


def _sparse(codes: str) -> str:
    return f"""
SELECT sample, sample_name, rsID, min(chr) AS chr, min(pos) AS pos, code, CAST(count(*) AS INT) AS dose
FROM (SELECT *, a AS code FROM {codes} UNION ALL SELECT *, b AS code FROM {codes}) u
WHERE code > 0
GROUP BY sample, sample_name, rsID, CASE WHEN rsID IS NULL THEN contig END, CASE WHEN rsID IS NULL THEN pos END, code"""


CTES = {
    "sites": inputs.SITES,
    "placed": f"SELECT *, {_CHR.format(c='contig')} AS chr FROM sites",
    "samples": inputs.SAMPLES,
    "sample_ids": "SELECT *, row_number() OVER (PARTITION BY source ORDER BY s_suppkey) - 1 AS position, row_number() OVER (ORDER BY source, s_suppkey) - 1 AS sample FROM samples",
    "gt": f"SELECT k, s.source, position, sample, sample_name, {inputs.call_sql('k', 's_suppkey')} AS gt FROM sites s JOIN sample_ids i ON s.source = i.source",
    "catalogue_raw": inputs.CATALOGUE_RAW,
    "catalogue_raw_newer": inputs.CATALOGUE_RAW_NEWER,
    "catalogue": _catalogue("catalogue_raw"),
    "newer": _catalogue("catalogue_raw_newer"),
    "catalogue_more": """
SELECT * FROM catalogue_raw UNION ALL SELECT * FROM catalogue_raw WHERE CAST(substr(rsID, 3) AS BIGINT) % 3 = 0
UNION ALL SELECT chr, pos - 7, rsID, ref, alt, q1, q2, 'moved' FROM catalogue_raw WHERE CAST(substr(rsID, 3) AS BIGINT) % 5 = 0""",
    "catalogue_moved": _catalogue("catalogue_more"),
    "lookup": "SELECT DISTINCT chr, pos, rsID FROM catalogue",
    "lookup_newer": "SELECT DISTINCT chr, pos, rsID FROM newer",
    "lookup_min": "SELECT chr, pos, min(rsID) AS rsID FROM catalogue GROUP BY chr, pos",
    "refreshed": _refreshed("", "lookup"),
    "refreshed_keep": _refreshed("LEFT", "lookup"),
    "refreshed_min": _refreshed("", "lookup_min"),
    "refreshed_keep_min": _refreshed("LEFT", "lookup_min"),
    "codes": _codes("refreshed"),
    "codes_phased": _codes("refreshed", phased=True),
    "codes_quality": _codes("(SELECT * FROM refreshed WHERE TRY_CAST(qual AS DOUBLE) >= 30)"),
    "codes_pass": _codes("(SELECT * FROM refreshed WHERE filter = 'PASS')"),
    "codes_keep": _codes("refreshed_keep"),
    "codes_min": _codes("refreshed_keep_min"),
    "overlap_samples": inputs.OVERLAP_SAMPLES,
    "overlap_sites": inputs.OVERLAP_SITES,
    "overlap_ids": """
SELECT sample_name, row_number() OVER (ORDER BY source, s_suppkey) - 1 AS sample
FROM (SELECT sample_name, s_suppkey, min(source) AS source FROM overlap_samples GROUP BY sample_name, s_suppkey) a""",
    "gt_overlap": f"SELECT s.k, p.source, i.sample, p.sample_name, {inputs.call_sql('s.k', 's_suppkey')} AS gt FROM sites s JOIN overlap_sites o ON s.k = o.k JOIN overlap_samples p ON o.source = p.source JOIN overlap_ids i ON p.sample_name = i.sample_name",
    "codes_overlap": _codes("refreshed").replace("JOIN gt g", "JOIN gt_overlap g"),
    "sparse_overlap": _sparse("codes_overlap"),
    "sparse": _sparse("codes"),
    "sparse_phased": _sparse("codes_phased"),
    "sparse_quality": _sparse("codes_quality"),
    "sparse_pass": _sparse("codes_pass"),
    "sparse_keep": _sparse("codes_keep"),
    "sparse_min": _sparse("codes_min"),
    "codes_split": "SELECT * FROM codes UNION ALL SELECT * FROM codes WHERE alt LIKE '%,%'",
    "sparse_split": _sparse("codes_split"),
    "alleles": "SELECT DISTINCT rsID, CAST(unnest(range(len(l))) AS INT) AS code, unnest(l) AS allele FROM (SELECT rsID, string_split(ref || ',' || alt, ',') AS l FROM refreshed) a",
    "alleles_min": "SELECT DISTINCT rsID, CAST(unnest(range(len(l))) AS INT) AS code, unnest(l) AS allele FROM (SELECT rsID, string_split(ref || ',' || alt, ',') AS l FROM refreshed_min) a",
    "code_map": "SELECT DISTINCT a.rsID, a.code AS file_code, c.code FROM alleles a JOIN catalogue c ON a.rsID = c.rsID AND a.allele = c.allele",
    "code_map_min": "SELECT DISTINCT a.rsID, a.code AS file_code, c.code FROM alleles_min a JOIN catalogue c ON a.rsID = c.rsID AND a.allele = c.allele",
    "recoded": "SELECT s.sample, s.sample_name, s.rsID, s.chr, s.pos, coalesce(m.code, 0) AS code, s.dose FROM sparse s LEFT JOIN code_map m ON s.rsID = m.rsID AND s.code = m.file_code",
    "gwas_raw": inputs.ASSOCIATIONS_RAW,
    "gwas": f"""
SELECT CAST(snp_id_current AS BIGINT) AS rsID, rallele AS alt, CAST(or_or_beta AS DOUBLE) AS "OR",
 CAST({_CHR.format(c="coalesce(chr_id, regexp_extract(snps, 'chr([0-9XYM]+):([0-9]+)', 1))")} AS INT) AS chr,
 CAST(coalesce(chr_pos, regexp_extract(snps, 'chr([0-9XYM]+):([0-9]+)', 2)) AS BIGINT) AS pos,
 disease_trait AS trait, CAST(date_added AS DATE) AS date, CAST(pubmedid AS BIGINT) AS pubmedID
FROM gwas_raw WHERE CAST(or_or_beta AS DOUBLE) > 0""",
    "filled": _fill("coalesce(g.rsID, l.rsID)"),
    "filled_over": _fill("l.rsID"),
    "filled_two": _unique(
        """SELECT coalesce(g.rsID, l.rsID, n.rsID) AS rsID, g.alt, g."OR", g.trait, g.date, g.pubmedID
 FROM gwas g LEFT JOIN lookup l ON g.chr = l.chr AND g.pos = l.pos LEFT JOIN lookup_newer n ON g.chr = n.chr AND g.pos = n.pos""",
        'trait, rsID, alt, "OR", pubmedID, date',
        "",
    ),
    "filled_gaps": 'SELECT rsID, alt, "OR", chr, CASE WHEN rsID % 5 <> 0 THEN pos END AS pos, trait, CASE WHEN pubmedID % 2 <> 0 THEN date END AS date, pubmedID FROM filled',
    "coded_gaps": 'SELECT f.*, c.code FROM filled_gaps f JOIN catalogue c ON f.rsID = c.rsID AND f.alt = c.allele WHERE f.chr IS NOT NULL AND f.pos IS NOT NULL AND f.date IS NOT NULL AND f.pubmedID IS NOT NULL AND f."OR" IS NOT NULL AND f.trait IS NOT NULL',
    "coded": 'SELECT f.*, c.code FROM filled f JOIN catalogue c ON f.rsID = c.rsID AND f.alt = c.allele WHERE f.chr IS NOT NULL AND f.pos IS NOT NULL AND f.date IS NOT NULL AND f.pubmedID IS NOT NULL AND f."OR" IS NOT NULL AND f.trait IS NOT NULL',
    "coded_two": 'SELECT f.*, c.code FROM filled_two f JOIN catalogue c ON f.rsID = c.rsID AND f.alt = c.allele WHERE f.date IS NOT NULL AND f.pubmedID IS NOT NULL AND f."OR" IS NOT NULL AND f.trait IS NOT NULL',
    "weights": 'SELECT DISTINCT f.rsID, f.alt, f."OR", f.chr, f.pos, f.trait, f.date, f.pubmedID, coalesce(m.file_code, 0) AS code FROM coded f LEFT JOIN code_map m ON f.rsID = m.rsID AND f.code = m.code',
    "weights_two": 'SELECT DISTINCT f.rsID, f.alt, f."OR", f.trait, f.date, f.pubmedID, coalesce(m.file_code, 0) AS code FROM coded_two f LEFT JOIN code_map_min m ON f.rsID = m.rsID AND f.code = m.code',
    "scores": """
SELECT s.sample_name, s.prs_score, s.trait, s.pubmedID, d.date
FROM (SELECT sample_name, trait, pubmedID, CAST(sum(dose * "OR") AS DOUBLE) AS prs_score
 FROM sparse JOIN weights ON sparse.rsID = weights.rsID AND sparse.code = weights.code AND sparse.code > 0
 GROUP BY sample_name, trait, pubmedID) s
JOIN (SELECT DISTINCT trait, pubmedID, date FROM weights) d ON s.trait = d.trait AND s.pubmedID = d.pubmedID""",
    "variants": "SELECT rsID, code, n, key, row_number() OVER (ORDER BY n DESC, key) - 1 AS i FROM (SELECT rsID, code, count(*) AS n, rsID || ':' || code AS key FROM sparse GROUP BY rsID, code) a",
    "variants_min": "SELECT rsID, code, row_number() OVER (ORDER BY n DESC, key) - 1 AS i FROM (SELECT rsID, code, count(*) AS n, rsID || ':' || code AS key FROM sparse_min WHERE rsID IS NOT NULL GROUP BY rsID, code) a",
    "traits": "SELECT trait, pubmedID, n, key, row_number() OVER (ORDER BY n DESC, key) - 1 AS j FROM (SELECT trait, pubmedID, count(*) AS n, trait || '|' || pubmedID AS key FROM weights GROUP BY trait, pubmedID) a",
    "traits_two": "SELECT trait, pubmedID, row_number() OVER (ORDER BY n DESC, key) - 1 AS j FROM (SELECT trait, pubmedID, count(*) AS n, trait || '|' || pubmedID AS key FROM weights_two GROUP BY trait, pubmedID) a",
}


def with_inputs(body: str) -> str:
    """``body`` after a WITH clause of the parts it needs, in order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)}\n{body.strip()}"


_SITE = "source, contig, chr, pos, oldID, rsID, ref, alt"
_SPARSE = "sample, sample_name, rsID, chr, pos, code, dose"
_GWAS = 'rsID, alt, "OR", chr, pos, trait, date, pubmedID'

BODIES = {
    "vcf_header_samples": "SELECT source, CAST(position AS INT) AS position, sample_name FROM sample_ids",
    "vcf_header_columns": "SELECT source, 'CHROM,POS,ID,REF,ALT,QUAL,FILTER,INFO,FORMAT,' || string_agg(sample_name, ',' ORDER BY position) AS columns FROM sample_ids GROUP BY source",
    "vcf_scan_fixed_columns": """
SELECT p.source, contig, chr, pos, id, ref, alt, qual, filter, n_calls, calls FROM placed p
JOIN (SELECT k, CAST(count(*) AS INT) AS n_calls, string_agg(gt, ',' ORDER BY position) AS calls FROM gt GROUP BY k) g ON p.k = g.k""",
    "vcf_from_blocks": """
SELECT p.source, contig, chr, pos, id, ref, alt, qual, filter, n_calls AS n_samples, n_calls, calls FROM placed p
JOIN (SELECT k, CAST(count(*) AS INT) AS n_calls, string_agg(gt, ',' ORDER BY position) AS calls FROM gt GROUP BY k) g ON p.k = g.k""",
    "vcf_merge_by_name": """
SELECT i.sample_name, t.sites, n.present, t.sites - n.present AS absent
FROM sample_ids i JOIN (SELECT source, count(*) AS present FROM sites GROUP BY source) n ON i.source = n.source
JOIN (SELECT count(*) AS sites FROM sites) t ON 1 = 1""",
    "vcf_overlapping_files": """
SELECT sample_name, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS present, any_value(total) - CAST(coalesce(sum(n), 0) AS BIGINT) AS absent
FROM overlap_samples p LEFT JOIN (SELECT source, count(*) AS n FROM overlap_sites GROUP BY source) s ON p.source = s.source
JOIN (SELECT count(*) AS total FROM overlap_sites) t ON 1 = 1 GROUP BY sample_name""",
    "sparse_overlapping_files": f"SELECT {_SPARSE} FROM sparse_overlap",
    "tables_merge_by_name": """
SELECT chr, pos, rsID, code, allele, annot FROM catalogue
UNION ALL SELECT chr, pos, rsID, code, allele, NULL FROM newer""",
    "vcf_row_cap_count": """
SELECT kind, LEAST(count(*), 1000) AS n FROM (SELECT CASE WHEN contig IN ('X', 'Y', 'M') THEN 'other' ELSE 'autosome' END AS kind FROM sites) a GROUP BY kind""",
    "catalogue_alleles": "SELECT * FROM catalogue",
    "catalogue_from_files": "SELECT * FROM catalogue",
    "wide_panel": f"SELECT {_SPARSE} FROM sparse",
    "chrom_codes": f"""
SELECT k, {_CHR.format(c='contig')} AS named, {_CHR.format(c='number')} AS strict, CAST(number AS INT) AS lenient
FROM (SELECT k, contig, CAST(k % 40 AS VARCHAR) AS number FROM sites) a""",
    "accession_codes": """
SELECT rsID AS record, CAST(CASE WHEN n BETWEEN 1 AND 24 THEN n WHEN n = 12920 THEN 25 END AS INT) AS code
FROM (SELECT rsID, TRY_CAST(regexp_extract(chr, 'NC_0+(\\d+).', 1) AS INT) AS n FROM catalogue_raw) a""",
    "rsid_refresh_inner": f"SELECT {_SITE} FROM refreshed",
    "rsid_refresh_keep": f"SELECT {_SITE} FROM refreshed_keep",
    "rsid_refresh_min": f"SELECT {_SITE} FROM refreshed_min",
    "rsid_change_audit": "SELECT contig, pos, oldID, rsID, ref, alt FROM refreshed_keep WHERE oldID <> 'rs' || rsID",
    "rsid_change_audit_known": "SELECT contig, pos, oldID, rsID, ref, alt FROM refreshed_keep WHERE oldID <> 'rs' || rsID AND oldID <> '.'",
    "allele_code_map": "SELECT * FROM code_map",
    "split_site_report": "SELECT source, contig, pos, ref, CAST(2 AS BIGINT) AS n FROM sites WHERE alt LIKE '%,%'",
    "sparse_default": f"SELECT {_SPARSE} FROM sparse",
    "sparse_phased_only": f"SELECT {_SPARSE} FROM sparse_phased",
    "sparse_subfields": f"SELECT {_SPARSE} FROM sparse",
    "sparse_min_quality": f"SELECT {_SPARSE} FROM sparse_quality",
    "sparse_pass_only": f"SELECT {_SPARSE} FROM sparse_pass",
    "sparse_keep_unmatched": f"SELECT {_SPARSE} FROM sparse_keep",
    "sparse_repeated_sites": f"SELECT {_SPARSE} FROM sparse_split",
    "sparse_unmerged_sites": f"SELECT {_SPARSE} FROM sparse UNION ALL SELECT {_SPARSE} FROM sparse s WHERE EXISTS (SELECT 1 FROM refreshed r WHERE r.rsID = s.rsID AND r.alt LIKE '%,%')",
    "sparse_recode": f"SELECT {_SPARSE} FROM recoded",
    "sparse_with_allele": "SELECT s.*, a.allele FROM sparse s LEFT JOIN alleles a ON s.rsID = a.rsID AND s.code = a.code",
    "dense_to_coordinates": """
SELECT sample, rsID, 1 AS haplotype, a AS code FROM codes WHERE a > 0
UNION ALL SELECT sample, rsID, 2, b FROM codes WHERE b > 0""",
    "gwas_clean": f"SELECT {_GWAS} FROM gwas",
    "gwas_from_files": f"SELECT {_GWAS} FROM gwas",
    "gwas_any_null": f"SELECT {_GWAS}, code FROM coded_gaps",
    "indexed_weights": 'SELECT CAST(v.i AS BIGINT) AS i, CAST(t.j AS BIGINT) AS j, w."OR" FROM weights w JOIN variants v ON w.rsID = v.rsID AND w.code = v.code JOIN traits t ON w.trait = t.trait AND w.pubmedID = t.pubmedID',
    "score_product": """
SELECT sample, CAST(t.j AS BIGINT) AS trait, CAST(sum(dose * "OR") AS DOUBLE) AS score
FROM sparse s JOIN weights w ON s.rsID = w.rsID AND s.code = w.code JOIN traits t ON w.trait = t.trait AND w.pubmedID = t.pubmedID
GROUP BY sample, t.j""",
    "sparse_bucketed": f"SELECT {_SPARSE} FROM recoded",
    "rsid_refresh_bucketed_keep": f"SELECT {_SITE} FROM refreshed_keep",
    "gwas_code_bucketed": f"SELECT {_GWAS}, code FROM coded",
    "catalogue_conflicts": "SELECT * FROM catalogue_moved",
    "gwas_fill_keep": f"SELECT {_GWAS} FROM filled",
    "gwas_fill_overwrite": f"SELECT {_GWAS} FROM filled_over",
    "gwas_fill_two_assemblies": "SELECT * FROM filled_two",
    "gwas_code": f"SELECT {_GWAS}, code FROM coded",
    "gwas_recode": f"SELECT {_GWAS}, code FROM weights",
    "gwas_in_panel": f"SELECT {_GWAS}, code FROM weights w WHERE EXISTS (SELECT 1 FROM sparse s WHERE s.rsID = w.rsID AND s.code = w.code)",
    "prs": "SELECT * FROM scores",
    "prs_coordinates": """
SELECT sample, CAST(j AS BIGINT) AS trait, CAST(sum(dose * "OR") AS DOUBLE) AS score
FROM sparse_min s JOIN variants_min v ON s.rsID = v.rsID AND s.code = v.code
JOIN weights_two w ON w.rsID = v.rsID AND w.code = v.code AND w.code > 0
JOIN traits_two t ON t.trait = w.trait AND t.pubmedID = w.pubmedID
GROUP BY sample, j""",
    "variant_ids": "SELECT * FROM variants",
    "trait_ids": "SELECT * FROM traits",
    "gwas_trait_ids": f'SELECT {", ".join("w." + c.strip() for c in _GWAS.split(","))}, w.code, t.j AS "traitID" FROM weights w JOIN traits t ON w.trait = t.trait AND w.pubmedID = t.pubmedID',
    "score_lookup": "SELECT * FROM scores WHERE sample_name = 'Supplier#000000007' AND pubmedID = 25000001 AND prs_score > 1.0",
    "record_counts": """
SELECT 'associations' AS name, count(*) AS n FROM gwas
UNION ALL SELECT 'catalogue', count(*) FROM catalogue
UNION ALL SELECT 'panel', count(*) FROM sites""",
    "sink_parquet_roundtrip": f"SELECT {_SPARSE} FROM sparse",
    "sink_tsv_roundtrip": "SELECT * FROM scores",
    "sink_panel_roundtrip": f"SELECT {_SPARSE} FROM sparse",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_inputs(body) for name, body in BODIES.items()}
