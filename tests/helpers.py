"""Small hand-written panels."""

from dosegrid.sources import panel_from_lines

FIXED = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def lines(spark, files):
    """{file: (samples, [site fields + calls])} as (source, value) rows."""
    rows = []
    for source, (samples, sites) in files.items():
        rows.append((source, "##fileformat=VCFv4.2"))
        rows.append((source, "\t".join([FIXED, *samples])))
        rows += [(source, "\t".join(map(str, site))) for site in sites]
    return spark.createDataFrame(rows, "source string, value string")


def site(chrom, pos, calls, ref="A", alt="C,G", qual="50", filter="PASS", id="."):
    return [chrom, pos, id, ref, alt, qual, filter, ".", "GT", *calls]


def panel(spark, files):
    return panel_from_lines(lines(spark, files))


def catalogue(spark, rows):
    """(chr, pos, rsID, code, allele) rows."""
    return spark.createDataFrame(
        [(*row, "x") for row in rows],
        "chr int, pos long, rsID long, code int, allele string, annot string",
    )


def associations(spark, rows):
    """(rsID, alt, OR, chr, pos, trait, date text, pubmedID) rows."""
    table = spark.createDataFrame(
        rows,
        "rsID long, alt string, OR double, chr int, pos long, trait string, "
        "date string, pubmedID long",
    )
    return table.withColumn("date", table.date.cast("date"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))
