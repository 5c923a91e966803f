import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs or whole rows."""

    def make(rows, schema=SCHEMA):
        full = [r if len(r) > 2 else (*r, "en", "s1", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def clashing(make_docs):
    """Add columns with the names that operators use for themselves."""
    from pyspark.sql import functions as F

    names = "n_words words spans kept node label cluster task batch bucket hits items keys p host path base url key place gone good labelled epochs cutoff mix_lang mix_key domain n_tokens copies text_hash row digest size owner".split()
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
