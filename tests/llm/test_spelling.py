"""Spelling variants against comparing all pairs of words."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dosegrid.llm import spelling
from dosegrid.llm.spelling import count_words, node_pairs, runs_of_letters, spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(counts):
    out = {}
    for word, n in counts.items():
        near = sorted((-m, w) for w, m in counts.items() if one_apart(word, w))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[word] = [form, word, n, len(near), counts[form] if form else None]
    for word in out:
        root = word
        while out[root][0]:
            root = out[root][0]
        out[word][1] = root
    return sorted((w, *v) for w, v in out.items())


def occurrences(spark, counts):
    rows = [(w, n) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, times int")
    return df.select("word", F.explode(F.sequence(F.lit(1), "times")).alias("nth"))


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def check(spark, counts):
    kept = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert got(spelling_variants(occurrences(spark, counts))) == plain(kept)


def test_planted(spark):
    check(
        spark,
        {
            "colour": 40, "color": 90, "colours": 20, "colou": 9, "kolour": 9, "coolour": 9,
            "aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "aaaab": 5, "baaaa": 5,
            "éclair": 12, "Éclair": 5, "eclair": 5, "short": 2, "abcd": 50, "abcde": 3,
            "letter": 30, "leter": 7, "lettter": 6, "lette": 60, "etter": 60, "xetter": 4,
        },
    )


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abz" if seed else "aé", k=rng.randint(4, 8))) for _ in range(300)]
    check(spark, {w: rng.choice([2, 3, 4, 7, 8, 16]) for w in words})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abcÀ", min_size=5, max_size=7), st.integers(3, 12), max_size=30))
def test_any_words(spark, counts):
    check(spark, counts)


def test_many_parts(spark):
    """Nodes that several sorted parts have keep one number."""
    rng = random.Random(5)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 9))): rng.randint(3, 30) for _ in range(200)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, words)
        counted = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
        numbered, pairs = node_pairs(counted)
        assert [r.word for r in numbered.orderBy("id").collect()] == sorted(words)
        at_gap = pairs.where("kind = 0").groupBy("prefix", "suffix").count()
        assert at_gap.where("count > 1").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_very_long_words(spark):
    long = "ab" * 20_000
    check(spark, {long: 9, long + "b": 4, long[:-1]: 30, "c" + long: 3, "c" * 30_000: 3})


def test_words_without_neighbours_give_few_pairs(spark):
    words = ["".join(chr(97 + (i * k) % 23) for k in range(5, 17)) for i in range(1, 20)]
    counted = spark.createDataFrame([(w, 3) for w in words], "word string, n long").coalesce(1)
    pairs = node_pairs(counted)[1]
    assert pairs.count() < sum(map(len, words))


def test_texts(spark, make_docs):
    docs = make_docs([(1, "Naïve NAÏVE x1y2z, naïve-naïve ÀÉÎ×"), (None, "abc DEF"), (2, None), (3, "")])
    counts = Counter(r.word for r in runs_of_letters(docs).collect())
    assert counts == {"naïve": 3, "naÏve": 1, "x": 1, "y": 1, "z": 1, "ÀÉÎ×": 1, "abc": 1, "def": 1}
    assert [tuple(r) for r in count_words(runs_of_letters(docs), 5, 3).collect()] == [("naïve", 3)]


def test_clashing_columns_and_nulls(spark):
    words = occurrences(spark, {"colour": 8, "color": 3})
    words = words.union(spark.createDataFrame([(None, 1)] * 4, "word string, nth int"))
    names = "id n nodes part first pre suf prefix suffix kind form root best n_near".split()
    out = got(spelling_variants(words.withColumns({c: F.lit("x") for c in names})))
    assert out == plain({"colour": 8, "color": 3})


def test_empty(spark):
    out = spelling_variants(spark.createDataFrame([], "word string"))
    assert out.columns == COLUMNS and out.count() == 0


def test_no_row_holds_a_pair_of_words(spark):
    """One hot bucket: all words differ in one place, and no join or list makes pairs of them."""
    words = {f"wo{chr(97 + i)}ds{t}": 3 + i for i in range(26) for t in ("", "x")}
    check(spark, words)
    counted = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    plan = spelling.neighbours(node_pairs(counted)[1])._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1].split("MapInArrow")[0]
    assert "collect_list" not in plan
