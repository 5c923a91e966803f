"""Filtering of addresses by host rules and a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of unwanted addresses by topic, and the weight of each: one of a strict term is enough to
# reject, of the others it takes several different ones. The terms are common words of these
# trades; callers give their own table for their own sources.
LIMIT = 2.0
_STRICT = {
    "adult": "escort hentai milf porn porno sexcam xxx",
    "gambling": "casino roulette",
    "medicine": "cialis viagra",
}
_SOFT = {
    "adult": "adult cam dating erotic nude sex",
    "gambling": "bet bets betting bonus jackpot lottery poker slots",
    "medicine": "pharmacy pills replica",
    "spam": "ads cheap farm free loan payday spam torrent track warez win",
}
VOCABULARY: dict[str, float] = {
    **{term: LIMIT for terms in _STRICT.values() for term in terms.split()},
    **{term: 1.0 for terms in _SOFT.values() for term in terms.split()},
}

Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    place = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    host = F.substring_index(place, "/", 1)
    path = F.substr(place, F.length(host) + 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    own, slash, start = rule.partition("/")
    under = (host == own) | host.endswith(f".{own}")
    return under & path.startswith(slash + start)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule = F.when(_fits(host, path, name), name).otherwise(rule)
        verdict = F.when(_fits(host, path, name), says).otherwise(verdict)
    return rule, verdict


def _hits(vocabulary: Mapping[str, float], limit: float) -> Callable:
    """Distinct terms of each address that end and begin at a boundary, and the sum of their weights."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = ahocorasick.Automaton()
        for term in vocabulary:
            terms.add_word(term, term)
        terms.make_automaton()
        for batch in batches:
            found: list[list] = [[], [], []]
            for url in batch.column("url").to_pylist():
                text = f" {_folded(url or '')} "
                met = {
                    term
                    for end, term in (terms.iter(text) if len(terms) else ())
                    if not _inside(text[end + 1]) and not _inside(text[end - len(term)])
                }
                found[0].append(sorted(t for t in met if vocabulary[t] >= limit))
                found[1].append(sorted(t for t in met if vocabulary[t] < limit))
                found[2].append(float(sum(vocabulary[t] for t in sorted(met))))
            kinds = [pa.list_(pa.string())] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, found, kinds)],
                [*batch.schema.names, "strict_hits", "soft_hits", "weight"],
            )

    return hits


def _folded(url: str) -> str:
    """A-Z in lower case; all else keeps its length."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in url)


def _inside(character: str) -> bool:
    """Whether a word goes on here: ASCII letters and digits."""
    return character.isascii() and character.isalnum()


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    vocabulary: Mapping[str, float] = VOCABULARY,
    limit: float = LIMIT,
) -> DataFrame:
    """Judge every address.

    A rule is a host with a start of a path. It fits the host and all hosts
    below it, if the path starts so; of several, the longest decides. Without a
    rule the vocabulary does: all terms are found in one pass of an Aho-Corasick
    automaton and count where no ASCII letter or digit stands beside them. The
    weights of the different terms of an address are summed, and ``limit``
    blocks: one term of that weight (a strict one), or several soft ones. Terms
    are in lower case.

    Returns per row: page_id, host, path, rule, verdict (allow or block),
    strict_hits, soft_hits, weight. A null address, or one without ``://``, has an empty
    host and path, so no rule fits it. Only the address is read; one narrow pass.
    """
    host, path = address_parts(F.col("url"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), path.alias("path"))
    hits = "strict_hits array<string>, soft_hits array<string>, weight double"
    judged = parts.mapInArrow(
        _hits(dict(vocabulary), limit), f"page_id long, url string, host string, path string, {hits}"
    )
    own = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
        "strict_hits", "soft_hits", "weight",
    )
