"""The corpus queries in DuckDB's SQL, over whole tables, where SQL can express them.

Tokenisers (op9, op11), the random field (op10) and the trained classifiers (op3,
op5) have none; tests hold them against brute force or held-out accuracy.
"""

from dosegrid.llm.url_filter import LIMIT, VOCABULARY

_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), windows AS (
    SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS window_text
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split)
), earlier AS (
    SELECT window_text, min(doc_id) AS first_id FROM windows GROUP BY window_text
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS place
    FROM windows JOIN earlier USING (window_text) WHERE first_id < doc_id
), placed AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split
), marked AS (
    SELECT p.doc_id, p.word, p.place, g.place IS NOT NULL AS cut
    FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place
), texts AS (
    SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT cut), '') AS kept
    FROM marked GROUP BY doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM split s LEFT JOIN texts t USING (doc_id)
"""

_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH split AS (
    SELECT doc_id,
           regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_NORMAL}') AS words
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_NORMAL}') AS words
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), passages AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
           array_to_string(words[pos:pos + 9], ' ') AS passage
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos
          FROM item_words WHERE len(words) > 0)
), sizes AS (
    SELECT DISTINCT size FROM passages
), windows AS (
    SELECT doc_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS passage
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
          FROM split, sizes WHERE len(words) >= size)
), found AS (
    SELECT doc_id, pos, w.size, item_id
    FROM windows w JOIN passages p ON w.passage = p.passage AND w.size = p.size
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP4 = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos
          FROM split WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS node, doc_id AS other FROM split
    UNION
    SELECT node, b FROM reached JOIN both_ways ON other = a
), component AS (
    SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       s.doc_id = component_id AS kept
FROM split s LEFT JOIN sizes z ON s.doc_id = z.doc_id JOIN component ON s.doc_id = node
"""

_OP6 = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), owners AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN owner END AS refers_to
FROM owners
"""

# The tree of op7: budgets of domains, then of languages, then of sources. A level is shared
# out by the height that each child would be filled to, and the fullest are taken first.
_OP7_LEVEL = """
{name}_nodes AS (
    SELECT {keys}, sum(capacity) AS capacity, any_value({weight}) AS weight,
           {budget} AS budget
    FROM leaves {join} GROUP BY {keys}
), {name}_ranked AS (
    SELECT *, capacity / weight AS ratio,
           (budget - coalesce(sum(capacity) OVER (
               {parent} ORDER BY capacity / weight, {level}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (
               {parent} ORDER BY capacity / weight, {level}
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reached
    FROM {name}_nodes
), {name}_open AS (
    SELECT *, first_value(CASE WHEN ratio > reached THEN reached END IGNORE NULLS) OVER (
        {parent} ORDER BY ratio, {level}
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS height
    FROM {name}_ranked
), {name} AS (
    SELECT {keys}, CASE WHEN height IS NULL THEN capacity
        ELSE least(capacity, floor(height * weight)) END::BIGINT AS budget
    FROM {name}_open
)"""

_OP7 = rf"""
WITH rated AS (
    SELECT doc_id, lang, source,
           CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7',
                                'src8', 'src9', 'src10', 'src11') THEN 'web'
                WHEN source IN ('src12', 'src13', 'src14', 'src15') THEN 'books'
                WHEN source IN ('src16', 'src17', 'src18') THEN 'reference'
                ELSE 'other' END AS domain,
           coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s,
           len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens
    FROM documents
), sums AS (
    SELECT domain, l, s, sum(n_tokens)::BIGINT AS tokens, (4 * sum(n_tokens))::BIGINT AS capacity
    FROM rated GROUP BY domain, l, s
), leaves AS (
    SELECT *, CASE domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'books' THEN 0.3::DOUBLE
                          WHEN 'reference' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS domain_weight,
           CASE l WHEN 'en' THEN 0.55::DOUBLE WHEN 'de' THEN 0.15::DOUBLE
                  WHEN 'fr' THEN 0.15::DOUBLE WHEN 'es' THEN 0.15::DOUBLE
                  ELSE 0.05::DOUBLE END AS l_weight,
           CASE s WHEN 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS s_weight
    FROM sums
), {_OP7_LEVEL.format(
    name="one", keys="domain", level="domain", weight="domain_weight", parent="", join="",
    budget="(SELECT floor(sum(tokens) * 0.5) FROM sums)",
).strip()}, {_OP7_LEVEL.format(
    name="two", keys="domain, l", level="l", weight="l_weight", parent="PARTITION BY domain",
    join="JOIN one USING (domain)", budget="any_value(one.budget)",
).strip()}, {_OP7_LEVEL.format(
    name="three", keys="domain, l, s", level="s", weight="s_weight",
    parent="PARTITION BY domain, l", join="JOIN two USING (domain, l)",
    budget="any_value(two.budget)",
).strip()}, plan AS (
    SELECT domain, l, s, three.budget // tokens AS epochs, three.budget % tokens AS rest
    FROM three JOIN sums USING (domain, l, s) WHERE tokens > 0
), placed AS (
    SELECT r.*, epochs, rest,
           ('0x' || substr(md5('11:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS place
    FROM rated r JOIN plan USING (domain, l, s)
), summed AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place) AS upto FROM placed
)
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM summed WHERE epochs > 0 OR (rest > 0 AND upto <= rest)
"""


def _bounded(term: str) -> str:
    return f"regexp_matches(folded, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_WEIGHT = " + ".join(f"{_bounded(t)}::INT * {w}" for t, w in sorted(VOCABULARY.items()))


_OP8 = rf"""
WITH parts AS (
    SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS folded,
           CASE WHEN contains(url, '://')
                THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*$', '')
                ELSE '' END AS place
    FROM pages
), hosts AS (
    SELECT page_id, folded, {_LOWER.format("split_part(place, '/', 1)")} AS host,
           substr(place, length(split_part(place, '/', 1)) + 1) AS path
    FROM parts
), ruled AS (
    SELECT *, '.' || host AS dotted,
           CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/')
                    THEN 'www.example.com/en/'
                WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/')
                    THEN 'example.com/en/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
           END AS rule
    FROM hosts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN {_WEIGHT} >= {LIMIT} THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

# op12: the checksum byte by byte (reflected polynomial 0xEDB88320), then equal words with one
# character left out. A letter from À on has two bytes, 195 and its code point less 64.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

_OP12 = rf"""
WITH RECURSIVE bits AS (
    SELECT b AS start, b::BIGINT AS c, 0 AS done FROM range(256) t(b)
    UNION ALL
    SELECT start, {_CRC_STEP}, done + 1 FROM bits WHERE done < 8
), crc_table AS (
    SELECT list(c ORDER BY start) AS steps FROM bits WHERE done = 8
), found AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
           unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), distinct_runs AS (
    SELECT head, run, count(*) AS times FROM found GROUP BY head, run
), summed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(
            list_transform(string_split(head || run, ''), lambda s: unicode(s)::BIGINT),
            lambda u: CASE WHEN u < 128 THEN [u] ELSE [195::BIGINT, u - 64] END))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
    FROM distinct_runs, crc_table
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT)
                || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times
    FROM summed
), counted AS (
    SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 5
    GROUP BY word HAVING sum(times) >= 3
), shorter AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counted)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT s.word, c.word, c.n FROM shorter s JOIN counted c ON s.rest = c.word
    UNION
    SELECT c.word, s.word, s.n FROM shorter s JOIN counted c ON s.rest = c.word
), rated AS (
    SELECT word, count(*) AS n_near, max(other_n) AS best_n,
           arg_min(other, (-other_n, other)) AS best
    FROM near GROUP BY word
), formed AS (
    SELECT c.word, c.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN best_n >= 2 * c.n THEN best END AS form,
           CASE WHEN best_n >= 2 * c.n THEN best_n END AS form_n
    FROM counted c LEFT JOIN rated r ON c.word = r.word
), followed AS (
    SELECT word, word AS at FROM formed
    UNION ALL
    SELECT f.word, g.form FROM followed f JOIN formed g ON f.at = g.word WHERE g.form IS NOT NULL
), ends AS (
    SELECT f.word, f.at AS root FROM followed f JOIN formed g ON f.at = g.word WHERE g.form IS NULL
)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n
FROM formed f JOIN ends e ON f.word = e.word
"""

_OP13 = """
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
), reached AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT node, b FROM reached JOIN links ON other = a
), component AS (
    SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counted ON vec_id = a JOIN component ON vec_id = node
"""

ORACLE_SQL = {
    "op1_substring_dedup": _OP1,
    "op2_decontamination": _OP2,
    "op4_near_duplicates": _OP4,
    "op6_warc_archives": _OP6,
    "op7_source_mixing": _OP7,
    "op8_url_filter": _OP8,
    "op12_spelling_variants": _OP12,
    "op13_embedding_duplicates": _OP13,
}
