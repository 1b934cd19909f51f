"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from brindle.llm import mixing, packing
from brindle.llm.html_text import page_texts
from brindle.llm.language import identified
from brindle.llm.licenses import TEMPLATES, licensed
from brindle.llm.media import media_digests
from brindle.llm.near_dedup import near_duplicates
from brindle.llm.quality import classified
from brindle.llm.vector_dedup import near_vectors
from brindle.llm.warc import archived
from brindle.session import read_table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS items FROM w),
n AS (SELECT doc_id, len(items) AS n FROM s),
e AS (SELECT doc_id, unnest(items) AS item FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.x, r.reach FROM r JOIN g ON g.y = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query(NEAR_DUPLICATES_SQL)
def op5_minhash_near_dedup(spark, d):
    """Near-duplicate groups of all documents."""
    return near_duplicates(read_table(spark, d, "documents"))


@query()
def op2_language_id(spark, d):
    """The language of every document."""
    return identified(read_table(spark, d, "documents"))


@query()
def op9_quality_classifier(spark, d):
    """A quality score of every document."""
    return classified(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query()
def op4_best_fit_packing(spark, d):
    """All documents packed into sequences of 2048 words."""
    return packing.best_fit(packing.clustered(read_table(spark, d, "documents")))


MIXING_SQL = r"""
WITH RECURSIVE z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source)),
-- rounds of reshaping: the sources held at three times their size so far
f(round, held) AS (
    SELECT 0, CAST([] AS VARCHAR[])
    UNION ALL
    SELECT round + 1, list_concat(held, more) FROM (
        SELECT f.round, f.held, (
            SELECT coalesce(list(k.name), []) FROM (
                SELECT coalesce('s' || source, 'n') AS name, w * (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN list_contains(f.held, coalesce('s' || source, 'n')) THEN 3 * source_size END), 0) AS DOUBLE)
                    / nullif(sum(CASE WHEN list_contains(f.held, coalesce('s' || source, 'n')) THEN 0 ELSE w END), 0) FROM s) > 3 * source_size AS above
                FROM s WHERE NOT list_contains(f.held, coalesce('s' || source, 'n'))) k WHERE k.above) AS more
        FROM f) WHERE len(more) > 0),
h AS (SELECT held FROM f ORDER BY round DESC LIMIT 1),
l AS (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN list_contains(held, coalesce('s' || source, 'n')) THEN 3 * source_size END), 0) AS DOUBLE)
    / nullif(sum(CASE WHEN list_contains(held, coalesce('s' || source, 'n')) THEN 0 ELSE w END), 0) AS level FROM s, h),
t AS (SELECT source, source_size, CASE WHEN list_contains(held, coalesce('s' || source, 'n')) THEN CAST(3 * source_size AS DOUBLE) ELSE w * level END AS target FROM s, h, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT z.*, g.source_size, g.target, g.whole, greatest(CAST(floor(target + 0.5) AS BIGINT) - whole * source_size, 0) AS rest,
    sum(size) OVER (PARTITION BY z.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY z.source, h) AS unit
    FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN upto <= rest THEN size WHEN upto - unit < rest THEN floor(CAST(size * (rest - (upto - unit)) AS DOUBLE) / unit) ELSE 0 END AS BIGINT) AS taken FROM u
"""


@query(MIXING_SQL)
def op8_source_mixing(spark, d):
    """All documents mixed to weights 5, 2, 1."""
    return mixing.mixed_sizes(mixing.sized(read_table(spark, d, "documents")))


NEAR_VECTORS_SQL = """
WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM x
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
    AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.93 * a.n * b.n),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.x, r.reach FROM r JOIN l ON l.y = r.vec_id),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""


@query(NEAR_VECTORS_SQL)
def op6_embedding_near_dedup(spark, d):
    """Near-duplicate groups of all vectors, by label."""
    return near_vectors(read_table(spark, d, "embeddings"))


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op10_warc(spark, d):
    """All pages archived, normalized and read back."""
    return archived(read_table(spark, d, "pages"))


@query()
def op3_html_extraction(spark, d):
    """The visible text of all pages."""
    return page_texts(read_table(spark, d, "pages"))


@query()
def op7_media_columns(spark, d):
    """All documents stored as progressive JPEG files and read back."""
    return media_digests(read_table(spark, d, "documents"))


LICENSES_SQL = r"""
WITH t(license, text) AS (VALUES %s),
b AS (SELECT doc_id, NULL AS license, text FROM documents UNION ALL SELECT NULL, license, text FROM t),
w AS (SELECT doc_id, license, regexp_extract_all(translate(regexp_replace(text, '[.,;:()"'']', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM b WHERE text IS NOT NULL),
s AS (SELECT doc_id, license, unnest(range(0, len(words) - 4)) AS place, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, license, place, array_to_string(words[place + 1:place + 5], ' ') AS item FROM s),
n AS (SELECT license, count(DISTINCT item) AS shingles FROM k WHERE license IS NOT NULL GROUP BY license)
SELECT d.doc_id, i.license, count(DISTINCT d.item) AS found, n.shingles, min(d.place) AS word
FROM k d JOIN (SELECT DISTINCT license, item FROM k WHERE license IS NOT NULL) i ON d.item = i.item JOIN n ON n.license = i.license
WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id, i.license, n.shingles HAVING count(DISTINCT d.item) >= 0.75 * n.shingles
""" % ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())


@query(LICENSES_SQL)
def op1_license_scan(spark, d):
    """Licenses in all documents."""
    return licensed(read_table(spark, d, "documents"))
