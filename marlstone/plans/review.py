"""Review of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import passages, review, spelling
from marlstone.plans.base import query
from marlstone.plans.texts import PARAGRAPHS
from marlstone.session import spread, table

#: Stand-ins for misspellings and limits, of words that the documents hold.
PAIRS = {"stupid": "unwise", "worthless": "poor"}
RULES = (("license_version", "ersion", "", "<=", 2.5),)

TYPO_SQL = """typo AS (SELECT doc_id, paragraph_index, original, corrected FROM p, (VALUES ('stupid', 'unwise'), ('worthless', 'poor')) t(original, corrected) WHERE contains(content, original))"""
REPEAT_SQL = """repeats AS (SELECT doc_id, paragraph_index, sentence, count(*) AS times FROM
  (SELECT doc_id, paragraph_index, trim(unnest(string_split_regex(content, '[。！？.!?]')), ' ') AS sentence FROM p) WHERE length(sentence) > 1 GROUP BY ALL HAVING count(*) > 1)"""
RULE_SQL = """broken AS (SELECT doc_id, paragraph_index, v AS value FROM
  (SELECT doc_id, paragraph_index, CAST(unnest(regexp_extract_all(content, 'ersion[^0-9。]{0,12}([0-9]+(?:\\.[0-9]+)?)\\s*', 1)) AS DOUBLE) AS v FROM p WHERE contains(content, 'ersion')) WHERE v > 2.5)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.split_paragraphs(spread(table(spark, sf_dir, "documents")))


@query(f"WITH {PARAGRAPHS}, {TYPO_SQL} SELECT *, 'misspelling' AS reason FROM typo")
def typo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.typos(_paragraphs(spark, sf_dir), PAIRS)


@query(f"WITH {PARAGRAPHS} SELECT * FROM (SELECT doc_id, paragraph_index, unnest(regexp_extract_all(content, '[^。！？.!?]+[。！？.!?]?')) AS original, 'long sentence' AS issue FROM p) WHERE length(original) > 80")
def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.long_sentences(_paragraphs(spark, sf_dir))


@query(f"WITH {PARAGRAPHS}, {REPEAT_SQL} SELECT * FROM repeats")
def dup_within_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.repeated_sentences(_paragraphs(spark, sf_dir))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS class_size FROM documents")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.exact_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, paragraph_index, min(paragraph_index) OVER w AS class_id, count(*) OVER w AS class_size FROM p WINDOW w AS (PARTITION BY doc_id, content)")
def dup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.exact_classes(_paragraphs(spark, sf_dir), "paragraph_index", "content", ["doc_id"])


@query(
    f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, content, min(paragraph_index) AS i FROM p GROUP BY doc_id, content),
w AS (SELECT doc_id, i, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT doc_id, i, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, i, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY doc_id, i),
b AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS common FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i GROUP BY ALL)
SELECT b.doc_id, b.i AS paragraph_index_1, b.j AS paragraph_index_2, round(common / (x.n + y.n - common), 6) AS similarity
FROM b JOIN n x ON x.doc_id = b.doc_id AND x.i = b.i JOIN n y ON y.doc_id = b.doc_id AND y.i = b.j WHERE common * 100 >= (x.n + y.n - common) * 80"""
)
def dup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.near_pairs(_paragraphs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {PARAGRAPHS}, d AS (SELECT doc_id, content, min(paragraph_index) AS i FROM p GROUP BY doc_id, content),
w AS (SELECT doc_id, i, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT doc_id, i, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, i, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY doc_id, i),
b AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS common FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i <> b.i GROUP BY ALL),
link AS (SELECT b.doc_id, b.i, b.j FROM b JOIN n x ON x.doc_id = b.doc_id AND x.i = b.i JOIN n y ON y.doc_id = b.doc_id AND y.i = b.j WHERE common * 100 >= (x.n + y.n - common) * 80),
reach AS (SELECT doc_id, i AS x, i AS y FROM d UNION SELECT r.doc_id, r.x, l.j FROM reach r JOIN link l ON l.doc_id = r.doc_id AND l.i = r.y),
least AS (SELECT doc_id, x, min(y) AS class_id FROM reach GROUP BY doc_id, x)
SELECT p.doc_id, p.paragraph_index, class_id, count(*) OVER (PARTITION BY p.doc_id, class_id) AS class_size FROM p JOIN d ON d.doc_id = p.doc_id AND d.content = p.content JOIN least ON least.doc_id = p.doc_id AND x = d.i"""
)
def dup_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_classes(spread(table(spark, sf_dir, "documents")))


@query(f"WITH {PARAGRAPHS}, {RULE_SQL} SELECT doc_id, paragraph_index, value, 'license_version' AS reference, '<= 2.5 ' AS suggestion FROM broken")
def compliance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.compliance(_paragraphs(spark, sf_dir), RULES)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, from one pass over the paragraphs."""
    return review.numbered_findings(review.scan(_paragraphs(spark, sf_dir), PAIRS, RULES))


CHANGES_SQL = f"""WITH {PARAGRAPHS}, {TYPO_SQL}, {REPEAT_SQL}, {RULE_SQL}, u AS (
  SELECT doc_id, paragraph_index, original, corrected, 'typo' AS type, 0 AS phase FROM typo
  UNION ALL BY NAME SELECT doc_id, paragraph_index, sentence AS original, 'duplicate' AS type, 2 AS phase FROM repeats
  UNION ALL BY NAME SELECT doc_id, paragraph_index, CAST(value AS VARCHAR) AS original, 'compliance' AS type, 3 AS phase FROM broken),
c AS (SELECT CAST(row_number() OVER (PARTITION BY doc_id ORDER BY phase, paragraph_index, corrected NULLS FIRST, original) AS INTEGER) AS id, doc_id, type, type AS category, paragraph_index, original, corrected FROM u)"""


@query(CHANGES_SQL + " SELECT * FROM c")
def change_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("id", "doc_id", "type", "category", "paragraph_index", "original", "corrected")


@query(
    CHANGES_SQL
    + """ SELECT doc_id, count(*) AS total_changes, count(*) FILTER (type = 'typo') AS typo_count, CAST(0 AS BIGINT) AS fluency_count,
count(*) FILTER (type = 'duplicate') AS duplicate_count, count(*) FILTER (type = 'compliance') AS compliance_count FROM c GROUP BY doc_id"""
)
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts(_changes(spark, sf_dir))


REPLACE = "CASE WHEN contains({0}, '{1}') THEN substr({0}, 1, instr({0}, '{1}') - 1) || '{2}' || substr({0}, instr({0}, '{1}') + {3}) ELSE {0} END"


@query(
    f"""WITH a AS (SELECT doc_id, text, {REPLACE.format("text", "stupid", "unwise", 6)} AS t1 FROM documents),
b AS (SELECT doc_id, text, t1, {REPLACE.format("t1", "worthless", "poor", 9)} AS t2 FROM a)
SELECT doc_id, t2 AS revised, CAST(contains(text, 'stupid') AS BIGINT) + CAST(contains(t1, 'worthless') AS BIGINT) AS applied,
2 - CAST(contains(text, 'stupid') AS BIGINT) - CAST(contains(t1, 'worthless') AS BIGINT) AS failed, CAST(4 AS BIGINT) AS total_accepted FROM b"""
)
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = [(1, "typo", "stupid", "unwise"), (2, "fluency", "worthless", "poor"), (3, "duplicate", "the", "THE"), (4, "typo", "", "x"), (5, "typo", "and", "AND")]
    each = lambda rows, shape: docs.select("doc_id", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, shape, strict=True))) for r in rows))).alias("c")).select("doc_id", "c.*")
    changes = each(known, ("id", "type", "original", "replacement"))
    accepted = each([(1,), (2,), (3,), (4,)], ("id",))
    return review.apply_changes(docs, changes, accepted).drop("text")


@query(f"WITH {PARAGRAPHS}, {TYPO_SQL} SELECT t.doc_id, t.original, instr(text, t.original) - 1 AS start, instr(text, t.original) - 1 + length(t.original) AS \"end\" FROM (SELECT DISTINCT doc_id, original FROM typo) t JOIN documents d USING (doc_id)")
def comparison_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = review.typos(_paragraphs(spark, sf_dir), PAIRS).select("doc_id", "original").distinct()
    return review.marked_spans(table(spark, sf_dir, "documents"), changes)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


ALL_LIMITS = " UNION ALL BY NAME ".join(
    f"""SELECT doc_id, paragraph_index, v AS value, '{rule}' AS reference, '{relation} {limit:g} {unit}' AS suggestion FROM (SELECT doc_id, paragraph_index,
  CAST(unnest(regexp_extract_all(content, '{term}[^0-9。]{{0,12}}([0-9]+(?:\\.[0-9]+)?)\\s*{unit}', 1)) AS DOUBLE) AS v FROM p WHERE contains(content, '{term}')) WHERE NOT v {relation} {limit}"""
    for rule, term, unit, relation, limit in review.LIMITS
)


@query(
    f"""WITH {PARAGRAPHS}, {REPEAT_SQL}, u AS (
  SELECT doc_id, paragraph_index, original, corrected, 'misspelling' AS reason, 'typo' AS type, 0 AS phase FROM p, (VALUES {_values(review.TYPOS.items())}) t(original, corrected) WHERE contains(content, original)
  UNION ALL BY NAME SELECT *, 'fluency' AS type, 1 AS phase FROM (SELECT doc_id, paragraph_index, unnest(regexp_extract_all(content, '[^。！？.!?]+[。！？.!?]?')) AS original, 'long sentence' AS issue FROM p) WHERE length(original) > 80
  UNION ALL BY NAME SELECT doc_id, paragraph_index, sentence AS original, 'remove the repetition' AS suggestion, 'duplicate' AS type, 2 AS phase FROM repeats
  UNION ALL BY NAME SELECT *, 'compliance' AS type, 3 AS phase FROM ({ALL_LIMITS}))
SELECT CAST(row_number() OVER (PARTITION BY doc_id ORDER BY phase, paragraph_index NULLS FIRST, corrected NULLS FIRST, issue NULLS FIRST, original NULLS FIRST, reason NULLS FIRST, reference NULLS FIRST, suggestion NULLS FIRST, value NULLS FIRST) AS INTEGER) AS id,
  doc_id, paragraph_index, original, corrected, reason, issue, suggestion, value, reference, type, type AS category FROM u"""
)
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review(spread(table(spark, sf_dir, "documents")))


@query(
    f"""WITH {PARAGRAPHS}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) WHERE length(word) >= 5 GROUP BY word),
f AS (SELECT word, n, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS form, k FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM w WHERE n <= 2 OR n >= 60)),
m AS (SELECT a.word AS original, b.word AS corrected, b.n, CASE WHEN abs(a.k - b.k) = 1 AND least(a.k, b.k) > 0 AND substr(a.word, a.k, 1) = substr(b.word, b.k, 1) AND substr(a.word, b.k, 1) = substr(b.word, a.k, 1) THEN 'swapped'
    WHEN a.k = 0 AND b.k > 0 THEN 'left out' WHEN a.k > 0 AND b.k = 0 THEN 'added' WHEN a.k = b.k AND a.k > 0 THEN 'mistaken' END AS slip
  FROM f a JOIN f b USING (form) WHERE a.n <= 2 AND b.n >= 60 AND b.n >= 60 * a.n),
c AS (SELECT original, corrected, slip FROM m WHERE slip IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY original ORDER BY round(ln(n) - CASE slip WHEN 'swapped' THEN 0 WHEN 'mistaken' THEN 0.7 ELSE 0.3 END, 9) DESC, corrected, slip) = 1)
SELECT doc_id, paragraph_index, original, corrected, 'letters ' || slip AS reason FROM (SELECT DISTINCT doc_id, paragraph_index, unnest(regexp_extract_all(lower(content), '\\p{{L}}+')) AS original FROM p) JOIN c USING (original)"""
)
def learned_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return spelling.learned(docs, review.split_paragraphs(docs), ratio=60.0)
