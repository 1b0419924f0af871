"""Dependencies of paragraphs with what a change reaches, and answers to the questions that documents raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import dependencies, review
from marlstone.operators.replies import Replies
from marlstone.plans import workflow
from marlstone.plans.base import ORACLES, query
from marlstone.plans.review import PAIRS, TYPO_SQL, _paragraphs
from marlstone.plans.texts import PARAGRAPHS
from marlstone.session import shared_path, spread, stored, table

EDGES_SQL = """t AS (SELECT DISTINCT doc_id, paragraph_index, term FROM (SELECT doc_id, paragraph_index, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM p) WHERE length(term) >= 4),
few AS (SELECT doc_id, term FROM t GROUP BY doc_id, term HAVING count(*) BETWEEN 2 AND 3),
e AS (SELECT a.doc_id, a.paragraph_index AS source, b.paragraph_index AS target, CASE WHEN count(*) >= 2 THEN 'strong' ELSE 'weak' END AS type, string_agg(a.term, ', ' ORDER BY a.term) AS impact
  FROM t a JOIN few USING (doc_id, term) JOIN t b ON b.doc_id = a.doc_id AND b.term = a.term AND b.paragraph_index > a.paragraph_index GROUP BY ALL)"""


@query(f"WITH {PARAGRAPHS}, {EDGES_SQL} SELECT * FROM e")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.edges(_paragraphs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {PARAGRAPHS}, {TYPO_SQL}, {EDGES_SQL},
both_ways AS (SELECT doc_id, source AS a, target AS b FROM e UNION ALL SELECT doc_id, target, source FROM e),
reach AS (SELECT DISTINCT doc_id, paragraph_index, 0 AS hops FROM typo UNION SELECT r.doc_id, b, hops + 1 FROM reach r JOIN both_ways USING (doc_id) WHERE a = r.paragraph_index AND hops < 3)
SELECT doc_id, paragraph_index, min(hops) AS hops FROM reach GROUP BY doc_id, paragraph_index"""
)
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that a corrected misspelling may touch, over three dependencies at most."""
    changed = stored(review.typos(_paragraphs(spark, sf_dir), PAIRS).select("doc_id", "paragraph_index").distinct())
    # no dependency leaves a document, so those of documents without a change reach nothing
    docs = spread(table(spark, sf_dir, "documents")).join(changed.select("doc_id").distinct(), "doc_id", "left_semi")
    return dependencies.reached(dependencies.edges(review.split_paragraphs(docs)), changed)


class _Quoting:
    """A client whose answers can be told from what it was asked."""

    def complete(self, prompt: str) -> str:
        context, _, question = prompt.rpartition("\n\nQuestion: ")
        return f"{question[:100]} ({len(context)} characters read)"


@query(
    f"""WITH p AS ({ORACLES["agentic_prompts"]}), q AS (SELECT *, string_split(prompt, chr(10) || chr(10) || 'Question: ')[-1] AS question FROM p)
SELECT doc_id, id, retrieved_count, substr(question, 1, 100) || ' (' || (length(prompt) - length(question) - 12) || ' characters read)' AS answer FROM q"""
)
def agentic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's passages, and its answer from a table of replies; a second run over the same questions asks nothing."""
    prompts = stored(workflow.agentic_prompts(spark, sf_dir))  # read for the questions and again for the answers
    kept = Replies(spark, shared_path(spark))
    kept.ask(prompts, "prompt", _Quoting)
    return kept.complete(prompts, "prompt", "answer", _Quoting).select("doc_id", "id", "retrieved_count", F.col("answer"))
