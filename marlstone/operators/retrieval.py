"""Nearest-neighbour retrieval and what is made of its hits."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import prefix
from marlstone.models import RuleModel, complete

#: Queries of a block, and rows of a cell that meet them.
BLOCK_QUERIES, BLOCK_ROWS = 512, 8192
#: Numbers of the queries that a cell of all rows holds, as a multiple of what a block of 64 numbers a vector has; and rows of such a cell, as a multiple too.
WIDE_QUERIES, WIDE_ROWS = 16, 8


def distance2(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to a given vector."""
    pairs = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def top_k(chunks: DataFrame, query: list[float], k: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector, by distance, then key. The vector is a literal, so nothing is joined."""
    return chunks.withColumn("distance2", distance2(F.col(vector), query)).orderBy("distance2", key).limit(k)


def top_k_each(queries: DataFrame, chunks: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to every query: query_id, key, distance2, rank.

    Exact, in blocks: a cell holds a block of queries and streams a share of the
    rows past them, keeping k a query; the cells' best are then ranked by query.
    """
    n_queries, width = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    n_rows = chunks.count()
    # every row is sent once a block and every query once a share, so both are large, as long as all cores have a cell
    held = max(BLOCK_QUERIES, WIDE_QUERIES * BLOCK_QUERIES * 64 // max(64, width or 0))
    blocks = max(1, -(-n_queries // held))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-n_rows // (WIDE_ROWS * BLOCK_ROWS)), min(-(-n_rows // BLOCK_ROWS), -(-2 * cores // blocks)))
    share = F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    asked = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    told = chunks.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share.alias("share"))
    return best_of(nearest_in_cells(asked, told, ["block", "share"], k), k).withColumnRenamed("id", key)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query's rows, with their rank: query_id, id, distance2, rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance2", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_in_cells(asked: DataFrame, told: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of told nearest to every query of asked within each cell: query_id, id, distance2. Both: id, v, and the cell's columns.

    A cell's queries are held, its rows streamed past them. Null vectors meet nothing.
    """
    columns = ["id", "v", *by, "role"]
    cells = asked.withColumn("role", F.lit(0)).select(columns).unionByName(told.withColumn("role", F.lit(1)).select(columns))
    cells = cells.repartition(*by).sortWithinPartitions(*by, "role", "id")
    kind = asked.schema["id"].dataType.simpleString()

    def nearest(q, best, names, rows):
        """best: by query, distances and names of at most k; those of more rows are taken in."""
        near = (q**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * q @ rows.T  # to find candidates; distances are exact
        slack = 1e-9 * (1 + (q**2).sum(axis=1) + (rows**2).sum(axis=1).max())
        for at, own in enumerate(near):
            least = min(np.partition(own, k - 1)[k - 1] if len(own) > k else np.inf, best[at][-1][0] if len(best[at]) == k else np.inf)
            some = np.flatnonzero(own <= least + slack[at])
            if len(some):
                exact = ((rows[some] - q[at]) ** 2).sum(axis=1)
                best[at] = sorted([*best[at], *zip(exact.tolist(), (names[x] for x in some), strict=True)])[:k]

    def run(batches):
        own, ids, vectors, best = None, [], [], []

        def done():
            flat = [(i, hit[1], hit[0]) for i, hits in zip(ids, best, strict=True) for hit in hits]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (id_type, id_type, pa.float64()), strict=True)], names=["query_id", "id", "distance2"])

        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            batch = batch.filter(batch.column("v").is_valid())
            keys = np.stack([batch.column(c).to_numpy() for c in (*by, "role")]) if len(batch) else np.zeros((len(by) + 1, 0))
            names, lists = batch.column("id").to_pylist(), batch.column("v")
            every = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1) if len(names) else np.zeros((0, 1))
            new = np.ones(len(names), dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            edges = [*np.flatnonzero(new).tolist(), len(names)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                cell = keys[:-1, a].tolist()
                if cell != own:
                    yield from done()
                    own, ids, vectors, best = cell, [], [], []
                if keys[-1, a] == 0:
                    ids += names[a:z]
                    vectors.append(every[a:z])
                    best += [[] for _ in range(z - a)]
                elif ids:
                    if len(vectors) > 1:
                        vectors = [np.concatenate(vectors)]
                    for at in range(0, len(ids), BLOCK_QUERIES):
                        part = best[at : at + BLOCK_QUERIES]
                        nearest(vectors[0][at : at + BLOCK_QUERIES], part, names[a:z], every[a:z])
                        best[at : at + BLOCK_QUERIES] = part
        yield from done()

    return cells.mapInArrow(run, f"query_id {kind}, id {kind}, distance2 double")


def ranked(hits: DataFrame, order: list[str], threshold: float | None = None) -> DataFrame:
    """A few hits with their rank, the similarity made up from it, and the cosine that the distance of unit vectors gives.

    The made-up one falls by 0.05 from 0.95 a rank. A threshold, if given, applies to the cosine.
    """
    rank = F.row_number().over(Window.orderBy(*order))
    out = hits.withColumn("rank", rank).withColumn("similarity", F.round(F.lit(0.95) - 0.05 * (F.col("rank") - 1), 2)).withColumn("cosine", 1 - F.col("distance2") / 2)
    return out if threshold is None else out.where(F.col("cosine") >= threshold)


def fixed_score(hits: DataFrame, score: float = 0.9) -> DataFrame:
    """Hits that all get one score."""
    return hits.withColumn("similarity", F.lit(score))


def numbered_page(page: Column, rank: Column) -> Column:
    """A chunk's page, or its rank where it has none."""
    return F.coalesce(page.cast("int"), rank.cast("int"))


# The four forms a hit takes in a context, and what stands between them.


def cited(rank: Column, file: Column, page: Column, content: Column) -> Column:
    return F.concat(F.lit("[文档"), rank.cast("string"), F.lit(": "), file, F.lit(", 第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页]\n"), content)


def regulation(rank: Column, content: Column, n: int = 300) -> Column:
    return F.concat(F.lit("【参考规程"), rank.cast("string"), F.lit("】\n"), prefix(content, n))


def listed(rank: Column, file: Column, page: Column, content: Column, n: int = 200) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), file, F.lit(" 第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页:\n"), prefix(content, n))


BLANK_LINE, RULE = "\n\n", "\n\n---\n\n"


def context(hits: DataFrame, part: Column, by: list[str], separator: str = BLANK_LINE) -> DataFrame:
    """The parts of each group's hits in rank order, joined; of at most k hits a group."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), part.alias("p"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda x: x["p"]), separator).alias("context"), F.count("*").alias("retrieved_count"))


def contexts(hits: DataFrame, by: list[str], separators: dict[str, str]) -> DataFrame:
    """Several contexts of each group's hits at once: columns of hits, each joined in rank order by its separator."""
    pieces = F.array_sort(F.collect_list(F.struct("rank", *separators)))
    gathered = hits.groupBy(*by).agg(pieces.alias("pieces"))
    return gathered.select(*by, *(F.array_join(F.col("pieces")[c], s).alias(c) for c, s in separators.items()))


#: Fixed value: what a detector reads where nothing was found.
NO_REGULATION = "未检索到相关规程"


def detector_contexts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """For each query the references of two detectors: terms (three hits, 300 characters each) and standards (five, 400). hits: query_id, rank, passage."""
    part = lambda n: regulation(F.col("rank"), F.col("passage"), n)
    of = lambda name, k, n: context(hits.where(F.col("rank") <= k), part(n), ["query_id"]).select("query_id", F.col("context").alias(name))
    met = docs.join(of("terms", 3, 300), "query_id", "left").join(of("standards", 5, 400), "query_id", "left")
    return met.select("query_id", *(F.coalesce(c, F.lit(NO_REGULATION)).alias(c) for c in ("terms", "standards")))


def answered(questions: DataFrame, contexts: DataFrame, key: str, question: str, client=RuleModel) -> DataFrame:
    """Every question with an answer from its context; one without hits gets the fixed apology and a count of 0."""
    met = questions.join(contexts, key, "left").withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
    prompt = F.when(F.col("retrieved_count") > 0, F.concat("context", F.lit("\n\nQuestion: "), question))
    told = complete(met.withColumn("prompt", prompt), "prompt", "answer", client)
    return told.withColumn("answer", F.coalesce("answer", F.lit(RuleModel.APOLOGY))).drop("prompt", "context")


def questions_of(documents: DataFrame, key: str, reply: str, text: str) -> DataFrame:
    """Questions that a model lists in JSON, one a row; where the reply is no list, the whole document is the question."""
    listed_ = F.from_json(reply, "struct<questions: array<struct<id: int, title: string, question: string>>>")["questions"]
    whole = F.array(F.struct(F.lit(1).alias("id"), F.lit("document").alias("title"), F.col(text).alias("question")))
    return documents.select(key, F.explode(F.coalesce(F.when(F.size(listed_) > 0, listed_), whole)).alias("q")).select(key, "q.*")


#: Fixed value: what a chat says that is to use a knowledge base but names none.
NO_BASE = "错误：使用RAG模式时必须指定知识库ID"


def chat_prompts(sessions: DataFrame, turns: DataFrame, contexts: DataFrame, key: str, base: str) -> DataFrame:
    """What a model is asked in a chat over a knowledge base, or the message where no base is given.

    sessions: key, base, question; turns: key, order, role, text (the history);
    contexts: key, context. A session's history and context are held in its row;
    the history is that of one conversation, the context that of its few hits.
    A session without history has no part for it; one without a question, no prompt.
    """
    lines = F.array_sort(F.collect_list(F.struct("order", F.concat("role", F.lit(": "), "text").alias("line"))))
    history = turns.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))
    met = sessions.join(history, key, "left").join(contexts.select(key, "context"), key, "left")
    # texts of a history may all be null
    parts = F.concat_ws(BLANK_LINE, F.coalesce("context", F.lit("")), F.nullif("history", F.lit("")), F.concat(F.lit("Question: "), "question"))
    lacks = F.col(base).isNull()
    return met.select(key, F.when(~lacks & F.col("question").isNotNull(), parts).alias("prompt"), F.when(lacks, NO_BASE).alias("message"))
