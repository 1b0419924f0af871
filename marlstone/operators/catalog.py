"""Knowledge bases, their documents and the rows that hang on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import root, suffix
from marlstone.session import shared_path


def rollup(parents: DataFrame, children: DataFrame, key: str, foreign: str, aggregates: dict[str, Column], defaults: dict[str, Column]) -> DataFrame:
    """Every parent with aggregates of its children; children are folded before the join, and a parent without any gets the defaults."""
    folded = children.groupBy(F.col(foreign).alias("__key")).agg(*(c.alias(k) for k, c in aggregates.items()))
    out = parents.join(folded, parents[key].eqNullSafe(folded["__key"]), "left").drop("__key")
    return out.withColumns({k: F.coalesce(F.col(k), d) for k, d in defaults.items()})


def kb_rollup(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases with document count, bytes and time of the last change (their own creation without documents)."""
    last = F.max(F.coalesce("indexed_time", "upload_time"))
    found = rollup(bases, documents, "id", "kb_id", {"documents": F.count("id"), "bytes": F.sum("file_size"), "changed_at": last}, {"documents": F.lit(0), "bytes": F.lit(0), "changed_at": F.col("created_at")})
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def orphans(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows whose key no live row has."""
    return rows.join(live.select(key).distinct(), key, "left_anti")


def flagged(rows: DataFrame, live: DataFrame, key: str, yes: str = "ACTIVE", no: str = "ORPHAN") -> DataFrame:
    """Rows with a status by whether a live row has their key."""
    known = live.select(F.col(key).alias("__key")).distinct()
    met = rows.join(known, rows[key] == known["__key"], "left")
    return met.withColumn("status", F.when(F.col("__key").isNotNull(), yes).otherwise(no)).drop("__key")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys: guarded child queries, accepted ids."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children that stay when the parents in gone are deleted."""
    keys = gone.select(F.col(key).alias("__key")).distinct()
    keep = lambda df, c: df.join(keys, df[c] == keys["__key"], "left_anti")
    return keep(parents, key), keep(children, foreign)


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null is not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def insert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """rows with new ones, whose keys go on from the greatest in the order of new's columns.

    The new rows are sorted over all tasks and written to the shared folder, so
    that each part's first number follows from the sizes of the parts before it.
    """
    spark = rows.sparkSession
    path = shared_path(spark)
    # the number of a part and of a row in it are those of the sort's tasks; written, they are data
    part, own = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    new.orderBy(*new.columns).withColumns({"__part": part, "__own": own}).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a task
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n").join(F.broadcast(top))
    placed = placed.join(F.broadcast(before), "__part").withColumn(key, F.col("__top") + F.col("__before") + F.col("__own") + 1)
    return rows.unionByName(placed.drop("__part", "__own", "__before", "__top"), allowMissingColumns=True)


def insert_absent(rows: DataFrame, new: DataFrame, by: str, key: str = "id") -> DataFrame:
    """Find or create: only those of new whose name isn't there yet."""
    return insert(rows, new.dropDuplicates([by]).join(rows.select(by), by, "left_anti"), key)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes over rows by key: given values win, nulls leave the old, new keys are added."""
    old, new = rows.alias("o"), changes.alias("n")
    met = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in changes.columns else F.col(f"o.{c}")
    return met.select(*(pick(c).alias(c) for c in rows.columns))


def active_config(configs: DataFrame, defaults: dict, user: str | None = None) -> DataFrame:
    """The latest active config (of a user, if given), or one row of defaults."""
    own = configs.where(F.col("is_active") & (F.lit(True) if not user else F.col("user_id") == user))
    own = own.select(*defaults, F.lit(0).alias("__rank"), "updated_at", "id")
    base = configs.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in defaults.items()), F.lit(1).alias("__rank"))
    both = own.unionByName(base, allowMissingColumns=True)
    return both.orderBy("__rank", F.desc_nulls_last("updated_at"), F.desc_nulls_last("id")).limit(1).select(*defaults)


def active_configs(configs: DataFrame, users: DataFrame, defaults: dict) -> DataFrame:
    """For every user their latest active config (by updated_at, then id; nulls first come first), or the defaults: user_id and the columns of defaults."""
    own = configs.where(F.coalesce("is_active", F.lit(False)))
    latest = own.groupBy("user_id").agg(F.max_by(F.struct(*defaults), F.struct("updated_at", "id")).alias("__c"))
    met = users.select("user_id").distinct().join(latest, "user_id", "left")
    return met.select("user_id", *(F.when(F.col("__c").isNull(), F.lit(v)).otherwise(F.col(f"__c.{k}")).alias(k) for k, v in defaults.items()))


def deduplicated_names(files: DataFrame, name: str, order: list[str], salt: Column | None = None) -> DataFrame:
    """Each file's free name: x.pdf, then x(1).pdf, x(2).pdf in order; a number that a literal name has is passed over."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    numbered = files.withColumn("__place", place)
    stem, end = root(F.col(name)), suffix(F.col(name))
    literal = files.select(F.regexp_extract(root(F.col(name)), r"^(.*)\((\d{1,9})\)$", 1).alias("__s"), F.regexp_extract(root(F.col(name)), r"\((\d{1,9})\)$", 1).alias("__n"), suffix(F.col(name)).alias("__e")).where("__n <> ''")
    taken = literal.groupBy(F.concat("__s", "__e").alias("__name")).agg(F.array_sort(F.collect_set(F.col("__n").cast("int"))).alias("__taken"))
    met = numbered.join(taken, numbered[name] == taken["__name"], "left")
    # the place-th number from 1 that isn't taken: each taken one at or below moves it on
    moved = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__place"), lambda n, t: F.when((F.col("__place") > 0) & (t > 0) & (t <= n), n + 1).otherwise(n))
    out = F.when(F.col("__place") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("("), moved.cast("string"), F.lit(")"), end))
    return met.withColumn("free_name", out).drop("__place", "__name", "__taken")


def counted_page(rows: DataFrame, key: str, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of every key, with the count of all of them and each one's number."""
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("number", number).where(F.col("number") <= n).join(totals, key)


def collections(chunks: DataFrame, key: str = "kb_id") -> DataFrame:
    """Collections with row counts."""
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"))


def sample_rows(chunks: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    return counted_page(chunks, key, order, n).drop("total", "number")


def totals(rolled: DataFrame, *sums: str, last: str | None = None) -> DataFrame:
    """Sums (and the latest time) over a rollup."""
    out = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    return rolled.agg(*out, *([F.max(last).alias(last)] if last else []))


def all_done(uploads: DataFrame, ok: Column) -> DataFrame:
    """Whether there are uploads and all of them are ok."""
    return uploads.agg((F.coalesce(F.bool_and(ok), F.lit(False)) & (F.count("*") > 0)).alias("all_done"))


def lookup(rows: DataFrame, wanted: DataFrame, key: str, found: int = 200, missing: int = 404) -> DataFrame:
    """One row per wanted key with its row's columns and a code that tells whether there is one."""
    have = rows.withColumn("__have", F.lit(True))
    return wanted.select(key).distinct().join(have, key, "left").withColumn("code", F.when(F.col("__have"), found).otherwise(missing)).drop("__have")


def deleted_counts(rows: DataFrame, gone: Column, by: str) -> DataFrame:
    """Rows deleted and rows that stay, by key; a condition that is null deletes nothing."""
    bad = F.coalesce(gone, F.lit(False))
    return rows.groupBy(by).agg(F.count_if(bad).alias("deleted"), F.count_if(~bad).alias("kept"))


def base_deletion(documents: DataFrame, chunks: DataFrame, gone: DataFrame, base: str, document: str) -> DataFrame:
    """What the deletion of knowledge bases takes with it, by base: documents and chunks; bases without any count 0."""
    keys = gone.select(base).distinct()
    own = documents.join(keys, base, "left_semi").select(base, document)
    pieces = chunks.groupBy(document).agg(F.count("*").alias("__chunks"))
    folded = own.join(pieces, document, "left").groupBy(base).agg(F.count("*").alias("documents"), F.coalesce(F.sum("__chunks"), F.lit(0)).cast("bigint").alias("chunks"))
    return keys.join(folded, base, "left").fillna(0, ["documents", "chunks"])


def latest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n latest rows with their places, ties by falling key."""
    top = rows.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(at), F.desc(key))))


def located_chunks(documents: DataFrame, bases: DataFrame, chunks: DataFrame, base: str = "kb_id", document: str = "doc_id") -> DataFrame:
    """Chunks of documents that stand in a live base, with the base's columns; documents are found by base and id."""
    return documents.join(bases, base).join(chunks, [base, document])
