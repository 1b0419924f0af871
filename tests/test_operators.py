import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.models import Limited, RuleModel, complete, embed_text, embedding
from marlstone.operators import catalog, chat, retrieval, review, usage
from marlstone.sources import files, sinks
from marlstone.streaming import usage as stream_usage

T0 = dt.datetime(2024, 1, 1)


def logs(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schemas.MONITOR_LOGS)


def log(module="chat", status="success", tokens=1, latency=1.0, hour=0):
    return (module, "op", status, tokens, latency, 0.0, T0 + dt.timedelta(hours=hour), None, None)


def test_stats_of_nothing_are_zero(spark):
    assert usage.stats(logs(spark, [])).first().asDict() == {"total_calls": 0, "total_tokens": 0, "avg_latency": 0.0, "total_cost": 0.0, "failed_calls": 0, "error_rate": 0.0}


def test_ranges_include_both_ends_and_skip_empty_filters(spark):
    rows = logs(spark, [log(hour=0), log(hour=1, tokens=None), log(hour=2), log(hour=3, status="failed", module="rag")])
    got = usage.in_range(rows, start="2024-01-01 01:00:00", end="2024-01-01 03:00:00", module="", status=None)
    assert usage.stats(got).first()["total_calls"] == 3
    assert usage.in_range(rows, as_of="2024-01-01 03:00:00", hours=1).count() == 2
    assert usage.recent(rows, 1, module="chat").first()["id"] == 2


def test_append_numbers_from_the_greatest(spark):
    more = usage.append(logs(spark, [log(), log()]), module="rag", status="success")
    assert more.agg(F.max("id")).first()[0] == 2


def test_kb_rollup_of_parents_without_children(spark):
    bases = spark.createDataFrame([(1, "a", None, T0, T0), (2, "b", None, T0 + dt.timedelta(1), T0)], schemas.KNOWLEDGE_BASES)
    late = T0 + dt.timedelta(5)
    docs = spark.createDataFrame([(1, 1, "x", "", "txt", None, "indexed", 0, T0, late), (2, 1, "y", "", "txt", 5, "indexed", 0, T0, None)], schemas.DOCUMENTS)
    got = [(r["id"], r["documents"], r["bytes"], r["changed_at"]) for r in catalog.kb_rollup(bases, docs).collect()]
    assert got == [(2, 0, 0, T0 + dt.timedelta(1)), (1, 2, 5, late)]


def test_names_pass_over_literal_numbers(spark):
    rows = [(1, "x.pdf"), (2, "x.pdf"), (3, "x(1).pdf"), (4, "x.pdf"), (5, "none"), (6, "none"), (7, "a.b.c"), (8, "a.b.c")]
    got = catalog.deduplicated_names(spark.createDataFrame(rows, "id long, name string"), "name", ["id"])
    names = {r["id"]: r["free_name"] for r in got.collect()}
    assert names == {1: "x.pdf", 2: "x(2).pdf", 3: "x(1).pdf", 4: "x(3).pdf", 5: "none", 6: "none(1)", 7: "a.b.c", 8: "a.b(1).c"}


def test_delete_keeps_null_keys_and_others(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "cid long, pid long")
    kept, left = catalog.delete(parents, children, parents.where("id = 1"), "id", "pid")
    assert [r["id"] for r in kept.collect()] == [2]
    assert sorted(r["cid"] for r in left.collect()) == [11, 12]
    assert catalog.delete_where(children, F.col("pid") == 1).count() == 2


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id long, name string, n int")
    assert sorted(map(tuple, catalog.upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    names = spark.createDataFrame([("b",), ("z",)], "name string")
    assert sorted((r["id"], r["name"]) for r in catalog.insert_absent(old, names, "name").collect()) == [(1, "a"), (2, "b"), (3, "z")]


def test_all_done_needs_one(spark):
    none = spark.createDataFrame([], "ok boolean")
    assert catalog.all_done(none, F.col("ok")).first()[0] is False
    assert catalog.all_done(spark.createDataFrame([(True,)], "ok boolean"), F.col("ok")).first()[0] is True


def test_active_config_falls_back(spark):
    one = spark.createDataFrame([(1, "u", "similarity", 9, 0.1, "m", 0.0, 10, True, T0, T0)], schemas.RAG_CONFIGS)
    assert catalog.active_config(one, schemas.RAG_DEFAULTS).first()["retrieval_k"] == 9
    assert catalog.active_config(one, schemas.RAG_DEFAULTS, "other").first()["retrieval_k"] == 4


def test_history_and_deltas(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello there"), (1, 2, "assistant", "abcdefgh"), (1, 3, "user", "q"), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r["conv_id"], r["turn"]) for r in chat.history(df).collect()) == [(1, 1), (1, 2)]
    got = {r["conv_id"]: r for r in chat.deltas(df, "conv_id", "turn", "text").collect()}
    assert got[1]["text"] == "shello thereabcdefghq" and got[1]["tokens"] == 0 + 2 + 2 + 0


def test_add_message_moves_its_session(spark):
    sessions = spark.createDataFrame([(1, "a", "u", T0, T0), (2, "b", "u", T0, T0)], schemas.SESSIONS)
    messages = spark.createDataFrame([], schemas.MESSAGES)
    more, touched = chat.add_message(messages, sessions, 2, "user", "eight ch", "2024-05-01 00:00:00")
    assert more.first()["tokens"] == 2 and more.first()["id"] == 1
    assert [r["id"] for r in chat.sessions_by_change(touched).collect()] == [2, 1]


def test_top_k_each_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (300, 4)).astype(float)  # ties abound
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = retrieval.top_k_each(df.where("vec_id % 20 = 0"), df, 7)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
    for q in range(0, 300, 20):
        d = ((vectors - vectors[q]) ** 2).sum(axis=1)
        assert [found[q, k + 1] for k in range(7)] == sorted(range(300), key=lambda k: (d[k], k))[:7]


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    test_top_k_each_is_brute_force(spark)


def test_answers_without_hits(spark):
    questions = spark.createDataFrame([(1, "what is red"), (2, "other")], "id long, q string")
    contexts = spark.createDataFrame([(1, "The fox is red. The sea is blue.", 2)], "id long, context string, retrieved_count long")
    got = {r["id"]: r for r in retrieval.answered(questions, contexts, "id", "q").collect()}
    assert got[1]["answer"].startswith("The fox is red.") and got[2]["answer"] == RuleModel.APOLOGY and got[2]["retrieved_count"] == 0


def test_questions_fall_back_to_the_document(spark):
    rows = [(1, '{"questions": [{"id": 1, "title": "t", "question": "a?"}, {"id": 2, "title": "t", "question": "b?"}]}', "body"), (2, "no json", "whole")]
    df = spark.createDataFrame(rows, "doc_id long, reply string, text string")
    got = sorted((r["doc_id"], r["question"]) for r in retrieval.questions_of(df, "doc_id", "reply", "text").collect())
    assert got == [(1, "a?"), (1, "b?"), (2, "whole")]


def test_embeddings_and_clients(spark):
    df = spark.createDataFrame([("red fox",), (None,)], "t string")
    got = [r["e"] for r in df.select(embedding(F.col("t")).alias("e")).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and not any(got[1]) and len(embed_text("a")) == 64

    class Flaky:
        n = 0

        def complete(self, prompt):
            self.n += 1
            if self.n < 3:
                raise OSError
            return prompt.upper()

    assert Limited(Flaky(), tries=3).complete("a") == "A"
    with pytest.raises(OSError):
        Limited(Flaky(), tries=2).complete("a")
    assert [r["reply"] for r in complete(df, "t").collect()][1] is None


def test_review_finds_what_is_planted(spark):
    text = "根剧规定，应当检查。\n检查间隔为4小时。瓦斯浓度不得超过1.5%。\n通风要好。通风要好。\n综和考虑" + "很" * 90 + "。"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = review.review(docs)
    kinds = {(r["type"], r["original"] if r["type"] == "typo" else r["reference"] if r["type"] == "compliance" else r["paragraph_index"]) for r in got.collect()}
    assert kinds == {("typo", "根剧"), ("typo", "综和"), ("fluency", 3), ("duplicate", 2), ("compliance", "check_interval"), ("compliance", "gas_concentration")}
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    counted = review.counts(got).first()
    assert (counted["total_changes"], counted["typo_count"], counted["compliance_count"]) == (6, 2, 2)


def test_a_models_own_type_and_id_stand(spark):
    shape = "doc_id long, paragraph_index int, original string, type string, id int"
    findings = {"duplicate": spark.createDataFrame([(1, 0, "a", "near", 7), (1, 0, "b", None, None)], shape)}
    got = {(r["original"], r["type"]) for r in review.merge(findings).collect()}
    assert got == {("a", "near"), ("b", "duplicate")}
    assert {r["id"] for r in review.merge(findings).collect()} >= {7}


def test_changes_chain_and_count(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "none"), (3, None)], "doc_id long, text string")
    changes = [(1, 1, "typo", "aa", "bb"), (1, 2, "fluency", "bb", "cc"), (1, 3, "duplicate", "aa", "zz"), (1, 4, "compliance", "nope", "x"), (1, 5, "typo", "", "x"), (2, 1, "typo", "one", "two")]
    df = spark.createDataFrame(changes, "doc_id long, id int, type string, original string, replacement string")
    accepted = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4, 5, 99)], "doc_id long, id int")
    got = {r["doc_id"]: tuple(r)[1:] for r in review.apply_changes(docs, df, accepted).drop("text").collect()}
    assert got == {1: ("cc bb aa", 2, 1, 6), 2: ("none", 0, 0, 0), 3: ("", 0, 0, 0)}


def test_near_pairs_are_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.choice("abcdefgh") for _ in range(40)]
    rows = []
    for k in range(40):
        ws = list(base)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(40)] = rng.choice("xyz")
        rows.append((1, k, " ".join(ws)))
    rows += [(2, 0, "one two"), (2, 1, "one two three"), (2, 2, ""), (2, 3, "one  two")]
    df = spark.createDataFrame(rows, "doc_id long, paragraph_index int, content string")

    def shingle(t):
        ws = t.split()
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    first = {}
    for d, k, t in rows:
        first.setdefault((d, t), k)
    want = set()
    for (d, t), i in first.items():
        for (e, u), j in first.items():
            if d == e and i < j and (a := shingle(t)) and (b := shingle(u)) and 100 * len(a & b) >= 80 * len(a | b):
                want.add((d, i, j))
    got = {(r["doc_id"], r["paragraph_index_1"], r["paragraph_index_2"]) for r in review.near_pairs(df).collect()}
    assert got == want and want


def test_task_views(spark):
    rows = [(1, "a", "f", "p", "completed", 100, None, 3, T0, T0, '{"typo_count": 2}', None), (2, "b", "f", "p", "failed", 0, None, 3, T0, None, None, "broke"), (3, "c", "f", "p", "processing", 0, None, 3, T0, None, '{"typo_count": 1}', "x")]
    view = {r["task_id"]: r for r in review.result_view(spark.createDataFrame(rows, schemas.REVIEW_TASKS), "typo_count INT").collect()}
    assert view["a"]["result"]["typo_count"] == 2 and view["b"]["error"] == "broke" and view["c"]["result"] is None and view["c"]["error"] is None
    steps = spark.range(0, 101, 25).select(review.step_of(F.col("id")).alias("s"))
    assert [r["s"] for r in steps.collect()] == [0, 1, 2, 3, 4]


def test_files_by_type(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("höllo\nworld", encoding="utf-8")
    (tmp_path / "d" / "b.docx").write_bytes(files.docx_of(["first", "  ", " second　"]))
    (tmp_path / "d" / "c.xyz").write_text("?")
    (tmp_path / "d" / "bad.docx").write_text("no zip")
    listing = files.listing(spark, str(tmp_path))
    units = {r["filename"]: r for r in files.load(listing).collect()}
    assert units["a.txt"]["content"] == "höllo\nworld" and units["b.docx"]["content"] == "first\n second　"
    assert units["c.xyz"]["status"] == "failed" and units["c.xyz"]["error"] == files.UNSUPPORTED and units["bad.docx"]["status"] == "failed"
    assert float(units["a.txt"]["upload_time"]) > 0
    sizes = files.directory_sizes(listing).first()
    assert (sizes["directory"], sizes["files"]) == ("d", 4)
    assert sorted(r["filename"] for r in files.reviewable(spark.createDataFrame([("a.docx",), ("A.DOCX",), ("b.doc",)], "filename string")).collect()) == ["a.docx", "b.doc"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    back = sinks.word_files(docs, "doc_id", "text").first()["content"]
    assert files.docx_paragraphs(bytes(back)) == ["a", "b"]
    chunks = spark.createDataFrame([(1, 1, 5, 0, "x"), (2, 2, 6, 0, "y")], "chunk_id long, kb_id long, doc_id long, chunk_no int, content string")
    path = str(tmp_path / "chunks")
    sinks.append_chunks(chunks, path)
    one = sinks.read_chunks(spark, path, kb_id=2)
    assert [r["content"] for r in one.collect()] == ["y"] and "PartitionFilters: [isnotnull(kb_id" in one._jdf.queryExecution().toString()
    assert sinks.drop_collection(spark, path, 1) and not sinks.drop_collection(spark, path, 1)
    sinks.report_csv(docs, str(tmp_path / "csv"), ["text", "doc_id"])
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).columns == ["text", "doc_id"]
    with pytest.raises(Exception, match="missing"):
        sinks.report_csv(docs, str(tmp_path / "csv2"), ["missing"])
    assert set(sinks.create_tables(spark, str(tmp_path / "db"))) == set(schemas.BY_NAME)


def test_streamed_trend_equals_the_batch(spark, tmp_path):
    rows = logs(spark, [log(hour=h % 5, tokens=h) for h in range(40)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.MONITOR_LOGS).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = stream_usage.to_table(stream_usage.trend(stream), str(tmp_path / "cp"), lambda df, _: df.write.mode("overwrite").parquet(out), mode="complete")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, usage.trend(rows).collect()))


def test_exact_classes_of_null_texts_and_groups(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (None, 3, "a"), (None, 4, "a"), (2, 5, "a"), (2, 6, None)], "g int, k int, text string")
    assert sorted((r["k"], r["class_id"], r["class_size"]) for r in review.exact_classes(rows, "k", "text").collect()) == [(1, 1, 3), (2, 1, 3), (3, 3, 3), (4, 3, 3), (5, 3, 3), (6, 1, 3)]
    by = review.exact_classes(rows, "k", "text", ["g"])
    assert by.columns == ["g", "k", "class_id", "class_size"]
    assert sorted((r["k"], r["class_id"], r["class_size"]) for r in by.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1), (6, 6, 1)]


def test_answers_see_whole_texts(spark, monkeypatch):
    from shared import DATA

    from marlstone.plans import retrieval as plans

    seen = []
    monkeypatch.setattr(plans.retrieval, "answered", lambda questions, contexts, *a: seen.append((questions, contexts)))
    plans.rag_answer(spark, DATA)
    (questions, contexts), texts = seen[0], {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    asked = {r["doc_id"]: r["question"] for r in questions.collect()}
    assert asked and all(q == texts[k] for k, q in asked.items())
    hits = plans._cited(spark, DATA).select("query_id", "text").collect()
    context = {r["doc_id"]: r["context"] for r in contexts.collect()}
    assert any(len(h["text"] or "") > 400 for h in hits) and all((h["text"] or "") in context[h["query_id"]] for h in hits)


def test_contained_is_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["red", "fox", "sea", "blue", "runs", "far"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "redfox sea", "the  red fox"]
    passages = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["ed fox se", "red", "", "  ", None, "red  fox sea", texts[3], "x" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t and p and p.strip() and p in t}
    got = [tuple(r) for r in review.contained(docs, items).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_inserts_of_many_parts_are_dense_and_in_order(spark):
    old = spark.createDataFrame([(7, "old")], "id long, name string")
    new = spark.range(1000).selectExpr("concat('n', lpad(string(id), 4, '0')) AS name").repartition(9)
    got = sorted((r["id"], r["name"]) for r in catalog.insert(old, new).where("id > 7").collect())
    assert got == [(8 + k, f"n{k:04}") for k in range(1000)]
    assert catalog.insert(old.limit(0), new.limit(0)).count() == 0


def test_reviews_take_no_empty_word_file(spark):
    rows = spark.createDataFrame([("/a/x.docx", files.docx_of([" ", ""])), ("/a/y.docx", files.docx_of(["t"]))], "path string, content binary")
    got = {r["filename"]: (r["status"], r["error"]) for r in files.load(rows, need_text=True).collect()}
    assert got == {"x.docx": ("failed", files.EMPTY), "y.docx": ("indexed", None)}


def test_folders_of_one_name(spark):
    rows = spark.createDataFrame([("/a/x/1", 1), ("/b/x/2", 2), ("/b/x/3", 3)], "path string, length long")
    assert sorted((r["directory"], r["folder"], r["files"], r["bytes"]) for r in files.directory_sizes(rows).collect()) == [("x", "/a/x", 1, 1), ("x", "/b/x", 2, 5)]


def test_simple_pdfs(spark):
    pages = ["one (two) \\ three\n\nünï", "", "\nfirst line blank", "x" * 5000]
    assert files.pdf_pages(files.pdf_of(pages)) == pages
    plain = b"%PDF-1.1\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n4 0 obj << /Length 60 >>\nstream\nBT 1 0 0 1 50 700 Tm [(He) -20 (llo)] TJ 0 -14 Td <776F726C64> Tj (!\\041) ' ET\nendstream endobj"
    assert files.pdf_pages(plain) == ["Hello\nworld\n!!"]
    rows = spark.createDataFrame([("/a/x.pdf", files.pdf_of(["a", "b"])), ("/a/y.pdf", b"%PDF-1.7 /ObjStm"), ("/a/z.pdf", b"")], "path string, content binary")
    got = sorted((r["filename"], r["page"], r["content"], r["status"]) for r in files.load(rows).collect())
    assert got == [("x.pdf", 0, "a", "indexed"), ("x.pdf", 1, "b", "indexed"), ("y.pdf", 0, None, "failed"), ("z.pdf", 0, None, "failed")]


def test_chats_without_history_or_question(spark):
    sessions = spark.createDataFrame([(1, 1, "q"), (2, 1, "q"), (3, 1, None), (4, None, "q"), (5, 1, "q")], "s int, kb int, question string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (3, 0, "user", "hi"), (5, 0, "user", None)], "s int, `order` int, role string, text string")
    contexts = spark.createDataFrame([(1, "c"), (2, "c")], "s int, context string")
    got = {r["s"]: (r["prompt"], r["message"]) for r in retrieval.chat_prompts(sessions, turns, contexts, "s", "kb").collect()}
    assert got == {1: ("c\n\nuser: hi\n\nQuestion: q", None), 2: ("c\n\nQuestion: q", None), 3: (None, None), 4: (None, retrieval.NO_BASE), 5: ("\n\nQuestion: q", None)}


def test_rows_are_sent_once_to_many_queries(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    sent = []
    real = retrieval.nearest_in_cells
    monkeypatch.setattr(retrieval, "nearest_in_cells", lambda asked, told, by, k: sent.append((asked.count(), told.count())) or real(asked, told, by, k))
    assert retrieval.top_k_each(rows.where("vec_id < 2000"), rows, 3).count() == 6000
    assert sent == [(4000, 9000)]  # two shares of the rows, one block of the queries


def test_files_that_land_are_small(spark, monkeypatch):
    from shared import DATA

    from marlstone.plans import files as plans

    monkeypatch.setattr(plans, "LINES", 7)
    seen = []
    real = files.load
    monkeypatch.setattr(files, "load", lambda found: seen.append(found.select(F.size(F.split("content", "\n")).alias("n")).agg(F.max("n")).first()[0]) or real(found))
    got = plans.landed_files(spark, DATA)
    want = spark.read.parquet(f"{DATA}/documents.parquet").select("source", F.explode(F.split("text", "\n", -1)).alias("x")).groupBy("source").count()
    assert seen == [8] and {(r["source"], r["lines"]) for r in got.collect()} == set(map(tuple, want.collect()))


def test_files_go_to_python_in_batches_of_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(300).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.repeat(F.lit("x"), 100_000), "UTF-8").alias("content")).coalesce(1)
    n = files.load(rows).where("status = 'indexed'").count()
    sizes = rows.mapInPandas(lambda batches: (b.iloc[:1, :1].assign(n=len(b))[["n"]] for b in batches), "n long").collect()
    assert n == 300 and max(r["n"] for r in sizes) < 60 and sum(r["n"] for r in sizes) == 300


def test_pdf_pages_take_one_python_step_and_equal_the_sql(spark, duck, tmp_path):
    from marlstone.plans import files as plans
    from marlstone.plans.base import ORACLES

    texts = [None, "", "one", "\n", *("\n".join(f"line ({k})" for k in range(n)) for n in (19, 20, 21, 40, 41))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.pdf_pages(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1  # each step has a Python process a core
    sql = ORACLES["pdf_pages"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(sql).fetchall())


def test_units_go_back_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    rows = spark.createDataFrame([("/a/x.txt", b"")], "path string, content binary")
    seen = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, shape: seen.append(run))
    files.load(rows, {"txt": lambda c: ["y" * 1000] * c[0]})
    batch = pa.record_batch([["/a/x.txt", "/a/y.xyz", None], ["x.txt", "y.xyz", None], ["txt", "xyz", None], pa.array([b"\xff", b"", None]), pa.nulls(3, pa.string())], ["path", "filename", "file_type", "content", "upload_time"])
    back = list(seen[0](iter([batch] * 40)))
    assert max(b.num_rows for b in back) < 1100 and sum(b.num_rows for b in back) == 40 * 257
    assert list(seen[0](iter([]))) == []
