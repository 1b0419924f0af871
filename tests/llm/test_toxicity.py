import math
import random

import numpy as np
from frames import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from marlstone.llm.toxicity import BlockMaxIndex, Toxicity, Vocabulary, terms


def test_index_is_brute_force():
    rng = random.Random(6)
    vectors = []
    for _ in range(700):
        v = {rng.randrange(40): rng.random() for _ in range(rng.randint(1, 6))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    index = BlockMaxIndex(vectors, 40, block=16)
    for _ in range(200):
        q = {rng.randrange(40): rng.random() for _ in range(rng.randint(1, 5))}
        cosine = np.array([sum(w * v.get(t, 0) for t, w in q.items()) for v in vectors])
        want = [k for k in sorted(range(700), key=lambda k: (-round(cosine[k], 12), k)) if cosine[k] > 0][:9]
        near, scores = index.nearest(q, 9)
        assert near.tolist() == want and np.allclose(scores, cosine[want])


def test_terms():
    assert terms("Idiots!") == ["Idiots|", "Idio", "Idiot"] and terms("12_3") == [] and terms("a-b") == ["a|", "b|"]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = Toxicity().fit(docs, labels, ~held).score(docs).join(labels.where(held), F.col("id") == F.col("doc_id")).collect()
    clean, toxic = [r["score"] for r in got if r["toxic"] == 0], [r["score"] for r in got if r["toxic"] == 1]
    assert sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)
    assert sum(s >= 0.7 for s in toxic) >= 0.65 * len(toxic)
    assert all(0 <= s <= 1 for s in clean + toxic)


def test_awkward_rows(spark):
    rng = random.Random(7)
    rows = [(1000 + k, ("vile " if k % 4 == 0 else "") + " ".join(rng.choice(["sun", "sea", "hill", "tree"]) for _ in range(8)), None) for k in range(200)]
    docs = awkward(spark, rows + awkward_rows())
    labels = spark.createDataFrame([(1000 + k, int(k % 4 == 0)) for k in range(200)] + [(1000, 0), (None, 1), (1001, None), (77777, 1)], "doc_id long, toxic int")
    model = Toxicity().fit(docs, labels)
    got = model.score(docs).collect()
    assert len(got) == len(rows) + len(awkward_rows())
    scores = {r["id"]: r["score"] for r in got if r["id"] is not None and r["id"] >= 1000}
    assert all((s >= 0.7) == ((k - 1000) % 4 == 0) for k, s in scores.items())
    assert all(r["evidence"] for r in got if r["score"] >= 0.7) and all(0 <= r["score"] <= 1 for r in got)
    kept = model.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 50


def test_without_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in Toxicity().fit(docs, labels).score(docs).collect()} == {0.5}
    one = spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in Toxicity().fit(docs, one).score(docs).collect())
    assert Toxicity().fit(empty(spark), labels).score(empty(spark)).count() == 0


def dense(model, texts):
    """Scores of counted texts by all cosines with all examples, and the number of known terms of each."""
    index = model.index
    vectors = np.zeros((index.n, len(model.known)))
    rows, columns, weights = index.common
    vectors[rows, np.flatnonzero(index.column >= 0)[columns]] = weights
    own = np.repeat(np.arange(len(model.known)), np.diff(np.concatenate((index.begins[index.entries[:-1]], [len(index.rows)]))))
    vectors[index.rows, own] = index.weights
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1)
    out = []
    for t, n in texts:
        raw = (1 + np.log(n)) * model.weight[t]
        cosine = vectors[:, t] @ (raw / (np.linalg.norm(raw) or 1))
        near = sorted(np.flatnonzero(cosine > 1e-15), key=lambda k: (-round(cosine[k], 12), k))[: model.k]
        out.append(model.chance(model.vote(cosine[near], model.votes[near])) if len(t) else model.blank_score)
    return out


def test_scores_are_those_of_all_cosines(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = Toxicity().fit(docs, labels)
    rows = fitted.score(docs).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    words = Vocabulary(fitted.model.known)
    want = dense(fitted.model, [words.count(r["text"]) for r in rows])
    assert np.allclose([r["score"] for r in rows], want, atol=1e-7)
    assert len({r["score"] for r in rows if r["text"].strip()}) > 0.8 * len({r["text"] for r in rows})  # no constant


def test_no_word_is_left_out(spark):
    """Texts without blanks, and terms that one example alone has."""
    rng = random.Random(8)
    own = lambda k: f"{k:02}".translate(str.maketrans("0123456789", "qrstuvwxyz"))
    rows = [(k, rng.choice(["ab", "cd"]) * 40 + ("x" * 200 + "y" if k % 3 == 0 else "") + " " + own(k), None) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    fitted = Toxicity().fit(awkward(spark, rows), labels)
    got = {r["id"]: r for r in fitted.score(awkward(spark, rows), evidence=1).collect()}
    assert all(got[k]["evidence"][0]["example"] == str(k) and abs(got[k]["evidence"][0]["cosine"] - 1) < 1e-9 for k in range(60) if k % 3 == 0)
    assert all((r["score"] > 0.5) == (k % 3 == 0) for k, r in got.items())


def test_recall_by_its_method(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").repartition(4) for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = Toxicity().fit(docs, labels, ~held).score(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi")).join(labels, F.col("id") == F.col("doc_id")).collect()
    clean, toxic = [r["score"] for r in got if r["toxic"] == 0], [r["score"] for r in got if r["toxic"] == 1]
    assert sum(s >= 0.7 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)
    # calibrated: the mean score is the share of label 1
    assert abs(sum(clean + toxic) / len(got) - len(toxic) / len(got)) < 0.03


def test_repeated_ids_stay_within_the_bound(spark):
    """100,000 equal rows of one labelled id are one example, many texts of an id count each, and labels of other ids take no places."""
    rows = spark.range(100_000).selectExpr("CAST(1 AS long) AS doc_id", "'you vile thing' AS text")
    rows = rows.unionByName(spark.range(5_000).selectExpr("CAST(2 AS long) AS doc_id", "concat('a nice day ', id) AS text"))
    rows = rows.unionByName(spark.createDataFrame([(3, "a fine day"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)] + [(k, 1) for k in range(1000, 3000)], "doc_id long, toxic int")
    few = Toxicity(examples=10).fit(rows, labels)
    assert len(few.model.ids) <= 10
    some = Toxicity(examples=6_000).fit(rows, labels)
    assert sorted(some.model.ids.count(str(k)) for k in (1, 2, 3)) == [1, 1, 5_000]
    assert [r["id"] for r in some.score(rows.where("doc_id IN (1, 3)").distinct()).where("score >= 0.5").collect()] == [1]
