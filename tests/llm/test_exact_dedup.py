import hashlib
from collections import Counter

from frames import LOWER, awkward, awkward_rows, empty
from pyspark.sql import functions as F

from marlstone.llm.exact_dedup import ExactDedup


def expected(rows):
    groups = {}
    for k, t, _ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    best = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return groups, best


def test_groups_and_winners(spark):
    rows = awkward_rows()
    groups, best = expected(rows)
    got = ExactDedup(salts=3).decide(awkward(spark).repartition(5)).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    want = Counter((k, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks)
    assert Counter((r[0], r[1], r[2], r[4]) for r in got) == want
    assert Counter(r[4] for r in got if r[3]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r[0] == r[1] for r in got if r[3])


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = [(k, f"text {k % 10}", "s") for k in range(60)]
    weak = ExactDedup(digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1)))
    docs = awkward(spark, rows)
    assert sorted(r["id"] for r in weak.decide(docs).where("kept").collect()) == list(range(50, 60))
    assert sorted(r["doc_id"] for r in weak.keep(docs).collect()) == list(range(50, 60))


def test_kept_rows_have_all_columns(spark):
    docs = awkward(spark)
    kept = ExactDedup().keep(docs)
    assert kept.columns == docs.columns
    groups, best = expected(awkward_rows())
    assert Counter((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in kept.collect()) == Counter((best[t], t) for t in groups)


def test_nothing(spark):
    assert ExactDedup().decide(empty(spark)).count() == 0 == ExactDedup().keep(empty(spark)).count()


def test_main_path_has_no_python(spark):
    plan = ExactDedup().decide(awkward(spark).where("doc_id > 0"))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan
