"""The five stages, each against a plain version of itself on the rows that it was given."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from shared import DATA
from test_minhash import linked_components
from test_packing import check

import corpus_pipeline
from marlstone.llm.mixing import Mixer
from marlstone.llm.toxicity import Toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    out, docs = {}, spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.written(stage(spark, given, DATA))
        out[name] = given, docs
    return out


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxic_documents_go(spark, stages):
    given, kept = stages["toxicity"]
    usable = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    scores = Toxicity().fit(given, spark.read.parquet(f"{DATA}/labels.parquet"), usable).score(given).collect()
    low = {r["id"] for r in scores if r["score"] < 0.7}
    assert rows(kept) == Counter({k: n for k, n in rows(given).items() if k[0] in low}) and len(low) < len(scores)


def test_one_of_equal_texts_stays(stages):
    given, kept = stages["exact dedup"]
    best = {}
    for r in given.collect():
        key = (r["text"] or "").translate(LOWER)
        best[key] = max(best.get(key, (-1, None)), (r["doc_id"], r["text"]))
    assert rows(kept) == Counter(best.values())


def test_one_of_each_component_stays(stages):
    given, kept = stages["near dedup"]
    all_rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    component, links = linked_components(all_rows, 2)
    assert rows(kept) == Counter((k, t) for k, t in all_rows if component[k] == k) and links > 0


def test_documents_as_often_as_mixed(stages):
    given, mixed = stages["mixing"]
    copies = {r["id"]: r["copies"] for r in Mixer().mix(given).collect()}
    assert rows(mixed) == Counter({k: copies[k[0]] for k in rows(given) if copies[k[0]]})
    source = {r["doc_id"]: r["source"] for r in given.collect()}
    by_source = {}
    for r in Mixer().mix(given).collect():
        by_source.setdefault(source[r["id"]], []).append(r)
    for own in by_source.values():  # few documents each: as near as a document of usual size allows
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= sorted(r["size"] for r in own)[len(own) // 2]


def test_all_tokens_are_packed(stages):
    given, packed = stages["packing"]
    kept = corpus_pipeline.pack(given).collect()
    check([(r["doc_id"], r["text"]) for r in given.collect()], kept)
    own = lambda rs: Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in rs)
    assert own(packed.collect()) == own(kept)
