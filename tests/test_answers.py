import datetime as dt

import pytest

from marlstone.streaming import answers

SHAPE = "session long, seq long, delta string, error string, done boolean, at timestamp"
T0 = dt.datetime(2024, 1, 1)


def part(session, seq, delta=None, error=None, done=None, minute=0):
    return (session, seq, delta, error, done, T0 + dt.timedelta(minutes=minute))


def told(spark, folder, batches, **more):
    """Runs a stream over batches, a file each, and gives the sessions as they end."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    write = lambda df, n: df.selectExpr("*", f"{n} AS batch").write.mode("append").parquet(f"{folder}/out")
    answers.start(source, f"{folder}/state", more.pop("write", write), **more).awaitTermination(300)
    return ends(spark, folder)


def ends(spark, folder):
    return sorted(tuple(r) for r in answers.latest(spark.read.parquet(f"{folder}/out")).collect())


def test_parts_out_of_order_repeated_and_late(spark, tmp_path):
    first = [part(1, 2, "c"), part(1, 0, "aaaa"), part(2, 0, "x"), part(None, 0, "no session"), part(3, None, "no seq"), part(4, 0, None), part(5, 1, "waits")]
    second = [part(1, 1, "bbbbbbbb"), part(1, 0, "other"), part(2, 1, "", done=True), part(4, 1, "")]
    third = [part(1, 3, "d", done=True), part(2, 2, "after the end"), part(1, 2, "again")]
    # later batches bring the watermark past the others' time
    fourth, fifth = [part(9, 0, "late", minute=60)], [part(9, 1, "r", done=True, minute=61)]
    got = told(spark, tmp_path, [first, second, third, fourth, fifth])
    assert got == [(1, "aaaabbbbbbbbcd", 4, 3, "closed"), (2, "x", 1, 0, "closed"), (4, "", 0, 0, "timed out"), (5, "waits", 1, 1, "timed out"), (9, "later", 2, 1, "closed")]


def test_errors_end_an_answer(spark, tmp_path):
    got = told(spark, tmp_path, [[part(1, 0, "so far "), part(1, 1, error="no model"), part(1, 2, "lost")], [part(1, 3, "lost too")]])
    assert got == [(1, "so far Error: no model", 2, 1 + len("Error: no model") // 4, "failed")]


def test_a_restart_goes_on_from_its_checkpoint(spark, tmp_path):
    """A sink that breaks in the second batch; the rerun ends as if nothing had happened."""
    batches = [[part(1, 0, "a"), part(2, 1, "z")], [part(1, 1, "b"), part(2, 0, "y")], [part(1, 2, "c", done=True), part(2, 2, "!", done=True)]]

    def broken(df, n):
        if n == 1:
            raise RuntimeError("the sink is gone")
        df.selectExpr("*", f"{n} AS batch").write.mode("append").parquet(f"{tmp_path}/out")

    with pytest.raises(Exception, match="the sink is gone"):
        told(spark, tmp_path, batches, write=broken)
    assert ends(spark, tmp_path) == [(1, "a", 1, 0, "open"), (2, "", 0, 0, "open")]
    assert told(spark, tmp_path, []) == [(1, "abc", 3, 0, "closed"), (2, "yz!", 3, 0, "closed")]
    assert spark.conf.get(answers._PROVIDER[0], "") != answers._PROVIDER[1]
