"""Jobs that were stopped go on, cached tables are reused until their inputs change, domains meet by equality joins."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tieline.operators import models, retrieval
from tieline.sources import readers, sinks
from tieline.sources.cache import TableCache, files_digest
from tests.conftest import rows


def asked(folder):
    return [t for f in os.listdir(folder) for t in open(f"{folder}/{f}").read().split("\n") if t]


def recorder(folder, stop_at=None, bad=()):
    """Embeds and notes what it was asked; stops its task hard at one text and fails on others."""

    def embed(texts):
        if stop_at in texts:
            raise KeyboardInterrupt("stopped")
        if set(bad) & set(texts):
            raise ValueError("bad batch")
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("\n".join(texts) + "\n")
        return [[float(len(t))] for t in texts]

    return embed


def test_stopped_job_asks_for_no_finished_key(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    df = spark.range(400).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(4)
    log = models.AnswerLog(spark, str(tmp_path / "log"), "id", "bigint", "array<float>")
    with pytest.raises(Exception, match="KeyboardInterrupt"):
        log.run(df, "text", models.embedding_batches(recorder(first, stop_at="t250")), batch=4, flush=1)
    logged = {r["id"] for r in log.read().collect()}
    assert 0 < len(logged) < 400
    out = log.run(df, "text", models.embedding_batches(recorder(second)), batch=4, flush=1)
    again = {int(t[1:]) for t in asked(second)}
    assert not again & logged and again | logged == set(range(400)) and out == {"answered": 400 - len(logged), "failed": 0}
    assert rows(log.read().select("id", F.element_at("result", 1).alias("v")), "id", "v") == [(i, float(len(f"t{i}"))) for i in range(400)]
    assert log.run(df, "text", models.embedding_batches(recorder(second, stop_at="t1"))) == {"answered": 0, "failed": 0}


def test_failed_batches_are_asked_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "x")], "id bigint, text string").coalesce(1)
    log = models.AnswerLog(spark, str(tmp_path / "log"), "id", "bigint", "array<float>")
    assert log.run(df, "text", models.embedding_batches(recorder(notes, bad=["b"])), batch=1) == {"answered": 2, "failed": 1}
    assert rows(log.read(), "id", "failure") == [(1, None), (2, "ValueError: bad batch"), (3, None)]
    assert log.run(df, "text", models.embedding_batches(recorder(notes)), batch=1) == {"answered": 1, "failed": 0}
    assert rows(log.read(), "id", "failure") == [(1, None), (2, None), (3, None)] and sorted(asked(notes)) == ["a", "b"]
    assert log.run(df.limit(0), "text", models.embedding_batches(recorder(notes))) == {"answered": 0, "failed": 0}


def test_payload_answers(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("b", "none")], "id string, prompt string")
    log = models.AnswerLog(spark, str(tmp_path / "log"), "id", "string", "string")
    log.run(df, "prompt", models.payload_answers(lambda p: f"so: {p}", wait=0))
    out = {r["id"]: r for r in log.read().collect()}
    assert json.loads(out["a"]["result"]) == {"k": 1} and out["b"]["failure"] == "no JSON object"


def test_table_cache(spark, tmp_path):
    mail, folder = str(tmp_path / "mail"), str(tmp_path / "cache")
    spark.range(10).write.parquet(mail)
    built = []

    def build():
        built.append(1)
        return {"nodes": spark.read.parquet(mail), "edges": spark.read.parquet(mail).select((F.col("id") * 2).alias("src"))}

    def cache(**params):
        return TableCache(spark, folder, [mail], params)

    assert cache(least=1).get(build)["edges"].count() == 10 and len(built) == 1
    again = cache(least=1).get(build)
    assert again["nodes"].count() == 10 and len(built) == 1 and not any(mail in f for f in again["edges"].inputFiles())
    cache(least=2).get(build)
    assert len(built) == 2
    spark.range(5).write.mode("append").parquet(mail)
    assert cache(least=1).get(build)["nodes"].count() == 15 and len(built) == 3
    # A table that lost a file is not served.
    part = next(f for f in cache(least=1).stored()["edges"].inputFiles())
    os.remove(part.removeprefix("file://"))
    assert cache(least=1).stored() is None
    assert cache(least=1).get(build)["edges"].count() == 15 and len(built) == 4


def test_cut_off_build_is_not_served(spark, tmp_path):
    mail = str(tmp_path / "mail")
    spark.range(3).write.parquet(mail)
    cache = TableCache(spark, str(tmp_path / "cache"), [mail])
    broken = lambda: {"nodes": spark.range(2), "edges": spark.range(2).select(F.raise_error(F.lit("cut off")).alias("x"))}
    with pytest.raises(Exception, match="cut off"):
        cache.get(broken)
    assert cache.stored() is None and cache.get(lambda: {"nodes": spark.range(7)})["nodes"].count() == 7
    assert files_digest(spark, mail)[0] == len([f for f in os.listdir(mail) if f[0] not in "._"])


def test_containing_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("ab.é") for _ in range(rng.randint(a, b)))
    texts = sorted({word(0, 12) for _ in range(300)})
    wanted = [word(0, 7) for _ in range(60)]
    t = spark.createDataFrame([(x,) for x in [*texts, None]], "found string")
    w = spark.createDataFrame([(x.upper(), x) for x in [*wanted, *wanted[:3]]] + [(None, None)], "domain string, low string")
    out = retrieval.containing(t, w)
    assert rows(out, "found", "domain") == sorted({(x, y.upper()) for x in texts for y in wanted if y and y in x})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_json_arrays(spark, tmp_path):
    people = spark.createDataFrame([(f"p{i}", None if i % 2 else f"f{i}") for i in range(50)] + [("same", "x")] * 30, "name string, familyName string")
    sinks.write_json_arrays(people, str(tmp_path / "people"), rows=20)
    files = [f for f in os.listdir(tmp_path / "people") if f.startswith("part") and os.path.getsize(tmp_path / "people" / f)]
    assert len(files) > 1 and all(isinstance(json.load(open(tmp_path / "people" / f)), list) for f in files)
    back = readers.read_people(spark, str(tmp_path / "people"))
    assert rows(back, "name", "family_name") == sorted([(f"p{i}", "" if i % 2 else f"f{i}") for i in range(50)] + [("same", "x")] * 30)
    orgs = spark.createDataFrame([("a.com", 5), ("b.com", None), ("c.com", 9)], "domain string, total_emails bigint")
    sinks.write_json_arrays(orgs, str(tmp_path / "orgs"), field="organizations")
    assert [r["domain"] for r in readers.read_organisations(spark, str(tmp_path / "orgs"), 2).collect()] == ["c.com", "a.com"]
    sinks.write_json_arrays(orgs.limit(0), str(tmp_path / "none"))
