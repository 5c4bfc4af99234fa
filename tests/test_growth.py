"""Queries and operators on tables that the given small ones do not resemble."""

import hashlib
import random
import time

import duckdb
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tieline.functions import text
from tieline.operators import corpus, identity, network, ordering, overlap, retrieval, rollups, threads
from tieline.plans.catalogue import ORACLES, QUERIES
from tieline.plans.shapes import Tables
from tieline.sources import readers
from tools.check import run

SF = "/root/testdata/sf0.001"


def test_stylometry_ends_of_texts(spark, tmp_path):
    texts = ["a b.\nJohn Arnold", "Sally,\nx y", "one. two\nAB", "Sent  from my blackberry", "ok.\n--", " \n", "plain text here", "Dear you"]
    rows = [(i, texts[i // 6]) for i in range(6 * len(texts))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    line, ok = run(spark, con, "stylometry", QUERIES["stylometry"], ORACLES["stylometry"], str(tmp_path))
    assert ok, line


def test_clean_mail_carries_forms_of_bodies(spark):
    aliases = spark.createDataFrame([("a@x.com", "Ann")], "alias string, name string")
    body = "word " * 900
    raw = [("a@x.com", ["b@y.com"], "2001-01-01", "s", body + "tail"), ("a@x.com", ["b@y.com"], "2001-01-01", "s", body + "tail, longer")]
    raw = spark.createDataFrame(raw, "`from` string, `to` array<string>, date string, subject string, body string")
    plain = corpus.clean_mail(raw, aliases, "x.com").collect()
    short = corpus.clean_mail(raw, aliases, "x.com", body_form=F.md5).collect()
    assert [(r["body_chars"], r["body_truncated"]) for r in plain] == [(4504, body[:2000])]
    assert [(r["body_chars"], r["body_truncated"]) for r in short] == [(4504, hashlib.md5(body[:2000].encode()).hexdigest())]


def test_alias_rows_are_dealt_out_before_they_multiply(spark, monkeypatch):
    cols = "ord bigint, name string, given_name string, family_name string, email string, folder_name string, additional_name string"
    people = spark.createDataFrame([(i, f"Ann W{i}", "Ann", f"W{i}", f"ann.w{i}@x.com", "", "") for i in range(40)], cols).coalesce(1)
    whole = sorted(identity.alias_table(people, "x.com").collect())
    monkeypatch.setattr(identity, "PEOPLE_A_TASK", 10)
    dealt = identity.alias_table(people, "x.com")
    assert "hashpartitioning(ord" in dealt._jdf.queryExecution().toString() and sorted(dealt.collect()) == whole


def test_contact_is_built_once(spark):
    plan = Tables(spark, SF).contact._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_full_mail_moves_only_its_features(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Tables(spark, SF).mail_full._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan.split("== Initial Plan ==")[-1]
    assert "InMemoryRelation" not in plan and plan.count("hashpartitioning(_key") == 1 and plan.count("hashpartitioning(l_orderkey") == 1


def test_person_rollup_builds_the_mail_once(spark):
    plan = rollups.person_rollup(Tables(spark, SF).mail_full)._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_backfill_moves_a_body_once_a_document(spark):
    plan = QUERIES["body_backfill"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1


def test_longest_mail_is_found_by_two_columns(spark, monkeypatch):
    taken, kind = [], type(spark.range(1))
    real = kind.first
    monkeypatch.setattr(kind, "first", lambda df: taken.append(df.columns) or real(df))
    QUERIES["email_content"](spark, SF)
    assert taken == [["email_id", "body_chars"]]


def test_quoted_lines_are_read_once(spark):
    lines = 20_000
    bodies = ["x\n> y\n" * (lines // 2), "x\n" * lines + "---- Original Message\nz", "a\n -----Forwarded by x\n> b\nc", "> a", "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    began = time.time()
    got = [r["q"] for r in df.select("i", text.quoted_fraction(F.col("body")).alias("q")).orderBy("i").collect()]
    assert time.time() - began < 20  # a look at every line for every line took minutes
    assert got == [(lines // 2) / (lines + 1), 2 / (lines + 2), 0.75, 1.0, 0.0, 0.0]


def test_bigrams_leave_arrow_one_text_at_a_time(spark):
    df = spark.createDataFrame([(1, "abab  ab", "ab"), (2, None, ""), (3, "x", "yz")], "k int, a string, b string")
    out = overlap.bigram_jaccard(df, "k", F.col("a"), F.col("b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan and f"], {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, 0.25), (2, 1.0), (3, 0.0)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_read_from_one_writing_of_the_mails(spark):
    for name in ("bucketed_sample", "resolve_recipient_lists", "thread_read_out"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "l_orderkey" not in plan and "InMemoryRelation" not in plan, name


def test_contacts_are_dealt_out_by_person(spark, monkeypatch):
    names = ["a", "b", "c", "d"]
    edges = spark.createDataFrame([(x, y, i) for i, x in enumerate(names) for y in names if x != y], "src string, dst string, weight int").coalesce(1)
    whole = sorted(map(tuple, retrieval.ranked_contacts(edges, 2).collect()))
    monkeypatch.setattr(ordering, "ROWS_A_TASK", 8)
    dealt = retrieval.ranked_contacts(edges, 2)
    assert "RepartitionByExpression [name" in plan_of(dealt) and sorted(map(tuple, dealt.collect())) == whole and len(whole) == 16
    mail = spark.createDataFrame([("a", ["b", "b", "a", "z"]), ("a", ["b", "c"]), ("b", ["a"])], "sender string, recipients array<string>")
    known = spark.createDataFrame([(x,) for x in names], "node string")
    got = threads.breadth(mail, known)
    assert "RepartitionByExpression [sender" in plan_of(got) and sorted(map(tuple, got.collect())) == [("a", 2), ("b", 1)]
    none = spark.createDataFrame([], "subordinate string, superior string, name string, team string, topic string")
    around = retrieval.person_context(known.toDF("name"), none, none, edges, none)
    assert "RepartitionByExpression [name" in plan_of(around)
    assert around.where("name = 'a'").first()["contacts"][:2] == ["d (3 interactions)", "c (2 interactions)"]


def test_a_file_may_hold_several_transcripts(spark, tmp_path):
    lines = ['{"_header": true, "scenario_name": "s%s", "condition": "c", "transcript": "%s"}' % (i, i) for i in "12"]
    lines += ['{"sender": "a", "turn_id": 0, "body": "x", "transcript": "%s"}' % i for i in "12"]
    (tmp_path / "both.jsonl").write_text("\n".join(lines))
    (tmp_path / "own.jsonl").write_text('{"_header": true, "scenario_name": "s3"}\n{"sender": "a", "turn_id": 0, "body": "y"}')
    rows = readers.read_transcripts(spark, str(tmp_path))
    assert rows_of(rows.select("scenario_name", "body")) == [("s1", "x"), ("s2", "x"), ("s3", "y")] and "transcript" not in rows.columns


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_components_of_chains(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
    edges = spark.createDataFrame([*chain, ("n06", "n04"), ("x", "x"), ("y", "z")], "src string, dst string")
    weak = {r["node"]: r["component"] for r in network.components(edges).collect()}
    strong = {r["node"]: r["component"] for r in network.strong_components(edges).collect()}
    assert weak == {f"n{i:02d}": "n00" for i in range(13)} | {"x": "x", "y": "y", "z": "y"}
    assert strong == {n: "n04" if n in ("n05", "n06") else n for n in weak}


def test_triangles_come_from_lists(spark):
    draw = random.Random(4)
    pairs = {(draw.randrange(30), draw.randrange(30)) for _ in range(200)} | {(0, i) for i in range(30)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 2) for a, b in pairs] + [("n1", "n1", 1), ("x", "y", 1), (None, "y", 1)], "src string, dst string, weight int")
    ends = {}
    for a, b in [*((f"n{a}", f"n{b}") for a, b in pairs if a != b), ("x", "y")]:
        ends.setdefault(a, set()).add(b)
        ends.setdefault(b, set()).add(a)
    got = network.triangles(edges)
    assert "array_intersect" in plan_of(got) and got.dtypes == [("node", "string"), ("degree", "bigint"), ("triangles", "bigint")]
    assert rows_of(got) == sorted((v, len(n), sum(len(n & ends[w]) for w in n) // 2) for v, n in ends.items())


def test_ranks_move_links_as_lists(spark, monkeypatch):
    draw = random.Random(6)
    pairs = {(draw.randrange(20), draw.randrange(40)) for _ in range(150)} | {(0, i) for i in range(1, 40)}
    edges = [(f"n{a}", f"n{b}", draw.randrange(1, 5)) for a, b in sorted(pairs)]
    names, out = sorted({x for a, b, _ in edges for x in (a, b)}), {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    want = {v: 1 / len(names) for v in names}
    for _ in range(5):
        sunk = sum(r for v, r in want.items() if v not in out)
        flow = dict.fromkeys(names, 0.0)
        for a, b, w in edges:
            flow[b] += want[a] * w / out[a]
        want = {v: 0.85 * flow[v] + (0.15 + 0.85 * sunk) / len(names) for v in names}
    lists, real = [], network.cut_lineage

    def seen(df):
        done = real(df)
        if "ids" in done.columns:
            lists.append([len(r["ids"]) for r in done.select("ids").collect()])
        return done

    monkeypatch.setattr(network, "cut_lineage", seen)
    table = spark.createDataFrame(edges, "src string, dst string, weight bigint")
    for limit in (network.LINKS_A_ROW, 8):
        monkeypatch.setattr(network, "LINKS_A_ROW", limit)
        got = dict(network.pagerank(table, tol=0, max_iter=5).collect())
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert [sum(x) for x in lists] == [len(edges)] * 2 and len(lists[0]) == len(out) < len(lists[1])
