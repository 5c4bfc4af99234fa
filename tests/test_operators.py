"""Golden fixtures and brute-force comparisons on small tables."""

import heapq
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tieline.functions import grading as G
from tieline.functions import text as X
from tieline.functions.payloads import parse_object
from tieline.operators import identity, models, network, ordering, retrieval, sampling, scoring, stats, threads, vectors
from tieline.operators.catalog import build_catalog
from tieline.operators.corpus import clean_mail, resolve_columns
from tieline.sources import readers, sinks

PEOPLE = [
    (0, "Ann Whalley", "Ann", "Whalley", "ann.whalley@x.com", "whalley-a", ""),
    (1, "Lawrence Whalley", "Lawrence", "Whalley", "lw@x.com", "whalley-l", "Greg."),
    (2, "Bill Ray", "Bill", "Ray", "bill.ray@x.com", "", "J."),
]
PEOPLE_COLS = "ord int, name string, given_name string, family_name string, email string, folder_name string, additional_name string"


def test_alias_table(spark):
    a = dict(identity.alias_table(spark.createDataFrame(PEOPLE, PEOPLE_COLS), "x.com", [("a.w.@x.com", "Ann Whalley"), ("z@x.com", "Nobody")]).collect())
    assert a["whalley@x.com"] == "Ann Whalley"  # first claimant keeps the bare surname
    assert a["greg.whalley@x.com"] == a["gregory_whalley@x.com"] == a["larry.whalley@x.com"] == "Lawrence Whalley"
    assert a["whalley-l@x.com"] == "Lawrence Whalley" and a["annn.whalley@x.com"] == "Ann Whalley"
    assert a["william.ray@x.com"] == a["rayb@x.com"] == a["b_ray@x.com"] == "Bill Ray"
    assert a["a.w.@x.com"] == "Ann Whalley" and "z@x.com" not in a and "j.ray@x.com" not in a


def test_resolve(spark):
    aliases = identity.alias_table(spark.createDataFrame(PEOPLE, PEOPLE_COLS), "x.com")
    seen = spark.createDataFrame([(x,) for x in ["ANN_whalley@x.com", "ann-whalley@x.com ", "bill-ray@y.com", "who@x.com"]], "address string")
    got = dict(identity.resolve(seen, aliases, "x.com").collect())
    assert got == {"ANN_whalley@x.com": "Ann Whalley", "ann-whalley@x.com ": "Ann Whalley"}


def test_fuzzy_names_equals_brute_force(spark):
    rnd = random.Random(3)
    base = ["john arnold", "jon arnald", "sara shackleton", "sarah shackelton", "ab", "acb", "kay mann", "kaye mann", "a", "thomas martin"]
    left = base + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 9))).strip() or "x" for _ in range(60)]
    right = base[::-1] + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 9))).strip() or "y" for _ in range(60)]
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {}
    for a in set(left):
        best = max((ratio(a, b), b) for b in set(right))
        if best[0] >= 0.8:
            want[a] = (best[1], best[0])
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r["name"]: (r["match"], r["ratio"]) for r in identity.fuzzy_names(frame(left), frame(right)).collect()}
    assert got == want


def test_fuzzy_names_compares_few_of_many_alike_names(spark, monkeypatch):
    names = [f"Supplier#{i:09d}" for i in range(400)] + ["Supplier" + "#0" * 20 + "1"]
    left = [f"Suplier {i:09d}" for i in range(400)] + ["Suplier" + "#0" * 20 + "1"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    compared, real = [], identity._best_ratio
    monkeypatch.setattr(identity, "_best_ratio", lambda pairs, t: compared.append(pairs.count()) or real(pairs, t))
    got = {r["name"]: (r["match"], r["ratio"]) for r in identity.fuzzy_names(frame(left), frame(names)).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    some = [*left[:400:40], left[-1]]
    assert len(got) == 401 and {a: got[a] for a in some} == {a: max((ratio(a, b), b) for b in names)[::-1] for a in some}
    assert len(compared) == 2 and sum(compared) < 10 * len(left)


def test_clean_mail(spark):
    aliases = identity.alias_table(spark.createDataFrame(PEOPLE, PEOPLE_COLS), "x.com")
    body = "b" * 150
    raw = spark.createDataFrame(
        [("ann.whalley@x.com", " bill.ray@x.com, ,q@z.com", "2000-01-01", "Re: Hi", body), ("ann.whalley@x.com", "q@z.com,bill.ray@x.com", "2000-01-01", "Re: Hi", body),
         ("q@z.com", "r@z.com", "2000-01-01", "x", body), ("q@z.com", "bill.ray@x.com,bill_ray@x.com", "2000-01-02", None, body), ("ann.whalley@x.com", "", "d", "short", "b")],
        "`From` string, `To` string, date string, subject string, body string",
    )
    out = {r["sender_email"]: r for r in clean_mail(raw, aliases, "x.com").collect()}
    assert set(out) == {"ann.whalley@x.com", "q@z.com"}  # repeat, stranger and short mail are gone
    assert out["q@z.com"]["recipients_resolved"] == ["Bill Ray", "Bill Ray"] and out["q@z.com"]["sender_resolved"] is None
    assert len(clean_mail(raw, aliases, "x.com").columns) == 10
    with pytest.raises(ValueError):
        resolve_columns(raw.drop("body"))


def test_sequenced_equals_plain_order(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), rnd.choice([None] + list(range(6))), i) for i in range(80)]
    df = spark.createDataFrame(data, "k string, d int, id int")
    out = ordering.sequenced(df, ["k"], [F.col("d").asc_nulls_last(), F.col("id")], F.coalesce("d", F.lit(99)), ["id"])
    want = []
    for k in "ab":
        mine = sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is None, x[1] or 0, x[2]))
        want += [(x[2], i, mine[i - 1][2] if i else None, len(mine)) for i, x in enumerate(mine)]
    assert rows(out, "id", "position", "prev_id", "n_in_key") == sorted(want, key=lambda x: x[0])


def test_quantiles_and_ranks(spark):
    import numpy as np

    rnd = random.Random(2)
    data = [(rnd.choice("xyz"), float(rnd.choice([1, 2, 2, 5, rnd.random() * 50]))) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double")
    for r in ordering.quantiles(df, "v", [0.1, 0.5, 0.95], ["k"]).collect():
        mine = [v for k, v in data if k == r["k"]]
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.percentile(mine, [10, 50, 95]))
    for r in ordering.value_ranks(df, "v").collect():
        assert r["n_below"] == sum(v < r["v"] for _, v in data) and r["n_equal"] == sum(v == r["v"] for _, v in data)


def _graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, weight long")


EDGES = [("a", "b", 2), ("b", "c", 1), ("a", "c", 4), ("c", "d", 1), ("d", "a", 3), ("d", "e", 1), ("e", "f", 2), ("b", "d", 2), ("x", "y", 1), ("y", "x", 1)]


def _brandes(edges):
    out, names = {}, sorted({n for e in edges for n in e[:2]})
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    score = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, preds, order, heap = {}, {s: 1.0}, {n: [] for n in names}, [], [(0, s)]
        seen = {s: 0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in out.get(v, []):
                nd = d + w
                if u not in dist and (u not in seen or nd < seen[u]):
                    seen[u], sigma[u], preds[u] = nd, 0.0, []
                    heapq.heappush(heap, (nd, u))
                if u in seen and nd == seen[u] and u not in dist:
                    sigma[u] += sigma[v]
                    preds[u].append(v)
        delta = dict.fromkeys(names, 0.0)
        for v in reversed(order):
            for p in preds[v]:
                delta[p] += sigma[p] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    n = len(names)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_equals_brute_force(spark):
    got = {r["node"]: r["betweenness"] for r in network.betweenness(_graph(spark, EDGES)).collect()}
    want = _brandes(EDGES)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_components_and_paths(spark):
    g = _graph(spark, EDGES)
    assert rows(network.components(g), "node", "component") == [(n, "a") for n in "abcdef"] + [("x", "x"), ("y", "x")]
    assert rows(network.strong_components(g), "node", "component") == [(n, "a") for n in "abcd"] + [("e", "e"), ("f", "f"), ("x", "x"), ("y", "x")]
    p = network.path_summary(g).first()
    assert (p["weak_components"], p["largest_size"], p["diameter"]) == (2, 6, 3)
    c = network.clustering(_graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)])).first()
    assert math.isclose(c["avg_clustering"], (1 + 1 + 1 / 3) / 4) and math.isclose(c["transitivity"], 0.6)


def test_pagerank_sums_to_one_and_converges(spark):
    got = {r["node"]: r["pagerank"] for r in network.pagerank(_graph(spark, EDGES)).collect()}
    n = len(got)
    outw = {}
    for s, _, w in EDGES:
        outw[s] = outw.get(s, 0) + w
    r = dict.fromkeys(got, 1 / n)
    for _ in range(200):
        sunk = sum(v for k, v in r.items() if k not in outw)
        new = dict.fromkeys(got, 0.15 / n + 0.85 * sunk / n)
        for s, d, w in EDGES:
            new[d] += 0.85 * r[s] * w / outw[s]
        r = new
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)
    assert all(abs(got[k] - r[k]) < 1e-5 for k in r)


def test_louvain_finds_two_cliques(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 3) for c in "ab" for i in range(5) for j in range(i)]
    out = dict(network.louvain(_graph(spark, cliques + [("a0", "b0", 1)])).collect())
    assert len(set(out.values())) == 2 and len({out[f"a{i}"] for i in range(5)}) == 1
    pairs = network.undirected(_graph(spark, cliques + [("a0", "b0", 1)]))
    member = spark.createDataFrame(list(out.items()), "node string, community string")
    assert network.modularity(pairs, member) > 0.4


def test_vectors_blocks_agree(spark, monkeypatch):
    rnd = random.Random(5)
    items = spark.createDataFrame([(i, [rnd.random() for _ in range(8)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    q = items.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one = rows(vectors.cosine_top_k(items, q, 4), "query_id", "vec_id", "rank")
    mid = vectors.centroids(items)
    near = rows(vectors.nearest_centroid(items, mid), "vec_id", "label")
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 16)
    assert rows(vectors.cosine_top_k(items, q, 4), "query_id", "vec_id", "rank") == one
    assert rows(vectors.nearest_centroid(items, mid), "vec_id", "label") == near
    assert all(r[0] == r[1] for r in one if r[2] == 1)


def test_bootstrap(spark):
    data = [(i, float(i % 2), 0.2) for i in range(400)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    r = stats.bootstrap_interval(df, "a", "id", 400).first()
    assert r["low"] < 0.5 < r["high"] and 0.06 < r["high"] - r["low"] < 0.14
    for mid in (False, True):
        p = stats.paired_bootstrap(df, "a", "b", "id", 300, mid_p=mid).first()
        assert math.isclose(p["mean_delta"], 0.3) and p["low"] > 0.2 and p["p"] == 0.0
    assert stats.bootstrap_interval(df.repartition(7), "a", "id", 400).first() == r


def test_fold_tuning(spark):
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", float(i % 5 - 2), 1.0) for i in range(50)], "a string, b string, diff double, deference double")
    out = scoring.tune_by_fold(pairs).collect()
    assert sum(r["n_test"] for r in out) == 50 and all(r["alpha"] == 2.5 and r["accuracy"] == 1.0 for r in out)


def test_graders(spark):
    cases = [
        ("Answer: 1,234 mails", "integer", "1234", 0.0, True), ("−3.5 overall", "numeric", "-3.5", 0.01, True), ("it is 68.2%", "numeric", "0.68", 0.01, True),
        ("none", "integer", "5", 0.0, False), ("met LAVORATO", "name_in_set", None, None, True), ("x", "judge", None, None, None), ("x", "odd", None, None, False),
    ]
    df = spark.createDataFrame(cases, "a string, k string, v string, tol double, want boolean")
    names = F.array(F.lit("John Lavorato"), F.lit("Al Wu"))
    for r in df.select("want", G.grade(F.col("a"), F.col("k"), F.col("v"), F.col("tol"), names, F.lit(1)).alias("got")).collect():
        assert r["got"] == r["want"]


def test_json_objects():
    assert parse_object('x ```json\n{"a": "}"}\n``` {"b": 1}') == '{"a": "}"}'
    assert parse_object("{bad") is None and parse_object("") is None and parse_object("[1]") is None
    assert parse_object('t {"a": {"b": 2}} {"c": 3}') == '{"a": {"b": 2}}'


def test_imperatives_against_python(spark):
    import re

    from tieline.functions.vocabulary import IMPERATIVES

    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["send ", "go, ", "Let me. ", "! ", "\n", "- Ask ", "é ", "see;", "x "]) for _ in range(12)) for _ in range(60)]

    def count(t):
        n = 0
        for s in re.split(r"[.!?]\s+|\n+", t):
            words = re.sub(r"^[^\w]+", "", s.strip()).split()
            n += bool(words) and words[0].lower().rstrip(",;:") in IMPERATIVES
        return n

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[1] for r in df.select("t", X.imperative_count(F.col("t"))).collect()] == [count(t) for t in texts]


def test_modals_and_persons(spark):
    from tieline.operators.corpus import text_features

    df = spark.createDataFrame([("I will, WILL and can. me YOU Your éme may_be",)], "t string")
    r = text_features(df, "t").first()
    assert {k: v for k, v in r["n_modals"].items() if v} == {"will": 2, "can": 1}
    assert (r["n_first_person"], r["n_second_person"], r["body_word_count"]) == (2, 2, 10)


def test_models(spark):
    df = spark.createDataFrame([(i, f"word{i} text") for i in range(40)], "id int, text string")

    def flaky(batch):
        if "word3 text" in batch:
            raise RuntimeError("down")
        return models.hashing_embedder(8)(batch)

    got = models.embed_column(df.coalesce(1), "id", "text", flaky)
    assert got.count() == 24  # one batch of sixteen is left for the next run
    rest = sinks.remaining(df, got, ["id"])
    assert sinks.remaining(rest, models.embed_column(rest, "id", "text", models.hashing_embedder(8)), ["id"]).isEmpty()

    def answer(prompt):
        if prompt.startswith("word1 "):
            raise TimeoutError("slow")
        return '{"ok": 1}' if prompt.startswith("word2 ") else "no"

    out = {r["id"]: r for r in models.extract_structured(df.where("id < 3"), "id", "text", answer, wait=0.0).collect()}
    assert out[2]["payload"] == '{"ok": 1}' and out[1]["failure"] == "TimeoutError: slow" and out[0]["failure"] == "no JSON object"


def test_catalog(spark):
    mail = spark.createDataFrame([("m1", "A", ["B"], "s", "2001-01-01")], "email_id string, sender string, recipients array<string>, subject string, date string").withColumn("date", F.col("date").cast("timestamp"))
    cat = build_catalog(spark, {"mail": mail})
    assert len(cat.entries) == 14 and len(cat.subset("find_emails", "get_person").describe()) == 2
    assert cat.call("find_emails", sender="A").count() == 1
    for bad in (cat.call("nope"), cat.call("find_emails"), cat.call("find_emails", sender=3), cat.call("get_emails_bulk", ids=["x"] * 21), cat.call("query_sql", sql="DROP TABLE x")):
        assert bad.columns == ["error", "details"] and bad.count() == 1
    with pytest.raises(ValueError):
        retrieval.guarded_sql(spark, "SELECT 1; DELETE FROM x")


def test_sinks_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "id int, v string, w int")
    once = sinks.upsert(old, new, ["id"])
    assert rows(once, "id", "v") == rows(sinks.upsert(once, new, ["id"]), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.skipped(old, new, "id").count() == 1


def test_labelled_sentences(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<root><thread><listno> 7 </listno><DOC><Text><Sent id="1.1">Hi you</Sent><Sent id="1.2">Do it</Sent></Text></DOC></thread></root>')
    (tmp_path / "a.xml").write_text(
        '<root><thread><listno>7</listno><annotation><labels><req id="1.2"/><subj id="1.1"/></labels></annotation>'
        '<annotation><labels><req id="1.2"/><cmt id="1.2"/></labels></annotation></thread></root>'
    )
    out = readers.read_labelled_sentences(spark, str(tmp_path / "c.xml"), str(tmp_path / "a.xml"), {"req": "request", "cmt": "commit"})
    assert rows(out, "sentence_id", "sentence_text", "acts") == [("7/1.1", "Hi you", []), ("7/1.2", "Do it", ["commit", "request"])]


def test_thread_features_null_dates(spark):
    m = spark.createDataFrame([("1", "t", "2001-01-01 00:00:00"), ("2", "t", None), ("3", "t", "2001-01-02 12:00:00")], "email_id string, thread_key string, date string")
    out = {r["email_id"]: r for r in threads.thread_features(m.withColumn("date", F.col("date").cast("timestamp"))).collect()}
    assert [out[i]["thread_position"] for i in "132"] == [0, 1, 2] and out["3"]["reply_latency_hours"] == 36.0 and out["2"]["is_thread_closer"]


def test_persona_picks_swap(spark):
    people = [(f"p{i}", 1, 3, 100 - i) for i in range(5)] + [("high", 2, 5, 3), ("low", 1, 1, 2)]
    out = rows(sampling.persona_picks(spark.createDataFrame(people, "name string, tier int, formality int, volume int")), "name")
    assert out == [("high",), ("low",), ("p0",), ("p1",), ("p2",)]
