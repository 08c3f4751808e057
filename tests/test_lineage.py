"""Tracing back and forth over staged programs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from backtrail.operators import faults, ratings, text
from backtrail.plans import groups, programs
from backtrail.plans.lineage import Traced
from backtrail.sources import parsers as P


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(11)
    data = [
        (i // 4, i % 4, " ".join(rng.choices(["the", "of", "oak", "elm", "ash"], [9, 5, 1, 1, 1], k=5)))
        for i in range(40)
    ]
    return spark.createDataFrame(data, "doc_id long, line_no int, value string")


def ids(df):
    return sorted((r.doc_id, r.line_no) for r in df.collect())


def holding(lines, word):
    return sorted((r.doc_id, r.line_no) for r in lines.collect() if word in r.value.split())


@pytest.fixture(params=["small", "large"])
def key_sizes(request, monkeypatch):
    """Run with key sets that are broadcast, and with ones treated as too large."""
    if request.param == "large":
        monkeypatch.setattr(groups, "SMALL_BYTES", -1)


@pytest.mark.parametrize("captured", [False, True])
def test_back_reaches_exactly_the_contributing_lines(lines, captured, key_sizes):
    t = programs.word_count(lines, ["doc_id", "line_no"])
    t = t.captured() if captured else t
    cursor = t.lineage().where(F.col("word") == "oak")
    assert ids(cursor.back_all().rows()) == holding(lines, "oak")
    assert ids(t.lineage().where_id("oak").back(2).rows()) == holding(lines, "oak")
    step = cursor.back(1)
    assert {r.word for r in step.rows().collect()} == {"oak"}
    assert step.count() == sum(r.value.split().count("oak") for r in lines.collect())


def test_rerunning_the_traced_inputs_reproduces_the_output(lines):
    t = programs.word_count(lines, ["doc_id", "line_no"])
    want = {r.word: r["count"] for r in t.result().collect()}
    traced = t.lineage().where_id("elm").back_all().rows()
    again = {r.word: r["count"] for r in text.word_count(traced).collect()}
    assert again["elm"] == want["elm"]
    assert t.lineage().back_all().count() >= traced.count()


def test_forward_all_then_back_all_covers_the_start(lines, key_sizes):
    t = programs.word_count(lines, ["doc_id", "line_no"])
    start = t.inputs().where_id(0, 1)
    words = {r.word for r in start.forward_all().rows().collect()}
    assert words == set(lines.filter("doc_id = 0 AND line_no = 1").first().value.split())
    assert (0, 1) in ids(start.forward_all().back_all().rows())
    # One step forward gives the words of the line, and those only.
    assert start.forward().count() == 5


def test_outputs_traced_apart(lines, key_sizes):
    t = programs.word_count(lines, ["doc_id", "line_no"])
    rows = t.lineage().where(F.col("word").isin("oak", "ash")).back_all_per_output().collect()
    for word in ("oak", "ash"):
        got = sorted((r.doc_id, r.line_no) for r in rows if r["__out"].word == word)
        assert got == holding(lines, word)


def test_two_aggregations(spark, lines, key_sizes):
    docs = lines.select(F.col("doc_id").alias("doc"), "line_no", F.col("value").alias("content"))
    t = programs.term_vector(docs, ["doc", "line_no"], min_count=3)
    frequent = Counter()
    for r in lines.collect():
        frequent.update((r.doc_id, w) for w in r.value.split())
    want = sorted(
        (r.doc_id, r.line_no) for r in lines.collect()
        if r.doc_id == 3 and any(frequent[3, w] >= 3 for w in r.value.split())
    )
    back = t.lineage().where_id(3).back_all().rows()
    assert sorted((r.doc, r.line_no) for r in back.collect()) == want
    apart = t.lineage().where(F.col("doc") < 2).back_all_per_output()
    assert {(r["__out"].doc, r.doc) for r in apart.collect()} == {(0, 0), (1, 1)}


def test_resume_at_the_grouping(spark):
    edges = P.parse_edges(spark.createDataFrame([(v,) for v in ("a,b", "a,c", "b,c", "d,e")], "value string"))
    edges = edges.withColumn("edge_no", F.monotonically_increasing_id())
    t = programs.adjacency(edges, ["edge_no"])
    cursor = t.lineage().where(F.col("out_degree") > 1).back_all()
    assert sorted((r.src, r.dst) for r in cursor.rows().collect()) == [("a", "b"), ("a", "c")]
    facts = cursor.forward(1)
    again = t.rerun_from("facts", facts.rows()).drop("__lid")
    assert {r.vertex: (r.in_degree, r.out_degree) for r in again.collect()} == {
        "a": (0, 2), "b": (1, 0), "c": (1, 0),
    }


def test_both_sides_of_a_join(spark):
    reviews = P.parse_ratings(spark.createDataFrame(
        [("1:10_5,11_3,13_1",), ("2:10_1,12_4",), ("4:99_5",)], "value string"))
    model = P.parse_centroids(spark.createDataFrame(
        [("0 0.0 100 2 10_5,11_3",), ("1 0.0 200 2 12_4,26_1",)], "value string"))
    t = programs.classification(reviews, ["movie_id", "pos"], model)
    assert sorted(map(tuple, t.result().collect())) == [(0, 2), (1, 1)]
    cluster = t.lineage().where(faults.smaller_than(2))
    back = cluster.back_all().rows()
    assert sorted((r.movie_id, r.pos) for r in back.collect()) == [(1, 0), (1, 1), (1, 2)]
    for cursor in (cluster.back(2).back(1, side="centroids"), cluster.back(3, side="centroids")):
        assert sorted((r.cluster_id, r.rater_id) for r in cursor.rows().collect()) == [(1, 10), (1, 11)]
    with pytest.raises(ValueError, match="no join"):
        cluster.back(2, side="centroids")


def test_forward_from_the_other_side_of_a_join(spark):
    reviews = P.parse_ratings(spark.createDataFrame([("1:10_5,11_3",), ("2:12_4",), ("4:99_5",)], "value string"))
    model = P.parse_centroids(spark.createDataFrame(
        [("0 0.0 100 2 10_5,11_3",), ("1 0.0 200 2 12_4,26_1",)], "value string"))
    t = programs.classification(reviews, ["movie_id", "pos"], model)
    side = t.stages[t.index("matches")].sides["centroids"].lineage()
    met = side.where(F.col("rater_id").isin(10, 11)).forward_into(t, "matches", "centroids")
    assert [r.movie_id for r in met.forward(1).rows().collect()] == [1]
    assert [r.cluster_id for r in met.forward_all().rows().collect()] == [1]
    with pytest.raises(ValueError, match="no side"):
        side.forward_into(t, "movies", "centroids")


def test_repeated_and_foreign_identities(spark):
    words = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, value string")
    t = programs.word_count(words, ["doc_id"])
    chosen = t.lineage().where(spark.createDataFrame([(("a",),), (("a",),), (("zzz",),)], "__lid struct<word:string>"))
    assert chosen.count() == chosen.rows().count() == 1
    assert [r.doc_id for r in chosen.back_all().rows().collect()] == [1]


def test_a_new_centroid_depends_on_all_members(spark):
    reviews = P.parse_ratings(spark.createDataFrame([("1:10_5",), ("2:10_1,12_4",)], "value string"))
    model = P.parse_centroids(spark.createDataFrame([("0 0 9 1 10_5",)], "value string"))
    assigned = ratings.classify(reviews, model)
    t = programs.recentring(assigned, reviews)
    members = t.lineage().back_all().rows()
    assert sorted(r.movie_id for r in members.collect()) == [1, 2]


def test_null_group_keys_are_traced(spark, key_sizes):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id long, k string")
    t = Traced.source(df, ["id"]).group("g", ["k"], lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert sorted(r.id for r in t.lineage().where(F.col("n") == 2).back_all().rows().collect()) == [1, 3]


def test_remaining_programs_trace(spark, lines):
    docs = lines.select(F.col("doc_id").cast("string").alias("doc"), "doc_id", "line_no",
                        F.col("value").alias("content"))
    for t in (programs.sequence_count(docs, ["doc_id", "line_no"]),
              programs.inverted_index(docs, ["doc_id", "line_no"]),
              programs.grep_count(lines, ["doc_id", "line_no"], "o[af]")):
        one = t.with_id().select("__lid").limit(1)
        traced = t.lineage().where(one).back_all().rows()
        assert 0 < traced.count() <= 40
    counts = text.sequence_count(docs).withColumn("n", F.col("count"))
    t = programs.ranked_inverted_index(counts, ["phrase", "doc"])
    assert t.lineage().where(F.col("n_docs") > 1).back_all().count() > 0
    numbers = spark.createDataFrame([(i, float(i)) for i in (0, 5, 50, 99, 500)], "id long, n double")
    t = programs.categories(numbers, ["id"], "n", 0, 400)
    assert [r.id for r in t.lineage().where(F.col("category") == "Small").back_all().rows().orderBy("id").collect()] == [5, 50, 99]
    t = programs.histogram(P.parse_ratings(spark.createDataFrame([("1:1_5,2_5,3_1",)], "value string")),
                           ["movie_id", "pos"])
    assert t.lineage().where_id(5).back_all().count() == 2


def scanned(frame):
    """Rows that the plan's file scans gave, after it has run."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        node = leaves.apply(i)
        node = node.plan() if hasattr(node, "plan") and "QueryStage" in node.nodeName() else node
        text = node.nodeName()
        if text.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_captured_links_are_read_for_the_chosen_keys_only(spark):
    rows = [(i, f"w{i % 400:03d} w{(i * 7) % 400:03d} x") for i in range(4000)]
    rows += [(4000, None)]
    plain = programs.word_count(spark.createDataFrame(rows, "id long, value string"), ["id"])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        captured = plain.captured()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    links = captured.stages[-1].links
    keys = captured.lineage().where_id("w123")
    ids = keys.back(1).ids
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "w123" in plan
    assert sorted(map(str, ids.collect())) == sorted(map(str, plain.lineage().where_id("w123").back(1).ids.collect()))
    some = captured.lineage().where(F.col("word").between("w100", "w139"))
    assert sorted(r.id for r in some.back_all().rows().collect()) == sorted(
        r.id for r in plain.lineage().where(F.col("word").between("w100", "w139")).back_all().rows().collect())
    read = links.filter(F.col("__out")["word"] == "w123")
    assert 0 < scanned(read) < links.count() / 10
    out = captured.lineage().where(F.col("word").isin("w001", "w399")).back_all_per_output()
    want = plain.lineage().where(F.col("word").isin("w001", "w399")).back_all_per_output()
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() > 20


def test_scratch_tables_are_dropped_with_their_block(spark, tmp_path):
    import os

    from backtrail import session

    before = session.stored(spark.range(5), "kept")
    with session.scratch(spark):
        inside = session.stored(spark.range(7), "inside")
        with session.scratch(spark):
            session.stored(spark.range(3), "nested")
        inside.write.parquet(str(tmp_path / "out"))
        (path,) = {os.path.dirname(f) for f in inside.inputFiles()}
    assert not os.path.exists(path.removeprefix("file:")) and session._open_blocks == []
    assert before.count() == 5 and spark.read.parquet(str(tmp_path / "out")).count() == 7
    with pytest.raises(ValueError), session.scratch(spark):
        lost = session.stored(spark.range(2), "lost").inputFiles()[0]
        raise ValueError
    assert not os.path.exists(lost.removeprefix("file:"))


def test_records_met_by_a_step_are_not_looked_up_again(spark):
    """The words behind some counts come from the one join with the chosen words."""
    lines = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "c c d")], "id long, value string")
    cursor = programs.word_count(lines, ["id"]).lineage().where(F.col("count") == 2).back(1)
    found = cursor.rows()
    assert sorted((r["__lid"]["main"]["id"], r["__lid"]["pos"], r.word) for r in found.collect()) == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(r.id for r in cursor.where(F.col("word") == "b").rows().select(F.col("__lid.main.id")).collect()) == [0, 1]
    assert sorted(r.id for r in cursor.back(1).rows().select("id").collect()) == [0, 1]


@pytest.mark.parametrize("program", [programs.sequence_count, programs.term_vector])
def test_counts_within_a_document_exchange_its_records_only(spark, program):
    docs = spark.createDataFrame([(0, "a", "x y z x y z"), (1, "a", "x y z x"), (2, "b", "x y z")],
                                 "id long, doc string, content string")
    rows = program(docs, ["id"]).rows()
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 1 and "(doc#" in exchanges[0]


def exchanged(frame):
    """Rows that the exchanges of the plan wrote, after it has run."""
    frame.collect()

    def under(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return under(node.executedPlan())
        if "QueryStage" in name:
            return under(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(under(node.children().apply(i)) for i in range(node.children().size()))

    return under(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("captured", [False, True])
def test_of_too_many_keys_the_frequent_ones_are_not_exchanged(spark, monkeypatch, captured):
    """a key set too large for a broadcast made every word go through an exchange."""
    data = [(i, f"the r{i // 3} of the of a{i} the") for i in range(960)] + [(960, "b0"), (961, None)]
    lines = spark.createDataFrame(data, "id long, value string")
    monkeypatch.setattr(groups, "SMALL_ROWS", 100)
    t = programs.word_count(lines, ["id"])
    t = t.captured() if captured else t
    words = [(i, w) for i, v in data if v for w in v.split()]
    seen = Counter(w for _, w in words)
    for chosen, want in ((F.col("count") >= 3, {w for w in seen if seen[w] >= 3}),
                         (F.col("count") == 3, {w for w in seen if seen[w] == 3}),
                         (F.col("count") < 3, {w for w in seen if seen[w] < 3})):
        cursor = t.lineage().where(chosen)
        step = cursor.back(1)
        assert sorted((r.i, r.word) for r in step.rows().select(F.col("__lid.main.id").alias("i"), "word").collect()) == sorted(
            (i, w) for i, w in words if w in want)
        assert sorted(r.id for r in step.back(1).rows().collect()) == sorted({i for i, w in words if w in want})
        out = cursor.back_all_per_output().select(F.col("__out.word").alias("word"), "id")
        assert sorted((r.id, r.word) for r in out.collect()) == sorted({(i, w) for i, w in words if w in want})
        if not captured:
            assert exchanged(step.rows()) < len(words) / 2
    assert sum(n for w, n in seen.items() if n > 3) > len(words) / 2


def test_keys_of_rows_that_are_as_many_meet_in_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(groups, "SMALL_ROWS", 10)
    rows = spark.range(400).withColumnRenamed("id", "k")
    assert groups.frequent_keys(rows, ["k"]) is None
    keys = groups.measure(rows.filter("k % 2 = 0"))
    ((same, held),) = groups.meeting(rows, keys, ["k"], rows)
    assert same is rows and held is keys
    assert groups.keep_matching(same, held, ["k"]).count() == 200


def test_given_identities_are_not_looked_up_before_a_step_back(spark, monkeypatch):
    """a step back from given outputs went through all inputs twice."""
    lines = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, None)], "id long, value string")
    t = programs.word_count(lines, ["id"])
    given = spark.createDataFrame([(("a",),), (("a",),), (("zzz",),), ((None,),), (None,)], "__lid struct<word:string>")
    computed = []
    plain = groups.durable
    monkeypatch.setattr(groups, "durable", lambda df: computed.append(df) or plain(df))
    cursor = t.lineage().where(given)
    back = cursor.back(1)
    assert len(computed) == 1
    assert sorted(r["__lid"].pos for r in back.rows().collect()) == [0, 2] and cursor.count() == 1
    assert [r.id for r in back.back(1).rows().collect()] == [0]
    assert [r.id for r in t.captured().lineage().where(given).back_all().rows().collect()] == [0]
    assert cursor.where(F.col("word") == "b").back_all().count() == 0


def test_given_identities_of_no_output_are_not_traced(spark):
    """An aggregation that loses keys has no output for them, though its inputs have the key."""
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, k string")
    t = Traced.source(df, ["id"]).group("g", ["k"], lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    given = spark.createDataFrame([(("x",),), (("y",),)], "__lid struct<k:string>")
    assert sorted(r.id for r in t.lineage().where(given).back_all().rows().collect()) == [2, 3]


def exchanged_by(column, plan):
    """Rows that the exchanges of a plan by a column wrote, after it has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return exchanged_by(column, plan.executedPlan())
    if "QueryStage" in name:
        return exchanged_by(column, plan.plan())
    here = name == "Exchange" and column in plan.simpleString(1000).split("plan_id")[0]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if here else 0
    return own + sum(exchanged_by(column, plan.children().apply(i)) for i in range(plan.children().size()))


def phrase_counts(spark):
    """Phrases of one to three documents, a null one of three and one of 200; most are of one."""
    rows = [(f"a{i}", "0", 1) for i in range(5000)]
    rows += [(f"b{i}", str(d), 1 + d) for i in range(300) for d in range(2)]
    rows += [(f"c{i}", str(d), 1 + d) for i in range(300) for d in range(3)]
    rows += [(None, str(d), 2) for d in range(3)] + [("the", str(d), 1) for d in range(200)]
    return rows, spark.createDataFrame(rows, "phrase string, doc string, count long")


@pytest.mark.parametrize("chosen, sizes", [
    ("n_docs > 2", {3, 200}), ("n_docs = 2", {2}), ("n_docs < 2", {1}), ("n_docs > 100", {200}), ("n_docs % 2 = 0", {2, 200}),
    ("n_docs > 200", set()), ("1 / (n_docs - 64) > 0", {200}), ("n_docs = 3 and top_count > 0", {3}), ("n_docs is null", set())])
def test_groups_chosen_by_their_size(spark, key_sizes, chosen, sizes):
    rows, df = phrase_counts(spark)
    size = Counter(phrase for phrase, _, _ in rows)
    cursor = programs.ranked_inverted_index(df, ["phrase", "doc"]).lineage().where(F.expr(chosen)).back_all()
    found = cursor.rows()
    assert Counter(map(tuple, found.select("phrase", "doc", "count").collect())) == Counter(r for r in rows if size[r[0]] in sizes)
    assert found.columns == ["phrase", "doc", "count", "__lid"]
    assert cursor.count() == sum(size[r[0]] in sizes for r in rows)


def test_only_rows_of_groups_that_may_be_large_enough_are_exchanged(spark, monkeypatch):
    """with as many keys as large tables have, all rows were exchanged."""
    monkeypatch.setattr(groups, "SMALL_BYTES", -1)
    rows, df = phrase_counts(spark)
    found = programs.ranked_inverted_index(df, ["phrase", "doc"]).lineage().where(F.col("n_docs") > 2).back_all().rows()
    kept = 300 * 3 + 3 + 200
    assert len(found.collect()) == kept
    assert kept <= exchanged_by("phrase", found._jdf.queryExecution().executedPlan()) < kept + 100 < len(rows) / 5
