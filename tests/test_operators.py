"""Operators against hand-written results and brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from backtrail.operators import checks, faults, graph, numeric, ratings, sets, sorting, text
from backtrail.plans.groups import keep_matching, number_rows
from backtrail.sources import parsers as P


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "of", "tree", "Index", "a", "Doc", "x,y", "naïve"]
    weights = [30, 10, 5, 3, 3, 2, 1, 1]
    return [
        (f"d:{rng.randrange(6)}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 14))))
        for _ in range(60)
    ]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc string, content string").withColumn(
        "rec", F.monotonically_increasing_id()
    )


def test_word_count_and_by(spark):
    df = lines(spark, "a b  a ", "", "  ", "b")
    assert rows(text.word_count(df)) == [("", 2), ("a", 2), ("b", 2)]
    halves = df.withColumn("half", F.length("value") > 1)
    assert ("b", 1) in rows(text.word_count(halves, ["half"]).filter("half"), "word", "count")
    assert rows(text.word_count(lines(spark, "\ta b "), trimmed=True)) == [("a", 1), ("b", 1)]


def test_grep_counts_whole_matches(spark):
    df = lines(spark, "Eigen EigenV name", "lame", "none")
    assert rows(text.grep_count(df, "am[ei]")) == [("ame", 2)]
    assert rows(text.grep_count(df, "Eig[a-z]+")) == [("Eigen", 2)]


def test_sequence_count(docs, corpus):
    want = Counter()
    for doc, content in corpus:
        w = content.split()
        for i in range(len(w) - 2):
            want["|".join(w[i : i + 3]), doc] += 1
    got = {(r.phrase, r.doc): r["count"] for r in text.sequence_count(docs).collect()}
    assert got == dict(want)


def spaced(content):
    """Words between single spaces; inner empties are words."""
    kept = content.rstrip(" ")
    return [] if content and not kept else kept.split(" ")


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("max_group", [200_000, 3, None])
def test_inverted_index(docs, corpus, distinct, max_group):
    want = defaultdict(list)
    for doc, content in corpus:
        for w in spaced(content):
            want[w].append(doc)
    want = {w: sorted(set(d) if distinct else d) for w, d in want.items()}
    got = defaultdict(list)
    for r in sorted(text.inverted_index(docs, distinct, max_group=max_group).collect(),
                    key=lambda r: (r.word, r.segment)):
        got[r.word] += r.docs
        if max_group:
            assert 0 < len(r.docs) <= max_group * (1 if distinct else 2)
    assert dict(got) == want


@pytest.mark.parametrize("max_group", [200_000, 2])
def test_ranked_inverted_index(docs, max_group):
    counts = text.sequence_count(docs)
    want = defaultdict(list)
    for r in counts.collect():
        want[r.phrase].append((-r["count"], r.doc))
    got = defaultdict(list)
    ranked = text.ranked_inverted_index(counts, max_group=max_group)
    for r in ranked.orderBy("phrase", "segment").collect():
        got[r.phrase] += [(-p["count"], p.file) for p in r.postings]
        assert len(r.postings) <= max_group
    assert dict(got) == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("max_group", [200_000, 2])
@pytest.mark.parametrize("per", [["doc"], ["doc", "rec"]])
def test_term_vector(docs, per, max_group):
    want = defaultdict(Counter)
    for r in docs.collect():
        want[tuple(r[c] for c in per)].update(spaced(r.content))
    want = {
        k: sorted((-n, t) for t, n in c.items() if n >= 2)
        for k, c in want.items() if any(n >= 2 for n in c.values())
    }
    got = defaultdict(list)
    found = text.term_vector(docs, per=per, max_group=max_group)
    for r in found.orderBy(*per, "segment").collect():
        got[tuple(r[c] for c in per)] += [(-t["count"], t.term) for t in r.terms]
    assert dict(got) == want


@pytest.mark.parametrize("limit", [200_000, 2, 1])
def test_adjacency(spark, limit):
    edges = P.parse_edges(lines(spark, "a,b", "a,c", "b,c", "a,b", "bad", "x,y,z", "a,d"))
    want = {
        "a": ([], ["b", "c", "d"]), "b": (["a"], ["c"]), "c": (["a", "b"], []),
        "d": (["a"], []), "x,y": ([], ["z"]), "z": (["x,y"], []),
    }
    got = {r.vertex: (r["from"], r["to"]) for r in graph.adjacency_list(edges, limit).collect()}
    assert got == {v: (f[:limit], t[:limit]) for v, (f, t) in want.items()}
    assert rows(graph.degrees(edges)) == sorted((v, len(f), len(t)) for v, (f, t) in want.items())
    texts = graph.adjacency_list(edges).select("vertex", graph.adjacency_text().alias("t"))
    assert ("a", "from{}:to{b,c,d}") in rows(texts)


RATING_LINES = ["1:10_5,11_3,13_1", "2:10_1,12_4", "3:11_2,26_1", "4:99_5", "5:10_1,11_5",
                "6:10_5", ":bad", "nocolon"]


@pytest.fixture(scope="module")
def reviews(spark):
    return P.parse_ratings(lines(spark, *RATING_LINES))


@pytest.fixture(scope="module")
def centroids(spark):
    return P.parse_centroids(lines(spark, "0 0.0 100 2 10_5,11_3", "1 0.0 200 2 12_4,26_1"))


def test_histogram_and_omission_faults(reviews):
    assert rows(ratings.ratings_histogram(reviews)) == [(1, 4), (2, 1), (3, 1), (4, 1), (5, 4)]
    seeded = ratings.ratings_histogram(faults.drop_low_ratings(reviews))
    assert rows(seeded) == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 4)]


def test_classify_members_and_recentre(reviews, centroids):
    assigned, centres = ratings.kmeans_step(reviews, centroids)
    got = {r.movie_id: (r.cluster_id, round(r.similarity, 6)) for r in assigned.collect()}
    assert got == {1: (1, 1.0), 2: (0, 1.0), 3: (0, 1.0), 4: (0, 0.0),
                   5: (1, round(20 / math.sqrt(884), 6)), 6: (1, 1.0)}
    members = ratings.cluster_members(assigned)
    assert rows(members) == [(0, 0, [2, 3, 4]), (1, 0, [1, 5, 6])]
    pieces = ratings.cluster_members(assigned, max_group=2)
    assert rows(pieces) == [(0, 0, [2, 3]), (0, 1, [4]), (1, 0, [1, 5]), (1, 1, [6])]
    assert rows(centres, "cluster_id", "movie_id", "n_reviews", "reviews") == [
        (0, 2, 2, "10_1,12_4"), (1, 1, 3, "10_5,11_3,13_1"),
    ]
    shifted = faults.shift_cluster(assigned)
    assert rows(shifted.filter("movie_id = 1"), "cluster_id") == [(2,)]


def test_centroid_uses_first_review_within_total(spark):
    model = P.parse_centroids(lines(spark, "0 0 9 2 10_5,10_1,11_3"))
    assert rows(ratings.centroid_reviews(model)) == [(0, 10, 5)]


def test_recentre_cuts_long_lines(spark):
    line = "7:" + ",".join(f"{1000 + i}_{1 + i % 5}" for i in range(400))
    reviews = P.parse_ratings(lines(spark, line))
    model = P.parse_centroids(lines(spark, "0 0 1 1 1000_1"))
    _, centre = ratings.kmeans_step(reviews, model)
    cut = line[: line.index(",", 1000)].split(":")[1]
    assert rows(centre, "n_reviews", "reviews") == [(len(cut.split(",")), cut)]


def test_numeric(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 50, 99.5, 100, 500, 1000)], "n double")
    got = numeric.range_stats(df, "n", 0, 100).first()
    assert (got["count"], got["total"]) == (3, 159.5)
    assert (round(got["mean"], 4), round(got["stddev"], 4)) == (53.1667, 36.6068)
    assert rows(numeric.category_stats(df, "n")) == [
        ("Large", 1, 1000.0), ("Medium", 2, 600.0), ("Small", 4, 159.5),
    ]
    assert numeric.filter_range(df, "n", 10, 100, "both").count() == 4
    assert numeric.filter_range(df, "n", 10, 100, "left").count() == 3


def test_terasort_with_copies(spark, monkeypatch):
    rng = random.Random(3)
    data = [("hot", "same")] * 40 + [(rng.choice("abcxyz"), str(rng.randrange(9))) for _ in range(30)]
    df = spark.createDataFrame(data, "key string, value string").repartition(5)
    assert [tuple(r) for r in sorting.terasort(df).collect()] == sorted(data)
    ids = df.distinct()
    by_value = [tuple(r) for r in sorting.terasort(ids, tiebreak=["value"]).collect()]
    assert by_value == sorted(set(data))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_number_rows_without_gathering(spark, keys):
    rng = random.Random(5)
    data = [(rng.choice([None, "hot", "hot", "hot", "b"]), i) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v long").repartition(6)
    want = defaultdict(list)
    for k, v in data:
        want[k if keys else ""].append((v,) if keys else ((k is not None, k or ""), v))
    got = defaultdict(list)
    for r in number_rows(df, keys, ["v"] if keys else ["k", "v"]).orderBy("__rn").collect():
        got[r.k if keys else ""].append((r["__rn"], r.v))
    for key, items in want.items():
        assert got[key] == [(i + 1, item[-1]) for i, item in enumerate(sorted(items))]


def test_keep_matching_when_keys_are_not_small(spark, monkeypatch):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    keys = spark.createDataFrame([(None,), ("a",)], "k string")
    from backtrail.plans import groups

    for limit in (groups.SMALL_BYTES, -1):
        monkeypatch.setattr(groups, "SMALL_BYTES", limit)
        assert sorted(r.v for r in keep_matching(df, keys, ["k"]).collect()) == [1, 2]
        assert [r.v for r in keep_matching(df, keys, ["k"], anti=True).collect()] == [3]


def test_copies_spread_over_the_sorted_partitions(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    sizes = sorting.terasort(df).rdd.glom().map(len).collect()
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 2000)


def test_set_operations(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    b = spark.createDataFrame([("y",), (None,)], "v string")
    assert rows(sets.subtract(a, b)) == [("x",), ("x",)]
    assert sorted(str(r.v) for r in sets.intersection(a, b).collect()) == ["None", "y"]


def test_split_is_even_disjoint_and_repeatable(spark):
    df = spark.range(17)
    one, two = (rows(sets.split(df, 4, ["id"], seed=9)) for _ in range(2))
    assert one == two and [r[0] for r in one] == list(range(17))
    assert sorted(Counter(p for _, p in one).values()) == [4, 4, 4, 5]


def counts(spark, **values):
    return spark.createDataFrame(list(values.items()), "word string, count long")


def test_diff_inner(spark):
    got = checks.diff_inner(counts(spark, a=1, b=2, x=9), counts(spark, a=1, b=3, y=9), ["word"])
    assert rows(got) == [("b", 2, 3)]
    repeated = counts(spark, a=1).union(counts(spark, a=2))
    assert rows(checks.diff_inner(counts(spark, a=1), repeated, ["word"])) == [("a", 1, 2)]


def test_diffs_tell_null_values_apart(spark):
    schema = "word string, count long"
    a = spark.createDataFrame([("a", None), ("b", 1), ("c", None), (None, 1)], schema)
    e = spark.createDataFrame([("a", 1), ("b", None), ("c", None), (None, 2)], schema)
    got = checks.diff_inner(a, e, ["word"]).collect()
    assert {r.word: r.expected for r in got} == {"a": 1, "b": None, None: 2}
    full = checks.diff_full(a, e, ["word"], ["count"]).collect()
    assert {r.word: r.status for r in full} == dict.fromkeys(["a", "b", None], "changed")
    a2, e2 = (df.withColumn("other", F.lit(1)) for df in (a, e))
    two = checks.diff_full(a2, e2, ["word"], ["count", "other"]).collect()
    assert {r.word for r in two} == {"a", "b", None}


def test_diff_full(spark):
    a, e = counts(spark, a=1, b=2, x=9), counts(spark, a=1, b=3, y=9)
    exact = [("b", "changed"), ("x", "extra"), ("y", "missing")]
    assert rows(checks.diff_full(a, e, ["word"], ["count"])) == exact
    assert rows(checks.diff_full(a, e, ["word"], ["count"], direction="actual")) == exact[:2]
    assert rows(checks.diff_full(a, e, ["word"], ["count"], direction="expected")) == [exact[0], exact[2]]
    both = checks.diff_full(a, e, ["word", "count"], mode="set")
    assert rows(both) == [("b", 2, "extra"), ("b", 3, "missing"), ("x", 9, "extra"), ("y", 9, "missing")]
    bag = checks.diff_full(a.union(a.limit(1)), a, ["word", "count"], mode="bag")
    assert rows(bag) == [("a", 1, 2, 1, "changed")]


def test_diff_lists_fails_on_repeats(spark):
    def items(*pairs):
        return spark.createDataFrame(list(pairs), "word string, doc string")

    a = items(("w", "1"), ("w", "2"), ("v", "1"), ("v", "1"))
    e = items(("w", "1"), ("w", "3"), ("v", "1"), ("v", "1"))
    assert rows(checks.diff_lists(a, e, ["word"], "doc")) == [
        ("v", "1", "repeated"), ("w", "2", "extra"), ("w", "3", "missing"),
    ]


def test_diff_adjacency(spark):
    good = graph.adjacency_list(P.parse_edges(lines(spark, "a,b", "a,c")))
    bad = graph.adjacency_list(P.parse_edges(lines(spark, "a,b", "q,c")))
    assert rows(checks.diff_adjacency(bad, good)) == [("a", "changed"), ("c", "changed"), ("q", "extra")]
    assert rows(checks.diff_adjacency(good, good)) == []


def test_marks(spark, docs):
    marked = faults.mark(text.posting_counts(docs), faults.postings_over(3))
    repeats = {r.word: len(r.docs) for r in text.inverted_index(docs, distinct=False).collect()}
    assert {r.word: r["__faulty"] for r in marked.collect()} == {w: n > 3 for w, n in repeats.items()}
    vectors = {r.doc: r["__faulty"] for r in faults.mark(text.term_counts(docs), faults.busy_terms()).collect()}
    for r in text.term_vector(docs).collect():
        assert vectors[r.doc] == (len(r.terms) > 2 and r.terms[0]["count"] > 2)


def test_seeded_faults(spark):
    df = lines(spark, "Index a", "Doc a")
    doubled = text.count_words(text.words(df), weight=faults.double_prefix("I"))
    assert rows(doubled) == [("Doc", 1), ("Index", 2), ("a", 2)]
    assert rows(faults.double_counts(text.word_count(df)).filter("word = 'a'")) == [("a", 4)]
    kept = faults.drop_edge_lines(lines(spark, "VertexID00006510642_31,x", "VertexID00006500642_31,x"))
    assert kept.count() == 1
    facts = graph.edge_facts(P.parse_edges(lines(spark, "VertexID00006510642_31,x")))
    assert rows(faults.rewrite_destination(facts), "vertex", "side", "neighbour") == [
        ("VertexID00006510642_31", "to", "VertexIDA"), ("x", "from", "VertexID00006510642_31")]
    ranked = text.ranked_inverted_index(
        spark.createDataFrame([("p", "f1", 5), ("p", "g12345", 3)], "phrase string, doc string, count long")
    )
    wrong = faults.double_file_counts(ranked).select(text.postings_text().alias("t"))
    assert rows(wrong) == [("5|f1,6|g12345",)]


def test_low_rating_faults(spark):
    df = spark.createDataFrame([(13, 1, 7, 1), (13, 2, 4368, 1), (12, 1, 4368, 1), (13, 3, 4368, 2)],
                               "movie_id long, pos int, rater_id long, rating int")
    assert rows(faults.drop_lowest_ratings(df), "movie_id", "pos") == [(12, 1), (13, 1), (13, 3)]
    assert faults.drop_movie(df, 13).count() == 1


def test_no_pattern_matches_outside_python_semantics(spark):
    # The count of every match agrees with Python's own scanner.
    values = ["aXa aYa aXa", "aXaXa"]
    want = Counter(m for v in values for m in re.findall("a[XY]a", v))
    assert dict(rows(text.grep_count(lines(spark, *values), "a[XY]a"))) == dict(want)


def test_short_reviews_are_not_lost(spark):
    reviews = spark.createDataFrame([(1, i, 7, None if i < 1200 else 5) for i in range(1600)],
                                    "movie_id long, pos int, rater_id long, rating int")
    assigned = spark.createDataFrame([(1, 0, 0.5)], "movie_id long, cluster_id int, similarity double")
    centre = ratings.recenter(assigned, reviews).first()
    line = "1:" + ",".join("7" if i < 1200 else "7_5" for i in range(1600))
    want = line[2:line.index(",", 1000)]
    assert centre.reviews == want and centre.n_reviews == want.count(",") + 1


def test_any_number_of_clusters(spark):
    model = P.parse_centroids(lines(spark, *[f"{i} 0.0 {i} 1 10_5" for i in range(40)]))
    assert model.count() == 40
    for bad, limit in ((["0 0.0 1 1 10_5", "0 0.0 2 1 10_5"], None), (["16 0.0 1 1 10_5"], 16)):
        with pytest.raises(Exception, match="slot is repeated or too large"):
            P.parse_centroids(lines(spark, *bad), limit).collect()


def test_cluster_ids_up_to_the_largest_int(spark):
    ids = [1 << 20, (1 << 31) - 2, (1 << 31) - 1, 0]
    model = spark.createDataFrame([(c, 0, 10 + i, 3) for i, c in enumerate(ids)] + [((1 << 31) - 1, 1, 20, 5), (7, 1, 20, 5)],
                                  "cluster_id int, pos int, rater_id long, rating int")
    seen = spark.createDataFrame([(i, 0, 10 + i, 5) for i in range(4)] + [(9, 0, 20, 4), (8, 0, 99, 1)],
                                 "movie_id long, pos int, rater_id long, rating int")
    got = {r.movie_id: (r.cluster_id, r.similarity) for r in ratings.classify(seen, model).collect()}
    assert got == {**{i: (c, 1.0) for i, c in enumerate(ids)}, 9: (7, 1.0), 8: (0, 0.0)}  # ties to the lowest id
    with pytest.raises(Exception, match="must not be negative"):
        ratings.classify(seen, model.withColumn("cluster_id", -F.col("cluster_id"))).collect()


def test_busy_vertex_keeps_every_neighbour(spark):
    edges = P.parse_edges(lines(spark, *[f"hub,n{i:02d}" for i in range(25)], "x,hub"))
    found = graph.adjacency_list(edges, max_group=10).filter("vertex = 'hub'").orderBy("segment").collect()
    assert [len(r["to"]) for r in found] == [10, 10, 5]
    assert [n for r in found for n in r["to"]] == [f"n{i:02d}" for i in range(25)]
    assert [n for r in found for n in r["from"]] == ["x"]


def test_index_words_are_split_on_single_spaces(spark):
    docs = spark.createDataFrame([("d", "a  b\tc"), ("e", "")], "doc string, content string")
    assert {r.word for r in text.inverted_index(docs).collect()} == {"a", "", "b\tc"}
    assert [r.word for r in text.by_word(text.inverted_index(docs)).collect()] == ["", "a", "b\tc"]


def test_centroid_model_in_rows(spark):
    from workload import inputs

    sf_dir = "/root/testdata/sf0.001"
    rows = inputs.centroid_rows(spark, sf_dir)
    assert rows.columns == ["cluster_id", "pos", "rater_id", "rating", "movie_id"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    want = ratings.centroid_reviews(inputs.centroids(spark, sf_dir)).collect()
    got = ratings.centroid_reviews(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 16


def test_chained_steps_and_a_busy_movie(spark):
    rng = random.Random(7)
    reviews = [(m, p, rng.randrange(40), rng.randrange(1, 6)) for m in range(30) for p in range(rng.randrange(1, 6))]
    reviews += [(100, p, 100 + p, 1 + p % 5) for p in range(600)]  # most of all rows are of one movie
    frame = spark.createDataFrame(reviews, "movie_id long, pos int, rater_id long, rating int")
    model = spark.createDataFrame([(0, 0, 3, 4), (0, 1, 110, 5), (1, 0, 5, 2), (2, 0, 7, 3)],
                                  "cluster_id int, pos int, rater_id long, rating int")
    for _ in range(2):
        members = ratings.classify(frame, model).collect()
        _, centres = ratings.kmeans_step(frame, model)
        centres = centres.collect()
        rank = {c.movie_id: i for i, c in enumerate(sorted(centres, key=lambda c: -c.movie_id))}
        rows = [(rank[c.movie_id], i, *map(int, r.split("_"))) for c in centres for i, r in enumerate(c.reviews.split(","))]
        last, before = centres, members
        model = spark.createDataFrame(rows, "cluster_id int, pos int, rater_id long, rating int")
    start = spark.createDataFrame([(0, 0, 3, 4), (0, 1, 110, 5), (1, 0, 5, 2), (2, 0, 7, 3)],
                                  "cluster_id int, pos int, rater_id long, rating int")
    assigned, centres = ratings.kmeans(frame, start, 2)
    assert sorted(centres.collect()) == sorted(last) and sorted(assigned.collect()) == sorted(before)
    long = next(c for c in ratings.centre_lines(ratings.centre_reviews(
        spark.createDataFrame([(100, 0, 0.5)], "movie_id long, cluster_id int, similarity double"), frame)).collect())
    line = "100:" + ",".join(f"{r}_{v}" for _, _, r, v in reviews[-600:])
    assert long.reviews == line[:line.index(",", 1000)].split(":")[1] and long.n_reviews == long.reviews.count(",") + 1


def test_lists_are_compared_whole(spark):
    schema = "vertex string, segment long, from array<string>, to array<string>"
    good = spark.createDataFrame([("a", 0, ["b", "c"], None), ("a", 1, ["d"], []), ("e", 0, [], ["x"]), ("f", 0, ["y"], ["y"])], schema)
    cut = spark.createDataFrame([("a", 0, ["d"], []), ("a", 1, ["c", "b"], None), ("e", 0, None, ["x", "x"]), ("g", 0, [], [])], schema)
    assert rows(checks.diff_adjacency(cut, good)) == [("g", "extra")]
    short = spark.createDataFrame([("a", 0, ["b", "c"], []), ("e", 0, ["x"], []), ("f", 0, ["y"], ["z"])], schema)
    assert rows(checks.diff_adjacency(short, good)) == [("a", "changed"), ("e", "changed"), ("f", "changed")]


def test_a_neighbour_missing_in_a_later_segment(spark):
    edges = P.parse_edges(lines(spark, *[f"hub,n{i}" for i in range(5)]))
    lost = graph.adjacency_list(edges.filter("dst <> 'n4'"), max_group=4)
    whole = graph.adjacency_list(edges, max_group=4)
    assert rows(checks.diff_adjacency(lost, whole)) == [("hub", "changed")]
    assert rows(checks.diff_adjacency(graph.adjacency_list(edges), whole)) == []


def test_list_items_in_one_aggregation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (3, "q"), (3, "q"), (None, None)], "k int, v string")
    e = spark.createDataFrame([(1, "x"), (1, "x"), (2, "w"), (3, "q"), (None, None)], "k int, v string")
    found = checks.diff_lists(a, e, ["k"], "v")
    assert rows(found) == [(1, "x", "repeated"), (1, "y", "extra"), (2, "w", "missing"), (2, "z", "extra"), (3, "q", "changed")]
    plan = checks.diff_lists(a, e, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_leaders_are_picked_before_the_shuffle(spark):
    counts = spark.createDataFrame([(p, f"d{d:02d}", (d * 7) % 5) for p in "ab" for d in range(20)], "phrase string, doc string, count long")
    whole = {r.phrase: r.postings for r in text.ranked_inverted_index(counts).collect()}
    found = text.ranked_inverted_index(counts, top=4)
    assert {r.phrase: r.postings for r in found.collect()} == {p: v[:4] for p, v in whole.items()}
    plan = text.ranked_inverted_index(counts, top=4)._jdf.queryExecution().executedPlan().toString()
    # Read from the bottom: leaders of each task, the exchange, leaders of all.
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_one_hot_key_is_sorted_in_several_ranges(spark):
    kv = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
                                    F.lit(1).alias("value")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        found = sorting.order_check(sorting.terasort(kv), "key").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (found["rows"], found["violations"]) == (40_000, 0) and found["largest"] < 20_000
    mixed = spark.createDataFrame([("b",), ("a",), ("c",)], "key string").coalesce(1)
    assert sorting.order_check(mixed, "key").first()["violations"] == 1
    assert sorting.order_check(mixed.limit(0), "key").first()["rows"] == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_index_and_term_vector_take_one_exchange(spark):
    docs = spark.createDataFrame([(f"d{i % 7}", "a b b c a") for i in range(50)], "doc string, content string")
    assert exchanges(text.inverted_index(docs)) == 1 and exchanges(text.term_vector(docs)) == 1
    index = {r.word: r.docs for r in text.inverted_index(docs).collect()}
    assert index == {w: [f"d{i}" for i in range(7)] for w in "abc"}


def test_hot_words_and_units_in_segments(spark):
    rng = random.Random(4)
    rows = [(f"d{i:03d}", " ".join(["the", *rng.choices("pqrs", k=3)])) for i in range(60)]
    rows += [("big", " ".join(f"w{i:02d} w{i:02d}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc string, content string")
    for max_group in (7, 25):
        got = text.inverted_index(docs, max_group=max_group).filter("word = 'the'").orderBy("segment").collect()
        assert [d for r in got for d in r.docs] == [f"d{i:03d}" for i in range(60)]
        assert [len(r.docs) for r in got][:-1] == [max_group] * (len(got) - 1)
        got = text.term_vector(docs, max_group=max_group).filter("doc = 'big'").orderBy("segment").collect()
        assert [(t["term"], t["count"]) for r in got for t in r.terms] == [(f"w{i:02d}", 2) for i in range(40)]
        assert len(got[0].terms) == max_group
    few = {tuple(r) for r in text.inverted_index(docs, max_group=25).filter("word <> 'the'").select("word", "segment").collect()}
    whole = text.inverted_index(docs).filter("word <> 'the'").count()
    assert len({w for w, _ in few}) == whole


def exchanged(df, column):
    """The exchanges of an executed plan that carry the column."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange " in line and f"({column}#" in line]


@pytest.mark.parametrize("most", [4_000_000, 30])
def test_phrases_are_counted_where_their_document_is(spark, most):
    rows = [("a", "x y z x y z"), ("a", "x y z"), ("b", "x y z w"), ("c", None), ("d", "x y"), (None, "x y z")]
    docs = spark.createDataFrame(rows + [("e", "p q r s t u v w x y z p q r")] * 3, "doc string, content string")
    found = text.sequence_count(docs, most=most)
    counts = {(r.phrase, r.doc): r["count"] for r in found.collect()}
    assert counts["x|y|z", "a"] == 3 and counts["x|y|z", "b"] == counts["x|y|z", None] == 1
    assert counts["p|q|r", "e"] == 6 and len(counts) == 3 + 2 + 1 + 11
    if most > 30:
        assert not exchanged(found, "phrase")


def test_ranked_postings_take_one_exchange(spark, monkeypatch):
    from backtrail.plans import groups

    written = []
    monkeypatch.setattr(groups, "stored", lambda df, label: written.append(label))
    counts = spark.range(60).selectExpr("concat('p', id % 7) AS phrase", "cast(id AS string) AS doc", "id % 5 AS count")
    found = text.ranked_inverted_index(counts)
    assert {r.phrase: len(r.postings) for r in found.collect()} == {f"p{i}": 9 if i < 4 else 8 for i in range(7)}
    assert not written and len(exchanged(found, "phrase")) == 1


@pytest.mark.parametrize("held", [200_000, 5])
def test_short_segments_are_cut_from_whole_lists(spark, monkeypatch, held):
    """Only vertices with more facts than a task may hold are ranked across the cluster."""
    ranked, plain = [], graph.number_rows
    monkeypatch.setattr(graph, "number_rows", lambda *a: ranked.append(1) or plain(*a))
    edges = P.parse_edges(lines(spark, *[f"hub,n{i % 7}" for i in range(9)], "n1,hub", "a,b", "a,c"))
    found = {(r.vertex, r.segment): (r["from"], r["to"]) for r in graph.adjacency_list(edges, max_group=3, held=held).collect()}
    assert found["hub", 0] == (["n1"], ["n0", "n1", "n2"]) and found["hub", 1] == ([], ["n3", "n4", "n5"])
    assert found["hub", 2] == ([], ["n6"]) and found["a", 0] == ([], ["b", "c"]) and found["n0", 0] == (["hub"], [])
    assert len(found) == 3 + 1 + 2 + 7 and bool(ranked) == (held == 5)


def test_only_rows_of_large_groups_are_written(spark, monkeypatch):
    from backtrail.plans import groups

    written, plain = [], groups.stored
    monkeypatch.setattr(groups, "stored", lambda df, label: written.append(plain(df, label)) or written[-1])
    df = spark.range(300).selectExpr("if(id < 100, 'hot', concat('k', id % 40)) AS k", "id", "id % 3 + 1 AS n")
    for weight, size in ((None, 10), ("n", 30)):
        found = groups.gather(df, ["k"], ["id"], "ids", max_group=size, weight=weight)
        whole = {}
        for r in sorted(found.collect(), key=lambda r: (r.k, r.segment)):
            whole.setdefault(r.k, []).extend(r.ids)
        assert len(whole) == 41 and whole["hot"] == list(range(100)) and sum(map(len, whole.values())) == 300
    assert [w.select("k").distinct().count() for w in written] == [1, 1]
