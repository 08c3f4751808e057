"""Delta debugging: minimal failing sets, and that the search ends."""

import itertools

import pytest
from pyspark.sql import functions as F

import backtrail.plans.ddmin as D
from backtrail.operators import faults, ratings, text
from backtrail.plans import programs
from backtrail.plans.ddmin import (
    TRIAL, BatchTest, Set, Sets, SplitSets, ddmin, part_of, predicate_test, ranked_candidates, size_of, truth_test, without,
)
from backtrail.plans.lineage import Traced
from backtrail.sources import parsers as P


def numbers(spark, n=8):
    return spark.range(1, n + 1).select("id", F.col("id").alias("v"))


def all_of(*wanted):
    def fn(rows):
        hits = rows.filter(F.col("v").isin(*wanted)).groupBy(TRIAL)
        return hits.agg((F.count_distinct("id") == len(wanted)).alias("failed"))

    return BatchTest(fn)


def any_of(*wanted):
    return BatchTest(lambda rows: rows.groupBy(TRIAL).agg(F.bool_or(F.col("v").isin(*wanted)).alias("failed")))


def found(result):
    sets = {}
    for r in result.rows.collect():
        sets.setdefault(r.solution_id, set()).add(r.id)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("lookahead", [0, 3])
@pytest.mark.parametrize("wanted", [[6], [3, 6], [2, 5, 7], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_one_minimal_set(spark, wanted, lookahead):
    result = ddmin(numbers(spark), all_of(*wanted), ["id"], lookahead=lookahead)
    assert found(result) == [wanted] and result.complete


def test_callable_test_gives_the_same_result(spark):
    def fails(rows):
        return rows.filter(F.col("v").isin(3, 6)).count() == 2

    single, batched = (ddmin(numbers(spark), t, ["id"]) for t in (fails, all_of(3, 6)))
    assert found(single) == found(batched) == [[3, 6]]
    assert batched.jobs < single.jobs


def test_every_independent_fault(spark):
    assert found(ddmin(numbers(spark), any_of(2, 7), ["id"], exhaustive=True)) == [[2], [7]]
    assert found(ddmin(numbers(spark), any_of(2, 7), ["id"])) == [[2]]


def test_exhaustive_interaction(spark):
    result = ddmin(numbers(spark), all_of(3, 6), ["id"], exhaustive=True)
    assert [3, 6] in found(result) and result.complete


def test_nothing_fails(spark):
    result = ddmin(numbers(spark), any_of(99), ["id"])
    assert found(result) == [] and result.rows.columns == ["id", "v", "solution_id"]
    assert ddmin(numbers(spark).limit(0), any_of(1), ["id"]).rows.count() == 0


def test_equal_valued_rows_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 9)], "id long, v long")
    fails = BatchTest(lambda rows: rows.groupBy(TRIAL).agg((F.sum((F.col("v") == 5).cast("int")) == 2).alias("failed")))
    assert found(ddmin(df, fails, ["id"])) == [[1, 3]]


def test_no_output_may_be_the_failure(spark):
    fails = BatchTest(lambda rows: rows.filter("v > 99").groupBy(TRIAL).agg(F.lit(False).alias("failed")), True)
    assert len(found(ddmin(numbers(spark), fails, ["id"]))) == 1


def test_history_and_round_limit(spark):
    result = ddmin(numbers(spark), all_of(2, 5, 7), ["id"], max_rounds=1)
    assert not result.complete and result.rounds == 1
    full = ddmin(numbers(spark), all_of(2, 5, 7), ["id"])
    log = full.history.collect()
    assert {r.kind for r in log} >= {"whole", "part"} and log[0].size == 8 and log[0].failed


    assert result.rows.count() == 0 and result.unfinished.count() == 8 and full.unfinished.count() == 0


def test_many_needed_rows_in_few_pieces(spark, monkeypatch):
    """Sets that fall apart are numbered anew; the driver holds a few ranges only."""
    monkeypatch.setattr(D, "MAX_RANGES", 3)
    wanted = [3, 11, 12, 20, 29, 41, 55, 60, 77, 78, 79, 100]
    seen = []
    plain = Sets.assign
    monkeypatch.setattr(Sets, "assign", lambda self, trials: seen.extend(trials.values()) or plain(self, trials))
    result = ddmin(numbers(spark, 120), all_of(*wanted), ["id"])
    assert found(result) == [wanted] and result.complete
    assert max(len(s.ranges) for s in seen) <= 4 and max(s.table for s in seen) > 2


@pytest.mark.parametrize("split", [None, lambda n: F.col("id") % n])
def test_what_outgrows_the_driver(spark, monkeypatch, split):
    monkeypatch.setattr(D, "MEMORY", 3)
    monkeypatch.setattr(D, "BRANCH_WAVE", 2)
    wanted = [2, 7, 9, 14, 15, 23]
    result = ddmin(numbers(spark, 24), any_of(*wanted), ["id"], exhaustive=True, split=split)
    assert found(result) == [[i] for i in wanted]
    rows = {r.id: r.solution_id for r in result.rows.collect()}
    assert [rows[i] for i in wanted] == list(range(6))
    assert result.history.count() > 12 and result.history.filter("kind = 'whole'").count() == 1


def test_a_split_leaves_no_conditions_behind(spark):
    sets = SplitSets(ranked_candidates(numbers(spark, 64), ["id"]), lambda n: F.col("id") % n)
    one, sizes = sets.whole, []
    for n in (2, 4, 8, 16, 32):
        parts = sets.parts(one, n)
        one = parts.wave(0, n, 1)[0][1]
        sizes.append(len(sets.assign({0: one, 1: parts.whole.without(one)})._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 1.2 * min(sizes) and one.size == 2


def test_jobs_follow_the_needed_rows(spark):
    few = ddmin(numbers(spark, 2000), all_of(77), ["id"])
    more = ddmin(numbers(spark, 2000), all_of(77, 1500), ["id"])
    assert few.jobs <= 6 and few.jobs < more.jobs <= 45


def test_compact_keeps_members(spark):
    sets = Sets(ranked_candidates(numbers(spark, 50), ["id"]))
    one = Set(0, tuple((i, i + 1) for i in range(0, 50, 2)), 25)
    D_MAX = D.MAX_RANGES
    D.MAX_RANGES = 5
    try:
        small = sets.compact(one)
    finally:
        D.MAX_RANGES = D_MAX
    assert small.ranges == ((0, 25),) and sorted(r.id for r in sets.rows(small).collect()) == list(range(1, 51, 2))
    assert sorted(r.id for r in sets.rows(sets.parts(small, 5).wave(1, 2, 1)[0][1]).collect()) == list(range(11, 21, 2))


def test_seeded_order_repeats(spark):
    one, two = (ddmin(numbers(spark), any_of(2, 7), ["id"], seed=4) for _ in range(2))
    assert found(one) == found(two) and len(found(one)[0]) == 1


def test_result_fails_and_is_one_minimal(spark):
    # A test that is not monotone: an odd number of multiples of three.
    fails = BatchTest(lambda rows: rows.groupBy(TRIAL).agg((F.sum((F.col("v") % 3 == 0).cast("int")) % 2 == 1).alias("failed")))
    (solution,) = found(ddmin(numbers(spark, 27), fails, ["id"]))

    def bad(values):
        return sum(v % 3 == 0 for v in values) % 2 == 1

    assert bad(solution)
    assert not any(bad([v for v in solution if v != out]) for out in solution)


@pytest.mark.parametrize("wanted", [[6], [3, 6]])
def test_the_callers_own_split(spark, wanted):
    result = ddmin(numbers(spark), all_of(*wanted), ["id"], split=lambda n: F.col("id") % n)
    assert found(result) == [wanted] and result.complete
    every = ddmin(numbers(spark), any_of(2, 7), ["id"], exhaustive=True, split=lambda n: F.col("id") % n)
    assert found(every) == [[2], [7]]


def test_a_split_that_cannot_separate_rows_still_ends(spark):
    result = ddmin(numbers(spark), all_of(6), ["id"], split=lambda n: F.lit(0))
    assert result.complete and 6 in found(result)[0]


def test_range_arithmetic():
    whole = ((0, 10), (20, 30))
    for n in range(1, 21):
        parts = [part_of(whole, n, i) for i in range(n)]
        assert sum(map(size_of, parts)) == 20 and max(map(size_of, parts)) - min(map(size_of, parts)) <= 1
        for a, b in itertools.combinations(parts, 2):
            assert not members(a) & members(b)
        for part in parts:
            rest = without(whole, part)
            assert members(rest) | members(part) == members(whole) and not members(rest) & members(part)


def members(ranges):
    return {i for lo, hi in ranges for i in range(lo, hi)}


def test_localise_an_overcount(spark):
    rows = [(i, "oak Doc elm" if i in (9, 14) else "oak elm") for i in range(20)]
    lines = spark.createDataFrame(rows, "id long, value string")
    t = programs.word_count(lines, ["id"], faults.double_prefix("D"))

    def faulty(df, by):
        return text.count_words(text.words(df, by), by, faults.double_prefix("D"))

    test = truth_test(faulty, lambda df, by: text.word_count(df, by), ["word"])
    result = programs.localize(t, F.col("word") == "Doc", test, ["id"])
    assert sorted(r.id for r in result.traced.collect()) == [9, 14]
    assert found(result.minimised) == [[9]]
    every = programs.localize(t, F.col("word") == "Doc", test, ["id"], exhaustive=True)
    assert found(every.minimised) == [[9], [14]]


def test_localise_an_omission(spark):
    """Lost reviews are out of reach of a trace of the faulty run."""
    reviews = P.parse_ratings(spark.createDataFrame(
        [("1:10_5,11_3,13_1",), ("2:10_1,12_4",), ("3:11_2,26_1",)], "value string"))
    reviews = reviews.withColumn("id", F.col("movie_id") * 10 + F.col("pos"))
    faulty = (
        Traced.source(reviews, ["id"])
        .map("kept", faults.drop_low_ratings)
        .group("counts", ["rating"], ratings.ratings_histogram)
    )
    clean = programs.histogram(reviews, ["id"])
    test = truth_test(
        lambda df, by: ratings.ratings_histogram(faults.drop_low_ratings(df), by),
        ratings.ratings_histogram, ["rating"],
    )
    wrong = F.col("rating") == 1
    assert found(programs.localize(faulty, wrong, test, ["id"]).minimised) == []
    for clean_run in (clean, None):
        got = programs.localize(faulty, wrong, test, ["id"], "missing", clean_run, exhaustive=True)
        assert found(got.minimised) == [[12], [31]]


def test_predicate_test_over_a_program(spark):
    lines = spark.createDataFrame([(i, f"w{i % 5} x") for i in range(12)], "id long, value string")
    test = predicate_test(lambda df, by: text.word_count(df, by), (F.col("count") >= 3) & (F.col("word") == "w1"))
    assert found(ddmin(lines, test, ["id"])) == [[1, 6, 11]]


def test_jobs_of_an_exhaustive_search_grow_with_its_depth(spark):
    """Many faults share the jobs of a round; their sets are told apart by a broadcast table."""
    wanted = [i for i in range(1, 4001) if i % 13 == 5]
    fails = BatchTest(lambda rows: rows.groupBy(TRIAL).agg(F.bool_or(F.col("v") % 13 == 5).alias("failed")))
    result = ddmin(numbers(spark, 4000), fails, ["id"], exhaustive=True)
    assert result.jobs <= 16 and found(result) == [[i] for i in wanted]
    assert {r.id: r.solution_id for r in result.rows.collect()} == {i: k for k, i in enumerate(wanted)}


def test_solutions_beyond_the_driver_are_written_together(spark, monkeypatch):
    monkeypatch.setattr(D, "MEMORY", 16)
    monkeypatch.setattr(D, "TREE", 4)
    fails = BatchTest(lambda rows: rows.groupBy(TRIAL).agg(F.bool_or(F.col("v") % 5 == 0).alias("failed")))
    made, plain = [], D.scratch_path
    monkeypatch.setattr(D, "scratch_path", lambda s, label: made.append(label) or plain(s, label))
    result = ddmin(numbers(spark, 300), fails, ["id"], exhaustive=True)
    assert found(result) == [[i] for i in range(5, 301, 5)]
    assert 0 < made.count("solutions") <= 4 and made.count("solution") == 0


@pytest.mark.parametrize("wanted", [[77], [1203], [77, 1500]])
def test_large_sets_are_tested_for_the_next_step_only(spark, monkeypatch, wanted):
    """sets of later rounds, tested along, made every row of a large set count four times."""
    asked = []
    plain = Sets.assign
    monkeypatch.setattr(Sets, "assign", lambda self, trials: asked.append([s.size for s in trials.values()]) or plain(self, trials))
    whole = ddmin(numbers(spark, 2000), all_of(*wanted), ["id"])
    before = list(map(sum, asked))
    asked.clear()
    monkeypatch.setattr(D, "JOB_ROWS", 100)
    result = ddmin(numbers(spark, 2000), all_of(*wanted), ["id"])
    assert found(result) == found(whole) == [wanted] and result.complete
    assert result.history.drop("ms").collect() == whole.history.drop("ms").collect()
    assert max(map(sum, asked)) <= 3 * 2000 < max(before)
    if len(wanted) == 1:
        assert sum(map(sum, asked)) <= 3.5 * 2000 < sum(before) and result.jobs <= 14
