import pytest
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.sources import lines as L
from backtrail.sources import parsers as P


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def apply(spark, fn, *values):
    return [r[0] for r in lines(spark, *values).select(fn(F.col("value"))).collect()]


def test_split_words_keeps_inner_empties_only(spark):
    assert apply(spark, S.split_words, "a b  c ", "", "  ", " lead\tx") == [
        ["a", "b", "", "c"], [""], [], ["", "lead\tx"],
    ]


def test_tokenize(spark):
    assert apply(spark, S.tokenize, " a\tb  c ", "of f", "") == [["a", "b", "c"], ["of", "f"], []]


def test_last_and_first_marks(spark):
    assert apply(spark, lambda c: S.before_last(c, ":"), "a:b:c", "none", "x:") == ["a:b", "", "x"]
    assert apply(spark, lambda c: S.after_last(c, ":"), "a:b:c", "none", "x:") == ["c", "none", ""]
    assert apply(spark, lambda c: S.after_first(c, ":"), "a:b:c", "none") == ["b:c", ""]


def test_ngrams_of_short_input(spark):
    gram = lambda c: S.ngrams(S.tokenize(c), 3)
    assert apply(spark, gram, "a b", "a b c d", "") == [[], ["a|b|c", "b|c|d"], []]


def test_cut_after(spark):
    cut = lambda c: S.cut_after(c, 4)
    assert apply(spark, cut, "ab,cd,ef", "abcd,e", "abc,e", "abcdef") == [
        "ab,cd", "abcd", "abc,e", "abcdef",
    ]


def test_documents_split_at_last_colon(spark):
    rows = P.parse_documents(lines(spark, "1:2:Wiki: some words \t")).collect()
    assert [tuple(r) for r in rows] == [("1:2:Wiki", "some words")]


def test_edges(spark):
    df = lines(spark, "a,b", "bad", "x,y,z")
    assert [tuple(r) for r in P.parse_edges(df).collect()] == [("a", "b"), ("x,y", "z")]
    assert [tuple(r) for r in P.parse_edges(df, "null").collect()][1] == (None, None)
    with pytest.raises(Exception, match="malformed line"):
        P.parse_edges(df, "fail").collect()


def test_ratings(spark):
    df = lines(spark, "1:10_5,11_3", ":bad", "nocolon", "2:x_1,12_4")
    assert [tuple(r) for r in P.parse_ratings(df).collect()] == [
        (1, 0, 10, 5), (1, 1, 11, 3), (2, 1, 12, 4),
    ]


def test_phrase_counts_and_key_values(spark):
    df = lines(spark, "a|b|c|doc:1\t7", "broken")
    assert [tuple(r) for r in P.parse_phrase_counts(df).collect()] == [("a|b|c", "doc:1", 7)]
    assert [tuple(r) for r in P.parse_key_value(lines(spark, " k  v rest", "k")).collect()] == [("k", "v")]


def test_numbers(spark):
    assert [r.n for r in P.parse_numbers(lines(spark, " 1.5 ", "2")).collect()] == [1.5, 2.0]
    assert P.parse_numbers(lines(spark, "x", "2"), "drop").count() == 1
    with pytest.raises(Exception, match="malformed line"):
        P.parse_numbers(lines(spark, "x")).collect()


def test_centroids_reordered_by_falling_movie(spark):
    df = lines(spark, "0 0.0 100 2 10_5,11_3", "1 0.0 200 2 12_4,26_1", "2 0 -1 0 1_1", "16 0 7 1 1_1")
    rows = P.parse_centroids(df).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.movie_id, [tuple(v) for v in r.reviews]) for r in rows] == [
        (0, 200, [(12, 4), (26, 1)]), (1, 100, [(10, 5), (11, 3)]), (2, 7, [(1, 1)]),
    ]


@pytest.mark.parametrize(
    "shape, line, row",
    [
        ("counts", "word 3", ("word", 3)),
        ("int_counts", "5\t12", (5, 12)),
        ("postings", "word doc:1", ("word", "doc:1")),
        ("ranked", "a|b|c 4|doc", ("a|b|c", "4|doc")),
        ("terms", "doc we:ird:2", ("doc", "we:ird", 2)),
        ("members", "3 77", (3, 77)),
        ("rest", "3 0.5 1 2 a_b", (3, "0.5 1 2 a_b")),
        ("adjacency", "v from{a,b}:to{}", ("v", ["a", "b"], [])),
        ("tuple_counts", "(word 3)", ("word", 3)),
    ],
)
def test_expected_shapes(spark, shape, line, row):
    assert tuple(P.parse_expected(lines(spark, line), shape).first()) == row


def test_files_round_trip_with_identities(spark, tmp_path):
    path = str(tmp_path / "out")
    L.write_text(lines(spark, "b", "a").coalesce(1), path)
    assert sorted(r.value for r in L.read_lines(spark, path).collect()) == ["a", "b"]
    assert L.read_lines(spark, path, 3).rdd.getNumPartitions() == 3
    traced = L.trace_files(spark, path, "text")
    first, again = (sorted(map(str, traced.collect())) for _ in range(2))
    assert first == again and traced.select(L.LID).distinct().count() == 2


def test_the_callers_own_truth_layout(spark, tmp_path):
    path = str(tmp_path / "truth")
    L.write_text(lines(spark, "k1;3;x", "k2;;y", "no", "", "k3;4"), path)

    def fields(value):
        part = lambda i: F.get(F.split(value, ";"), F.lit(i))
        return {"key": part(0), "n": part(1).try_cast("int"), "note": part(2)}

    truth = P.read_truth(spark, path, fields, optional=["note"])
    assert sorted(map(tuple, truth.rows.collect())) == [("k1", 3, "x"), ("k3", 4, None)]
    assert sorted(r.value for r in truth.unreadable.collect()) == ["", "k2;;y", "no"]
    strict = P.read_truth(spark, path, fields)
    assert strict.rows.count() == 1 and strict.unreadable.count() == 4


def test_model_and_expected_files(spark, tmp_path):
    path = str(tmp_path / "model")
    L.write_text(lines(spark, "0 0.5 100 2 10_5,11_3", "1 0.0 200 1 12_4"), path)
    assert [(r.cluster_id, r.movie_id, r.similarity) for r in P.read_centroids(spark, path).collect()] == [(0, 200, 0.0), (1, 100, 0.5)]
    path = str(tmp_path / "expected")
    L.write_text(lines(spark, "3 77", "4 78"), path)
    assert sorted(map(tuple, P.read_expected(spark, path, "members").collect())) == [(3, 77), (4, 78)]
