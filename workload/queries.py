"""One registered query per operator, over whole tables.

Nested results are rendered as text where they are compared with SQL.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.operators import checks, faults, graph, numeric, ratings, sets, sorting, text
from backtrail.plans import ddmin as D
from backtrail.plans import programs
from backtrail.plans.groups import gather
from backtrail.session import scratch_root
from backtrail.sources import parsers as P
from backtrail.sources.lines import read_lines, text_lines, trace_files, write_text
from workload import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_ID = ["doc_id", "line_no"]
PATTERN = "th[aeiou][a-z]*"
PREFIX = "D"
RARE = 3           # words seen exactly this often are traced
SMALL = 100        # clusters with fewer members are traced
BUSY = 35          # vertices with more out-neighbours are traced
DEAR = 499_690     # orders above this price are the planted faults


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# --- sources and parsers ------------------------------------------------------------

@query
def text_sink_source(spark, d):
    """Lines written as text files, read back and counted."""
    path = os.path.join(scratch_root(spark), f"lines-{uuid.uuid4().hex}")
    write_text(I.doc_lines(spark, d).select("value"), path)
    return text.word_count(read_lines(spark, path))


@query
def parse_documents(spark, d):
    lines = I.doc_lines(spark, d).select(
        F.concat_ws(":", F.lit("src"), F.col("doc_id").cast("string"), "value").alias("value")
    )
    return P.parse_documents(lines)


@query
def parse_edges(spark, d):
    return P.parse_edges(I.edge_lines(spark, d))


@query
def parse_ratings(spark, d):
    return P.parse_ratings(I.rating_lines(spark, d))


@query
def parse_phrase_counts(spark, d):
    found = text.sequence_count(I.records(spark, d))
    lines = found.select(F.concat(
        "phrase", F.lit("|"), "doc", F.lit("\t"), F.col("count").cast("string")
    ).alias("value"))
    return P.parse_phrase_counts(lines)


@query
def parse_key_value(spark, d):
    lines = I.table(spark, d, "orders").select(
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value")
    )
    return P.parse_key_value(lines)


@query
def parse_numbers(spark, d):
    lines = I.table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").alias("value"))
    return P.parse_numbers(lines).groupBy("n").agg(F.count(F.lit(1)).alias("lines"))


@query
def centroid_model(spark, d):
    """The model's reviews in bounded segments, and how many each centroid has."""
    rows = I.centroid_rows(spark, d).withColumn("review", ratings.review_text())
    totals = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    packed = gather(rows, ["cluster_id", "movie_id"], ["pos"], "reviews", lambda e: e["review"], carry=["review"])
    return packed.join(F.broadcast(totals), "cluster_id").select(
        "cluster_id", "movie_id", "total", "segment", joined("reviews"))


@query
def centroid_model_file(spark, d):
    """The model written as text and read back by its path."""
    path = os.path.join(scratch_root(spark), f"model-{uuid.uuid4().hex}")
    write_text(I.centroid_lines(spark, d), path)
    return P.read_centroids(spark, path).select("cluster_id", "movie_id", "similarity", "total", F.size("reviews").alias("read"))


# --- text ---------------------------------------------------------------------------

@query
def word_count(spark, d):
    return text.word_count(I.doc_lines(spark, d))


@query
def word_count_trimmed(spark, d):
    return text.word_count(I.turn_lines(spark, d), trimmed=True)


@query
def word_count_by_lang(spark, d):
    """Extra grouping columns."""
    docs = I.table(spark, d, "documents").select("doc_id", "lang", "text")
    return text.word_count(text_lines(I.spread(docs, "doc_id")), by=["lang"])


@query
def grep_count(spark, d):
    return text.grep_count(I.doc_lines(spark, d), PATTERN)


@query
def sequence_count(spark, d):
    return text.sequence_count(I.records(spark, d))


@query
def inverted_index(spark, d):
    return text.inverted_index(I.records(spark, d)).withColumn("docs", text.docs_text())


@query
def inverted_index_order(spark, d):
    """Each word's place in the index ordered by word."""
    index = text.inverted_index(I.records(spark, d)).select("word", "segment")
    return sorting.sort_positions(index, ["word", "segment"])


@query
def inverted_index_repeats(spark, d):
    found = text.inverted_index(I.records(spark, d), distinct=False)
    return found.withColumn("docs", text.docs_text())


@query
def ranked_inverted_index(spark, d):
    counts = text.sequence_count(I.records(spark, d))
    return text.ranked_inverted_index(counts).withColumn("postings", text.postings_text())


@query
def ranked_index_top(spark, d):
    """The three leading documents of each phrase."""
    counts = text.sequence_count(I.records(spark, d))
    return text.ranked_inverted_index(counts, top=3).withColumn("postings", text.postings_text())


@query
def term_vector_record(spark, d):
    found = text.term_vector(I.records(spark, d), per=["doc", "line_no"])
    return found.withColumn("terms", text.terms_text())


@query
def term_vector_doc(spark, d):
    return text.term_vector(I.records(spark, d)).withColumn("terms", text.terms_text())


# --- graph --------------------------------------------------------------------------

@query
def adjacency_list(spark, d):
    found = graph.adjacency_list(I.edges(spark, d))
    return found.select("vertex", F.array_join("from", ",").alias("from_list"),
                        F.array_join("to", ",").alias("to_list"))


@query
def adjacency_text(spark, d):
    """Adjacency of pages and their links, in the delimited form."""
    found = graph.adjacency_list(I.page_edges(spark, d))
    return found.select("vertex", graph.adjacency_text().alias("adjacency"))


@query
def degrees(spark, d):
    return graph.degrees(I.edges(spark, d))


# --- ratings ------------------------------------------------------------------------

@query
def ratings_histogram(spark, d):
    return ratings.ratings_histogram(I.reviews(spark, d))


def _assigned(spark, d):
    return ratings.classify(I.reviews(spark, d), I.centroid_rows(spark, d))


@query
def classify_centroid(spark, d):
    return _assigned(spark, d)


@query
def cluster_members(spark, d):
    return ratings.cluster_members(_assigned(spark, d)).withColumn("movie_ids", joined("movie_ids"))


@query
def kmeans_step(spark, d):
    """The new centroid rows."""
    _, centres = ratings.kmeans_step(I.reviews(spark, d), I.centroid_rows(spark, d))
    return centres


@query
def kmeans_twice(spark, d):
    """The centroid rows after a second step, on the centroids of the first."""
    _, centres = ratings.kmeans(I.reviews(spark, d), I.centroid_rows(spark, d), 2)
    return centres


@query
def truncate_reviews(spark, d):
    """Every text cut at the first comma at or after the offset."""
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", ratings.truncate_reviews(F.col("text")).alias("cut"))


# --- numbers and order --------------------------------------------------------------

@query
def range_filter(spark, d):
    return numeric.filter_range(
        I.table(spark, d, "events").select("event_id", "value"), "value", 0, 100
    )


@query
def bucketize(spark, d):
    return numeric.bucketize(I.table(spark, d, "events").select("event_id", "value"), "value")


@query
def category_stats(spark, d):
    priced = I.orders(spark, d)
    found = numeric.category_stats(priced, "o_totalprice", (100_000.0, 300_000.0))
    return found.withColumn("total", F.round("total", 2))


@query
def range_stats(spark, d):
    found = numeric.range_stats(I.table(spark, d, "events"), "value", 0, 100, by=["event_type"])
    return found.select(
        "event_type", "count", F.round("total", 2).alias("total"),
        F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
    )


@query
def terasort(spark, d):
    kv = I.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value")
    )
    return sorting.terasort(kv)


@query
def terasort_position(spark, d):
    """Each order's place in the global sort."""
    kv = I.table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return sorting.sort_positions(kv, ["o_orderpriority", "o_orderkey"])


@query
def terasort_unique_keys(spark, d):
    """Line items sorted by a key of their own: rows, and rows out of order."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                      F.col("l_extendedprice").cast("string"))
    kv = I.table(spark, d, "lineitem").select(key.alias("key"), F.col("l_suppkey").alias("value"))
    return sorting.order_check(sorting.terasort(kv), "key").select("rows", "violations")


@query
def terasort_hot_key(spark, d):
    """A third of all line items under one key, as copies of one row."""
    hot = F.col("l_orderkey") % 3 == 0
    key = F.when(hot, "hot").otherwise(F.col("l_orderkey").cast("string"))
    kv = I.table(spark, d, "lineitem").select(key.alias("key"), F.when(hot, 0).otherwise(F.col("l_suppkey")).alias("value"))
    return sorting.order_check(sorting.terasort(kv), "key").select("rows", "violations")


@query
def split_parts(spark, d):
    return sets.split(I.orders(spark, d).select("o_orderkey"), 7, ["o_orderkey"])


@query
def subtract_rows(spark, d):
    """Line words of documents that no conversation holds, with repetitions."""
    return sets.subtract(text.words(I.doc_lines(spark, d)), text.words(I.turn_lines(spark, d)))


@query
def intersect_rows(spark, d):
    return sets.intersection(text.words(I.doc_lines(spark, d)), text.words(I.turn_lines(spark, d)))


# --- marks --------------------------------------------------------------------------

@query
def mark_word_count(spark, d):
    return faults.mark(text.word_count(I.doc_lines(spark, d)), faults.count_at_least(3))


@query
def mark_inverted_index(spark, d):
    return faults.mark(text.posting_counts(I.records(spark, d)), faults.postings_over(3))


@query
def mark_ranked_index(spark, d):
    counts = text.document_counts(text.sequence_count(I.records(spark, d)))
    return faults.mark(counts, faults.documents_over(1))


@query
def mark_sequence_count(spark, d):
    return faults.mark(text.sequence_count(I.records(spark, d)), faults.count_over(3))


@query
def mark_term_vector(spark, d):
    return faults.mark(text.term_counts(I.records(spark, d)), faults.busy_terms())


@query
def mark_out_degree(spark, d):
    return faults.mark(graph.degrees(I.edges(spark, d)), faults.out_degree_over(BUSY))


@query
def mark_cluster_size(spark, d):
    return faults.mark(ratings.cluster_sizes(_assigned(spark, d)), faults.smaller_than(SMALL))


# --- seeded faults ------------------------------------------------------------------

def _prefixed(lines, by=()):
    return text.count_words(text.words(lines, by), by, faults.double_prefix(PREFIX))


@query
def fault_prefix(spark, d):
    return _prefixed(I.doc_lines(spark, d))


@query
def fault_double_match(spark, d):
    return faults.double_counts(text.grep_count(I.doc_lines(spark, d), PATTERN))


@query
def fault_low_ratings(spark, d):
    return ratings.ratings_histogram(faults.drop_low_ratings(I.reviews(spark, d)))


@query
def fault_lowest_ratings(spark, d):
    return ratings.ratings_histogram(faults.drop_lowest_ratings(I.reviews(spark, d)))


@query
def fault_edge_slice(spark, d):
    kept = P.parse_edges(faults.drop_edge_lines(I.edge_lines(spark, d), "00013"))
    return graph.degrees(kept)


@query
def fault_rewrite_edge(spark, d):
    facts = graph.edge_facts(I.edges(spark, d).select("src", "dst"))
    return graph.fact_degrees(faults.rewrite_destination(facts, "P13").dropDuplicates())


@query
def fault_shift_cluster(spark, d):
    return faults.shift_cluster(_assigned(spark, d)).select("movie_id", "cluster_id")


@query
def fault_drop_movie(spark, d):
    return ratings.ratings_histogram(faults.drop_movie(I.reviews(spark, d)))


@query
def fault_file_counts(spark, d):
    ranked = text.ranked_inverted_index(text.sequence_count(I.records(spark, d)))
    return faults.double_file_counts(ranked, "12").withColumn("postings", text.postings_text())


# --- checks -------------------------------------------------------------------------

@query
def diff_inner(spark, d):
    lines = I.doc_lines(spark, d)
    return checks.diff_inner(_prefixed(lines), text.word_count(lines), ["word"])


@query
def diff_full_exact(spark, d):
    """Word counts of documents against those of conversations."""
    return checks.diff_full(
        text.word_count(I.doc_lines(spark, d)), text.word_count(I.turn_lines(spark, d)),
        ["word"], ["count"],
    )


def _pairs(spark, d, flag):
    rows = I.table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag)
    return rows.select("l_partkey", "l_suppkey")


@query
def diff_full_set(spark, d):
    return checks.diff_full(_pairs(spark, d, "R"), _pairs(spark, d, "A"), ["l_partkey", "l_suppkey"],
                            mode="set")


@query
def diff_full_bag(spark, d):
    return checks.diff_full(_pairs(spark, d, "R"), _pairs(spark, d, "A"), ["l_partkey", "l_suppkey"],
                            mode="bag")


@query
def diff_histogram_one_way(spark, d):
    """Only what the actual side shows, skipping key 1."""
    reviews = I.reviews(spark, d)
    found = checks.diff_full(
        ratings.ratings_histogram(faults.drop_low_ratings(reviews)),
        ratings.ratings_histogram(reviews), ["rating"], ["count"], direction="actual",
    )
    return found.filter(F.col("rating") != 1)


@query
def diff_lists(spark, d):
    """Cluster members against those with one movie moved."""
    assigned = _assigned(spark, d)
    return checks.diff_lists(faults.shift_cluster(assigned), assigned, ["cluster_id"], "movie_id")


@query
def diff_adjacency(spark, d):
    lines = I.edge_lines(spark, d)
    bad = graph.adjacency_list(P.parse_edges(faults.drop_edge_lines(lines, "00013")))
    return checks.diff_adjacency(bad, graph.adjacency_list(P.parse_edges(lines)))


@query
def diff_adjacency_segments(spark, d):
    """The same lists in segments of four neighbours."""
    lines = I.edge_lines(spark, d)
    bad, good = (graph.adjacency_list(P.parse_edges(rows), max_group=4)
                 for rows in (faults.drop_edge_lines(lines, "00013"), lines))
    return checks.diff_adjacency(bad, good)


def _truth_fields(value):
    """`count<TAB>word`, the count in digits."""
    return {"word": F.when(value.contains("\t"), F.substring_index(value, "\t", -1)),
            "count": F.substring_index(value, "\t", 1).try_cast("bigint")}


@query
def diff_from_truth_text(spark, d):
    """Word counts against a text of expected ones, some wrong and some unreadable."""
    lines = I.doc_lines(spark, d)
    count = F.when(F.col("word").startswith("Z"), "?").otherwise(F.col("count").cast("string"))
    path = os.path.join(scratch_root(spark), f"truth-{uuid.uuid4().hex}")
    write_text(_prefixed(lines).select(F.concat(count, F.lit("\t"), "word").alias("value")), path)
    truth = P.read_truth(spark, path, _truth_fields)
    found = checks.diff_full(text.word_count(lines), truth.rows, ["word"], ["count"])
    lost = truth.unreadable.select(F.col("value").alias("word"), F.lit("unreadable").alias("status"))
    return found.unionByName(lost)


@query
def diff_from_expected_file(spark, d):
    """A histogram against an expected one in its fixed text layout."""
    reviews = I.reviews(spark, d)
    path = os.path.join(scratch_root(spark), f"expected-{uuid.uuid4().hex}")
    lines = F.concat_ws(" ", F.col("rating").cast("string"), F.col("count").cast("string")).alias("value")
    write_text(ratings.ratings_histogram(reviews).select(lines), path)
    expected = P.read_expected(spark, path, "int_counts")
    return checks.diff_inner(ratings.ratings_histogram(faults.drop_low_ratings(reviews)), expected, ["rating"])


# --- tracing ------------------------------------------------------------------------

def _words_program(spark, d):
    return programs.word_count(I.doc_lines(spark, d), LINE_ID)


@query
def trace_back_word(spark, d):
    """Source lines of the words seen exactly three times."""
    cursor = _words_program(spark, d).lineage().where(F.col("count") == RARE)
    return cursor.back_all().rows().select(*LINE_ID)


@query
def trace_back_marked(spark, d):
    """Source lines of all words marked by the count predicate."""
    cursor = _words_program(spark, d).lineage().where(faults.count_at_least(3))
    return cursor.back_all().rows().select(*LINE_ID)


@query
def trace_back_step(spark, d):
    """The word occurrences one step behind the counts."""
    cursor = _words_program(spark, d).lineage().where(F.col("count") == RARE)
    lid = F.col("__lid")
    return cursor.back(1).rows().select(
        lid["main"]["doc_id"].alias("doc_id"), lid["main"]["line_no"].alias("line_no"),
        lid["pos"].alias("pos"), "word",
    )


@query
def trace_back_per_output(spark, d):
    cursor = _words_program(spark, d).lineage().where(F.col("count") == RARE)
    found = cursor.back_all_per_output()
    return found.select(F.col("__out")["word"].alias("word"), *LINE_ID)


@query
def trace_captured(spark, d):
    """The same trace over links written beforehand."""
    cursor = _words_program(spark, d).captured().lineage().where(F.col("count") == RARE)
    return cursor.back_all().rows().select(*LINE_ID)


@query
def trace_forward(spark, d):
    """Words reached from the lines of documents labelled toxic."""
    program = _words_program(spark, d)
    toxic = I.table(spark, d, "labels").filter(F.col("toxic") == 1).select("doc_id").distinct()
    lines = I.doc_lines(spark, d).join(toxic, "doc_id", "left_semi")
    start = program.inputs().where(lines.select(F.struct(*LINE_ID).alias("__lid")))
    return start.forward_all().rows().select("word", "count")


@query
def trace_where_id(spark, d):
    """Source lines of one word, chosen by its identity."""
    return _words_program(spark, d).lineage().where_id("the").back_all().rows().select(*LINE_ID)


@query
def trace_count(spark, d):
    """How many source lines are behind the words seen exactly three times."""
    return _words_program(spark, d).lineage().where(F.col("count") == RARE).back_all().counted()


@query
def trace_back_grep(spark, d):
    """Source lines of the matches seen exactly three times."""
    program = programs.grep_count(I.doc_lines(spark, d), LINE_ID, PATTERN)
    return program.lineage().where(F.col("count") == RARE).back_all().rows().select(*LINE_ID)


@query
def trace_back_sequence(spark, d):
    """Records with a phrase that its document holds more than three times."""
    program = programs.sequence_count(I.records(spark, d), LINE_ID)
    return program.lineage().where(faults.count_over(3)).back_all().rows().select(*LINE_ID)


@query
def trace_back_index(spark, d):
    """Records with a word of exactly two documents."""
    program = programs.inverted_index(I.records(spark, d), LINE_ID)
    return program.lineage().where(F.col("n_docs") == 2).back_all().rows().select(*LINE_ID)


@query
def trace_back_ranked_index(spark, d):
    """Phrase counts of the phrases found in more than two documents."""
    counts = text.sequence_count(I.records(spark, d))
    program = programs.ranked_inverted_index(counts, ["phrase", "doc"])
    return program.lineage().where(F.col("n_docs") > 2).back_all().rows().select("phrase", "doc", "count")


@query
def trace_back_terms(spark, d):
    """Records behind the term vectors that are marked."""
    program = programs.term_vector(I.records(spark, d), LINE_ID)
    return program.lineage().where(faults.busy_terms()).back_all().rows().select(*LINE_ID)


@query
def trace_back_histogram(spark, d):
    """Reviews behind the lowest rating."""
    program = programs.histogram(trace_files(spark, f"{d}/lineitem.parquet").select(
        "__lid", "l_orderkey", "l_linenumber", (F.lit(1) + F.col("l_linenumber") % 5).cast("int").alias("rating")), None)
    return program.lineage().where(F.col("rating") == 1).back_all().rows().select("l_orderkey", "l_linenumber")


@query
def trace_back_centre(spark, d):
    """All members that the first cluster's new centroid depends on."""
    assigned = _assigned(spark, d)
    program = programs.recentring(assigned, I.reviews(spark, d))
    return program.lineage().where(F.col("cluster_id") == 0).back_all().rows().select("movie_id", "similarity")


@query
def trace_back_category(spark, d):
    """Events in range behind the small category."""
    events = I.table(spark, d, "events").select("event_id", "value")
    program = programs.categories(events, ["event_id"], "value", 50, 400)
    return program.lineage().where(F.col("category") == "Small").back_all().rows().select("event_id", "value")


def _edges_program(spark, d):
    """Line items have no key: their place in the Parquet files identifies them."""
    rows = trace_files(spark, f"{d}/lineitem.parquet")
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return programs.adjacency(
        I.spread(
            rows.select("__lid", "l_orderkey", part.alias("src"), supplier.alias("dst")), "l_orderkey"
        ),
        None,
    )


@query
def trace_back_adjacency(spark, d):
    cursor = _edges_program(spark, d).lineage().where(faults.out_degree_over(BUSY))
    return cursor.back_all().rows().select("l_orderkey", "src", "dst")


@query
def trace_rerun_tail(spark, d):
    """Back to the source, one step forward, and the grouping run again on those rows."""
    program = _edges_program(spark, d)
    cursor = program.lineage().where(faults.out_degree_over(BUSY)).back_all().forward(1)
    return program.rerun_from("facts", cursor.rows()).drop("__lid")


def _cluster_program(spark, d):
    rows = trace_files(spark, f"{d}/lineitem.parquet").select(
        "__lid", "l_orderkey", F.col("l_partkey").alias("movie_id"),
        F.col("l_suppkey").alias("rater_id"),
        (F.lit(1) + F.col("l_linenumber") % 5).cast("int").alias("rating"),
    )
    return programs.classification(I.spread(rows, "l_orderkey"), None, I.centroid_rows(spark, d))


@query
def trace_back_cluster(spark, d):
    """Reviews behind the clusters with fewer than a hundred members."""
    cursor = _cluster_program(spark, d).lineage().where(faults.smaller_than(SMALL))
    return cursor.back_all().rows().select("l_orderkey", "movie_id", "rater_id", "rating")


@query
def trace_back_centroids(spark, d):
    """The model's reviews that the reviews of those clusters met."""
    cursor = _cluster_program(spark, d).lineage().where(faults.smaller_than(SMALL))
    found = cursor.back(3, side="centroids").rows()
    return found.select("cluster_id", "rater_id", "c_rating")


@query
def trace_forward_model(spark, d):
    """Movies that met one of the first centroid's highest ratings."""
    program = _cluster_program(spark, d)
    model = program.stages[program.index("matches")].sides["centroids"]
    chosen = model.lineage().where((F.col("cluster_id") == 0) & (F.col("c_rating") == 5))
    movies = chosen.forward_into(program, "matches", "centroids").forward(1)
    return movies.rows().select("movie_id")


# --- delta debugging ----------------------------------------------------------------

def _dear_test():
    """Fails when some record lies above the planted bound."""
    return D.predicate_test(
        lambda rows, by: rows.groupBy(*by).agg(F.max("o_totalprice").alias("top")),
        F.col("top") > DEAR,
    )


def _found(result, *cols):
    return result.rows.select(*cols)


@query
def ddmin_single(spark, d):
    return _found(D.ddmin(I.orders(spark, d), _dear_test(), ["o_orderkey"]), "o_orderkey")


@query
def ddmin_exhaustive(spark, d):
    result = D.ddmin(I.orders(spark, d), _dear_test(), ["o_orderkey"], exhaustive=True)
    return _found(result, "solution_id", "o_orderkey")


def _ends(spark, d):
    """Orders that know the range of all prices, and a test that fails on the whole range."""
    rows = I.orders(spark, d)
    span = rows.agg(F.max("o_totalprice") - F.min("o_totalprice")).scalar()
    test = D.predicate_test(
        lambda part, by: part.groupBy(*by).agg(
            (F.max("o_totalprice") - F.min("o_totalprice") >= F.max("span")).alias("whole")
        ),
        F.col("whole"),
    )
    return rows.withColumn("span", span), test


@query
def ddmin_pair(spark, d):
    """Fails only when the dearest and the cheapest order are in the set together."""
    rows, test = _ends(spark, d)
    return _found(D.ddmin(rows, test, ["o_orderkey"]), "o_orderkey")


@query
def ddmin_own_split(spark, d):
    """The same, with parts by a hash of the key that each number of parts deals anew."""
    rows, test = _ends(spark, d)
    result = D.ddmin(rows, test, ["o_orderkey"], split=lambda n: F.pmod(F.xxhash64("o_orderkey", F.lit(n)), F.lit(n)))
    return _found(result, "o_orderkey")


@query
def ddmin_history(spark, d):
    result = D.ddmin(I.orders(spark, d), _dear_test(), ["o_orderkey"])
    return result.history.drop("ms")


def _word_test():
    return D.truth_test(_prefixed, lambda rows, by: text.word_count(rows, by), ["word"])


@query
def localize_word_trace(spark, d):
    """The lines that a seeded overcount is traced to, before they are reduced."""
    lines = I.doc_lines(spark, d)
    wrong = checks.diff_inner(_prefixed(lines), text.word_count(lines), ["word"])
    program = programs.word_count(lines, LINE_ID, faults.double_prefix(PREFIX))
    return program.lineage().where(wrong.select(F.struct("word").alias("__lid"))).back_all().rows().select(*LINE_ID)


@query
def localize_word_count(spark, d):
    """A seeded overcount: detect it, trace it, and reduce the traced lines."""
    lines = I.doc_lines(spark, d)
    program = programs.word_count(lines, LINE_ID, faults.double_prefix(PREFIX))
    wrong = checks.diff_inner(_prefixed(lines), text.word_count(lines), ["word"])
    bad = wrong.select(F.struct("word").alias("__lid"))
    result = programs.localize(program, bad, _word_test(), LINE_ID)
    return _found(result.minimised, *LINE_ID)


@query
def localize_rewritten_edge(spark, d):
    """Rewritten edges show in the neighbours; the traced edges come down to one of them."""
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    edges = I.edges(spark, d, *cols)

    def rewritten(rows, by):
        return faults.rewrite_destination(graph.edge_facts(rows, by), "P13")

    fact = ["vertex", "side", "neighbour"]
    wrong = checks.diff_full(rewritten(edges, []), graph.edge_facts(edges), fact, mode="set")
    test = D.truth_test(lambda rows, by: rewritten(rows, by).dropDuplicates(),
                        lambda rows, by: graph.edge_facts(rows, by).dropDuplicates(), fact, [])
    bad = wrong.select(F.struct("vertex").alias("__lid")).distinct()
    result = programs.localize(programs.adjacency(edges, cols), bad, test, cols)
    return _found(result.minimised, "l_orderkey", "l_linenumber", "l_suppkey")


@query
def localize_shifted_cluster(spark, d):
    """A movie put into the wrong cluster comes down to one of its reviews."""
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    reviews, model = I.reviews(spark, d, *cols), I.centroid_rows(spark, d)

    def clean(rows, by):
        return ratings.classify(rows, model, by)

    def shifted(rows, by):
        return faults.shift_cluster(clean(rows, by))

    wrong = checks.diff_inner(shifted(reviews, []), clean(reviews, []), ["movie_id"], "cluster_id")
    program = programs.classification(reviews, [*cols, "movie_id"], model)
    chosen = wrong.select(F.struct("movie_id").alias("__lid"))
    traced = program.lineage().back(1).where(chosen).back(2).rows()
    test = D.truth_test(shifted, clean, ["movie_id"], ["cluster_id"])
    result = D.ddmin(traced.drop("__lid"), test, [*cols, "movie_id"])
    return _found(result, "l_orderkey", "l_linenumber", "l_suppkey", "movie_id")


@query
def localize_omission(spark, d):
    """A seeded loss: the lost reviews are found through the fault-free program."""
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    reviews = I.reviews(spark, d, *cols)
    lost = programs.Traced.source(reviews, cols, "reviews").map("kept", faults.drop_low_ratings).group(
        "counts", ["rating"], ratings.ratings_histogram
    )
    clean = programs.histogram(reviews, cols)
    wrong = checks.diff_inner(lost.result(), clean.result(), ["rating"])
    test = D.truth_test(
        lambda rows, by: ratings.ratings_histogram(faults.drop_low_ratings(rows), by),
        ratings.ratings_histogram, ["rating"],
    )
    bad = wrong.select(F.struct("rating").alias("__lid"))
    result = programs.localize(lost, bad, test, cols, "missing", clean)
    return _found(result.minimised, "l_orderkey", "l_linenumber", "l_suppkey")
