"""The same results in SQL, for engines that run on the given tables."""

from __future__ import annotations

import re

# Shared sub-queries, by name.
PARTS = {
    "lines": """SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS value
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)""",
    "words": """SELECT doc_id, line_no, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (
        SELECT doc_id, line_no, CASE WHEN value <> '' AND trim(value, ' ') = '' THEN []
            ELSE string_split(rtrim(value, ' '), ' ') END AS w FROM lines)""",
    "wc": "SELECT word, count(*) AS count FROM words GROUP BY word",
    "turn_lines": """SELECT unnest(string_split(text, chr(10))) AS value FROM conversations""",
    "turn_words": """SELECT unnest(CASE WHEN value <> '' AND trim(value, ' ') = '' THEN []
            ELSE string_split(rtrim(value, ' '), ' ') END) AS word FROM turn_lines""",
    "recs": r"""SELECT doc_id, line_no, CAST(doc_id AS VARCHAR) AS doc,
            string_split(regexp_replace(value, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), ' ') AS ws, list_filter(string_split(
            translate(regexp_replace(value, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'),
                chr(9) || chr(10) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '') AS w
        FROM lines""",
    "tokens": "SELECT doc_id, line_no, doc, unnest(ws) AS word FROM recs",
    "seqs": """SELECT phrase, doc, count(*) AS count FROM (
        SELECT doc, unnest(list_transform(range(1, len(w) - 1),
            lambda i: w[i] || '|' || w[i + 1] || '|' || w[i + 2])) AS phrase
        FROM recs WHERE len(w) >= 3) GROUP BY ALL""",
    "idx": """SELECT word, segment, string_agg(doc, ',' ORDER BY doc) AS docs, count(*) AS n FROM (
        SELECT word, doc, CAST((row_number() OVER (PARTITION BY word ORDER BY doc) - 1)
            // 200000 AS BIGINT) AS segment
        FROM (SELECT DISTINCT word, doc FROM tokens)) GROUP BY word, segment""",
    "ranked": """SELECT phrase, segment, count(*) AS n,
            string_agg(count || '|' || doc, ',' ORDER BY count DESC, doc) AS postings FROM (
        SELECT *, CAST((row_number() OVER (PARTITION BY phrase ORDER BY count DESC, doc) - 1)
            // 200000 AS BIGINT) AS segment FROM seqs) GROUP BY phrase, segment""",
    "tv": """SELECT doc, segment, string_agg(word || '-' || c, ',' ORDER BY c DESC, word) AS terms,
            max(c) AS top, count(*) AS n FROM (
        SELECT *, CAST((row_number() OVER (PARTITION BY doc ORDER BY c DESC, word) - 1)
            // 200000 AS BIGINT) AS segment
        FROM (SELECT doc, word, count(*) AS c FROM tokens GROUP BY ALL HAVING count(*) >= 2))
        GROUP BY doc, segment""",
    "edges": """SELECT l_orderkey, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem""",
    "vid_edges": """SELECT 'VertexID' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS src,
        'S' || l_suppkey AS dst, lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS digits FROM lineitem""",
    "deg": """SELECT vertex, sum(i) AS in_degree, sum(o) AS out_degree FROM (
        SELECT dst AS vertex, 1 AS i, 0 AS o FROM (SELECT DISTINCT src, dst FROM edges) UNION ALL
        SELECT src, 0, 1 FROM (SELECT DISTINCT src, dst FROM edges)) GROUP BY vertex""",
    "reviews": """SELECT *, l_partkey AS movie_id, l_suppkey AS rater_id,
        CAST(1 + l_linenumber % 5 AS INTEGER) AS rating FROM lineitem""",
    "top": """SELECT movie_id, count(*) AS n FROM reviews GROUP BY movie_id
        ORDER BY n DESC, movie_id DESC LIMIT 16""",
    "model": """SELECT CAST(dense_rank() OVER (ORDER BY movie_id DESC) - 1 AS INTEGER) AS cluster_id,
            movie_id, rater_id, rating, rn FROM (
        SELECT movie_id, rater_id, rating, row_number() OVER (PARTITION BY movie_id ORDER BY
            l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
        FROM reviews SEMI JOIN top USING (movie_id))""",
    "creviews": """SELECT cluster_id, rater_id, arg_min(rating, rn) AS c_rating FROM model
        GROUP BY ALL""",
    "sims": """SELECT movie_id, cluster_id,
            round(sum(rating * c_rating) / (sqrt(sum(rating * rating)) * sqrt(sum(c_rating * c_rating))), 9) AS sim
        FROM reviews JOIN creviews USING (rater_id) GROUP BY ALL""",
    "assigned": """SELECT movie_id, CAST(coalesce(cluster_id, 0) AS INTEGER) AS cluster_id,
            coalesce(sim, 0.0) AS similarity
        FROM (SELECT DISTINCT movie_id FROM reviews) LEFT JOIN (
            SELECT * FROM sims WHERE sim > 0
            QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY sim DESC, cluster_id) = 1)
        USING (movie_id)""",
    "sizes": "SELECT cluster_id, count(*) AS size FROM assigned GROUP BY cluster_id",
    "centres": """SELECT cluster_id, similarity, movie_id FROM (
        SELECT *, sum(CAST(similarity AS DECIMAL(20, 9))) OVER w AS total, count(*) OVER w AS n
        FROM assigned WINDOW w AS (PARTITION BY cluster_id))
        QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY
            round(abs(CAST(total AS DOUBLE) / n - similarity), 9), movie_id) = 1""",
    "centre_lines": """SELECT cluster_id, similarity, movie_id, movie_id || ':' ||
            string_agg(rater_id || '_' || rating, ',' ORDER BY
                l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS line
        FROM centres JOIN reviews USING (movie_id) GROUP BY cluster_id, similarity, movie_id""",
    "wcd": f"""SELECT word, CAST(sum(CASE WHEN starts_with(word, 'D') THEN 2 ELSE 1 END) AS BIGINT) AS count
        FROM words GROUP BY word""",
    "rare": "SELECT word FROM wc WHERE count = 3",
    "busy": "SELECT vertex FROM deg WHERE out_degree > 35",
    "small": "SELECT cluster_id FROM sizes WHERE size < 100",
    "r_pairs": """SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
        GROUP BY ALL""",
    "a_pairs": """SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A'
        GROUP BY ALL""",
}

# The reviews of a centroid's line, as far as the cut, are the model of a second step.
_START = """length(CAST(movie_id AS VARCHAR)) + 1 + coalesce(sum(length(rater_id || '_' || rating) + 1) OVER (
    PARTITION BY movie_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
PARTS["kept_reviews"] = f"""SELECT movie_id, rater_id, rating, row_number() OVER (PARTITION BY movie_id
        ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn, {_START} AS start
    FROM centres JOIN reviews USING (movie_id)"""
PARTS["model2"] = """SELECT CAST(dense_rank() OVER (ORDER BY movie_id DESC) - 1 AS INTEGER) AS cluster_id,
    rater_id, rating, rn FROM kept_reviews WHERE rn = 1 OR start <= 1000"""
for _name in ("creviews", "sims", "assigned", "centres", "centre_lines"):
    _text = PARTS[_name]
    for _of in ("model", "creviews", "sims", "assigned", "centres"):
        _text = re.sub(rf"(FROM|JOIN) {_of}\b", rf"\1 {_of}2", _text)
    PARTS[f"{_name}2"] = _text

# Which shared sub-queries each one reads.
NEEDS = {
    "words": ["lines"], "wc": ["words"], "turn_words": ["turn_lines"], "recs": ["lines"],
    "tokens": ["recs"], "seqs": ["recs"], "idx": ["tokens"], "ranked": ["seqs"], "tv": ["tokens"],
    "deg": ["edges"], "top": ["reviews"], "model": ["reviews", "top"], "creviews": ["model"],
    "sims": ["reviews", "creviews"], "assigned": ["reviews", "sims"], "sizes": ["assigned"],
    "centres": ["assigned"], "centre_lines": ["centres", "reviews"], "wcd": ["words"],
    "rare": ["wc"], "busy": ["deg"], "small": ["sizes"], "kept_reviews": ["centres", "reviews"],
    "model2": ["kept_reviews"], "creviews2": ["model2"], "sims2": ["reviews", "creviews2"],
    "assigned2": ["reviews", "sims2"], "centres2": ["assigned2"], "centre_lines2": ["centres2", "reviews"],
}


def sql(needs: str, body: str) -> str:
    """The statement with the shared sub-queries it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered) + "\n" + body


MARK = '"__faulty"'
VID_DEGREES = """SELECT vertex, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
    SELECT dst AS vertex, 1 AS i, 0 AS o FROM (SELECT DISTINCT src, dst FROM {kept}) UNION ALL
    SELECT src, 0, 1 FROM (SELECT DISTINCT src, dst FROM {kept})) GROUP BY vertex"""
KEPT_EDGES = "(SELECT * FROM vid_edges WHERE substr(src, 15, 5) <> '00013')"
CUT = """CASE WHEN {at} > 0 THEN substr({text}, 1, CAST(999 + {at} AS BIGINT)) ELSE {text} END"""


def cut(text: str) -> str:
    at = f"strpos(substr({text}, 1001), ',')"
    return CUT.format(at=at, text=text)


ORACLE: dict[str, str] = {
    "text_sink_source": sql("wc", "SELECT word, count FROM wc"),
    "parse_documents": sql("lines", r"""SELECT
        regexp_extract(v, '(?s)^(.*):([^:]*)$', 1) AS doc, regexp_replace(
            regexp_extract(v, '(?s)^(.*):([^:]*)$', 2), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS content
        FROM (SELECT 'src:' || doc_id || ':' || value AS v FROM lines)"""),
    "parse_edges": sql("vid_edges", "SELECT src, dst FROM vid_edges"),
    "parse_ratings": """SELECT l_partkey AS movie_id, CAST(0 AS INTEGER) AS pos, l_suppkey AS rater_id,
            CAST(1 + l_linenumber % 5 AS INTEGER) AS rating FROM lineitem UNION ALL
        SELECT l_partkey, 1, l_orderkey, CAST(1 + l_linenumber % 5 AS INTEGER) FROM lineitem""",
    "parse_phrase_counts": sql("seqs", "SELECT phrase, doc, count FROM seqs"),
    "parse_key_value": """SELECT CAST(o_orderkey AS VARCHAR) AS key,
        string_split(o_orderpriority, ' ')[1] AS value FROM orders""",
    "parse_numbers": "SELECT l_quantity AS n, count(*) AS lines FROM lineitem GROUP BY ALL",
    "centroid_model": sql("model", """SELECT cluster_id, movie_id, CAST(count(*) AS INTEGER) AS total,
        CAST(0 AS BIGINT) AS segment, string_agg(rater_id || '_' || rating, ',' ORDER BY rn) AS reviews FROM model GROUP BY ALL"""),
    "word_count": sql("wc", "SELECT word, count FROM wc"),
    "word_count_trimmed": sql("turn_lines", r"""SELECT word, count(*) AS count FROM (
        SELECT regexp_replace(unnest(CASE WHEN v <> '' AND trim(v, ' ') = '' THEN []
            ELSE string_split(rtrim(v, ' '), ' ') END), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS word
        FROM (SELECT regexp_replace(value, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS v FROM turn_lines))
        GROUP BY word"""),
    "word_count_by_lang": sql("words", """SELECT lang, word, count(*) AS count
        FROM words JOIN documents USING (doc_id) GROUP BY ALL"""),
    "grep_count": sql("lines", """SELECT match, count(*) AS count FROM (
        SELECT unnest(regexp_extract_all(value, 'th[aeiou][a-z]*')) AS match FROM lines) GROUP BY match"""),
    "sequence_count": sql("seqs", "SELECT phrase, doc, count FROM seqs"),
    "inverted_index": sql("idx", "SELECT word, segment, docs FROM idx"),
    "inverted_index_order": sql("idx", """SELECT word, segment,
        row_number() OVER (ORDER BY word, segment) AS position FROM idx"""),
    "inverted_index_repeats": sql("tokens", """SELECT word, segment,
            string_agg(repeat(doc || ',', n - 1) || doc, ',' ORDER BY doc) AS docs FROM (
        SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY word ORDER BY doc
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200000 AS BIGINT) AS segment
        FROM (SELECT word, doc, count(*) AS n FROM tokens GROUP BY ALL))
        GROUP BY word, segment"""),
    "ranked_inverted_index": sql("ranked", "SELECT phrase, segment, postings FROM ranked"),
    "term_vector_record": sql("tokens", """SELECT doc, line_no, CAST(0 AS BIGINT) AS segment,
            string_agg(word || '-' || c, ',' ORDER BY c DESC, word) AS terms FROM (
        SELECT doc, line_no, word, count(*) AS c FROM tokens GROUP BY ALL HAVING count(*) >= 2)
        GROUP BY doc, line_no"""),
    "term_vector_doc": sql("tv", "SELECT doc, segment, terms FROM tv"),
    "adjacency_list": sql("edges", """SELECT vertex,
            coalesce(string_agg(o, ',' ORDER BY o) FILTER (side = 1), '') AS from_list,
            coalesce(string_agg(o, ',' ORDER BY o) FILTER (side = 2), '') AS to_list FROM (
        SELECT DISTINCT dst AS vertex, 1 AS side, src AS o FROM edges UNION
        SELECT DISTINCT src, 2, dst FROM edges) GROUP BY vertex"""),
    "adjacency_text": """WITH links AS (SELECT url AS src,
            unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)
        SELECT vertex, 'from{' || coalesce(string_agg(o, ',' ORDER BY o) FILTER (side = 1), '') ||
            '}:to{' || coalesce(string_agg(o, ',' ORDER BY o) FILTER (side = 2), '') || '}' AS adjacency
        FROM (SELECT DISTINCT dst AS vertex, 1 AS side, src AS o FROM links UNION
        SELECT DISTINCT src, 2, dst FROM links) GROUP BY vertex""",
    "degrees": sql("deg", """SELECT vertex, CAST(in_degree AS BIGINT) AS in_degree,
        CAST(out_degree AS BIGINT) AS out_degree FROM deg"""),
    "ratings_histogram": sql("reviews", "SELECT rating, count(*) AS count FROM reviews GROUP BY rating"),
    "classify_centroid": sql("assigned", "SELECT movie_id, cluster_id, similarity FROM assigned"),
    "cluster_members": sql("assigned", """SELECT cluster_id, segment,
            string_agg(CAST(movie_id AS VARCHAR), ',' ORDER BY movie_id) AS movie_ids FROM (
        SELECT *, CAST((row_number() OVER (PARTITION BY cluster_id ORDER BY movie_id) - 1)
            // 200000 AS BIGINT) AS segment FROM assigned) GROUP BY cluster_id, segment"""),
    "kmeans_step": sql("centre_lines", f"""SELECT cluster_id, similarity, movie_id,
            len(string_split(r, ',')) AS n_reviews, r AS reviews FROM (
        SELECT *, substr(c, strpos(c, ':') + 1) AS r FROM (
            SELECT *, {cut('line')} AS c FROM centre_lines))"""),
    "truncate_reviews": f"SELECT doc_id, {cut('text')} AS cut FROM documents",
    "range_filter": "SELECT event_id, value FROM events WHERE value > 0 AND value < 100",
    "bucketize": """SELECT event_id, value, CASE WHEN value < 100 THEN 'Small'
        WHEN value < 1000 THEN 'Medium' ELSE 'Large' END AS category FROM events""",
    "category_stats": """SELECT CASE WHEN o_totalprice < 100000 THEN 'Small'
            WHEN o_totalprice < 300000 THEN 'Medium' ELSE 'Large' END AS category,
        count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY category""",
    "range_stats": """SELECT event_type, count(*) AS count, round(sum(value), 2) AS total,
            round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev
        FROM events WHERE value > 0 AND value < 100 GROUP BY event_type""",
    "terasort": "SELECT o_orderpriority AS key, o_orderstatus AS value FROM orders",
    "terasort_position": """SELECT o_orderpriority, o_orderkey,
        row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS position FROM orders""",
    "split_parts": """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) * 7
        // (SELECT count(*) FROM orders) AS INTEGER) AS part FROM orders""",
    "subtract_rows": sql("words turn_words", """SELECT word FROM words
        WHERE word NOT IN (SELECT word FROM turn_words)"""),
    "intersect_rows": sql("words turn_words", """SELECT word FROM words INTERSECT
        SELECT word FROM turn_words"""),
    "mark_word_count": sql("wc", f"SELECT word, count, count >= 3 AS {MARK} FROM wc"),
    "mark_inverted_index": sql("tokens", f"SELECT word, count(*) AS postings, count(*) > 3 AS {MARK} FROM tokens GROUP BY word"),
    "mark_ranked_index": sql("seqs", f"SELECT phrase, count(*) AS documents, count(*) > 1 AS {MARK} FROM seqs GROUP BY phrase"),
    "mark_sequence_count": sql("seqs", f"SELECT phrase, doc, count, count > 3 AS {MARK} FROM seqs"),
    "mark_term_vector": sql("tokens", f"""SELECT doc, count(*) AS n_terms, max(c) AS top_count,
        max(c) > 2 AND count(*) > 2 AS {MARK} FROM (
        SELECT doc, word, count(*) AS c FROM tokens GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc"""),
    "mark_out_degree": sql("deg", f"""SELECT vertex, CAST(in_degree AS BIGINT) AS in_degree,
        CAST(out_degree AS BIGINT) AS out_degree, out_degree > 35 AS {MARK} FROM deg"""),
    "mark_cluster_size": sql("sizes", f"SELECT cluster_id, size, size < 100 AS {MARK} FROM sizes"),
    "fault_prefix": sql("wcd", "SELECT word, count FROM wcd"),
    "fault_double_match": sql("lines", """SELECT match, count(*) * 2 AS count FROM (
        SELECT unnest(regexp_extract_all(value, 'th[aeiou][a-z]*')) AS match FROM lines) GROUP BY match"""),
    "fault_low_ratings": sql("reviews", """SELECT rating, count(*) AS count FROM reviews
        WHERE NOT (rating IN (1, 2) AND rater_id % 13 = 0) GROUP BY rating"""),
    "fault_lowest_ratings": sql("reviews", """SELECT rating, count(*) AS count FROM reviews
        WHERE NOT (rating = 1 AND movie_id % 13 = 0 AND rater_id % 13 = 0 AND rater_id % 7 = 0
            AND rater_id % 24 = 0 AND rater_id % 16 = 0) GROUP BY rating"""),
    "fault_edge_slice": sql("vid_edges", VID_DEGREES.format(kept=KEPT_EDGES)),
    "fault_rewrite_edge": sql("edges", """SELECT vertex,
            count(*) FILTER (side = 1) AS in_degree, count(*) FILTER (side = 2) AS out_degree FROM (
        SELECT dst AS vertex, 1 AS side, src AS o FROM edges UNION
        SELECT src, 2, CASE WHEN src = 'P13' THEN 'VertexIDA' ELSE dst END FROM edges) GROUP BY vertex"""),
    "fault_shift_cluster": sql("assigned", """SELECT movie_id, CAST(CASE WHEN movie_id = 1
        THEN cluster_id + 1 ELSE cluster_id END AS INTEGER) AS cluster_id FROM assigned"""),
    "fault_drop_movie": sql("reviews", """SELECT rating, count(*) AS count FROM reviews
        WHERE movie_id <> 1 GROUP BY rating"""),
    "fault_file_counts": sql("seqs", """SELECT phrase, segment, string_agg(
            (CASE WHEN contains(doc, '12') THEN count * 2 ELSE count END) || '|' || doc, ','
            ORDER BY count DESC, doc) AS postings FROM (
        SELECT *, CAST((row_number() OVER (PARTITION BY phrase ORDER BY count DESC, doc) - 1)
            // 200000 AS BIGINT) AS segment FROM seqs) GROUP BY phrase, segment"""),
    "diff_inner": sql("wc wcd", """SELECT word, wcd.count AS count, wc.count AS expected
        FROM wcd JOIN wc USING (word) WHERE wcd.count <> wc.count"""),
    "diff_full_exact": sql("wc turn_words", """SELECT word, CASE WHEN t.count IS NULL THEN 'extra'
            WHEN wc.count IS NULL THEN 'missing' ELSE 'changed' END AS status
        FROM wc FULL JOIN (SELECT word, count(*) AS count FROM turn_words GROUP BY word) t USING (word)
        WHERE wc.count IS DISTINCT FROM t.count"""),
    "diff_full_set": sql("r_pairs a_pairs", """SELECT l_partkey, l_suppkey,
            CASE WHEN a.n IS NULL THEN 'extra' ELSE 'missing' END AS status
        FROM r_pairs r FULL JOIN a_pairs a USING (l_partkey, l_suppkey)
        WHERE r.n IS NULL OR a.n IS NULL"""),
    "diff_full_bag": sql("r_pairs a_pairs", """SELECT l_partkey, l_suppkey,
            coalesce(r.n, 0) AS n_actual, coalesce(a.n, 0) AS n_expected,
            CASE WHEN a.n IS NULL THEN 'extra' WHEN r.n IS NULL THEN 'missing' ELSE 'changed' END AS status
        FROM r_pairs r FULL JOIN a_pairs a USING (l_partkey, l_suppkey)
        WHERE r.n IS DISTINCT FROM a.n"""),
    "diff_histogram_one_way": sql("reviews", """SELECT rating, 'changed' AS status FROM reviews
        WHERE rating <> 1 GROUP BY rating HAVING count(*) <>
            count(*) FILTER (NOT (rating IN (1, 2) AND rater_id % 13 = 0))"""),
    "diff_lists": sql("assigned", """SELECT cluster_id, movie_id, 'missing' AS status FROM assigned
        WHERE movie_id = 1 UNION ALL
        SELECT CAST(cluster_id + 1 AS INTEGER), movie_id, 'extra' FROM assigned WHERE movie_id = 1"""),
    "diff_adjacency": sql("vid_edges", f"""SELECT vertex, 'changed' AS status FROM (
        SELECT DISTINCT dst AS vertex FROM vid_edges WHERE substr(src, 15, 5) = '00013')
        SEMI JOIN {KEPT_EDGES} k ON k.dst = vertex"""),
    "trace_back_word": sql("rare words", """SELECT DISTINCT doc_id, line_no FROM words
        SEMI JOIN rare USING (word)"""),
    "trace_back_marked": sql("wc words", """SELECT DISTINCT doc_id, line_no FROM words
        SEMI JOIN (SELECT word FROM wc WHERE count >= 3) USING (word)"""),
    "trace_back_step": sql("rare words", """SELECT doc_id, line_no, CAST(pos AS INTEGER) AS pos, word
        FROM words SEMI JOIN rare USING (word)"""),
    "trace_back_per_output": sql("rare words", """SELECT DISTINCT word, doc_id, line_no FROM words
        SEMI JOIN rare USING (word)"""),
    "trace_captured": sql("rare words", """SELECT DISTINCT doc_id, line_no FROM words
        SEMI JOIN rare USING (word)"""),
    "trace_forward": sql("wc words", """SELECT word, count FROM wc WHERE word IN (
        SELECT word FROM words WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""),
    "trace_back_adjacency": sql("busy edges", """SELECT l_orderkey, src, dst FROM edges
        WHERE src IN (SELECT vertex FROM busy) OR dst IN (SELECT vertex FROM busy)"""),
    "trace_rerun_tail": """WITH all_edges AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst
            FROM lineitem),
        hubs AS (SELECT src AS vertex FROM all_edges GROUP BY src HAVING count(DISTINCT dst) > 35),
        e AS (SELECT DISTINCT src, dst FROM all_edges WHERE src IN (FROM hubs) OR dst IN (FROM hubs))
        SELECT vertex, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
            SELECT dst AS vertex, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e)
        GROUP BY vertex""",
    "trace_back_cluster": sql("small assigned", """SELECT l_orderkey, movie_id, rater_id, rating
        FROM reviews SEMI JOIN (SELECT movie_id FROM assigned SEMI JOIN small USING (cluster_id))
        USING (movie_id)"""),
    "trace_back_centroids": sql("small assigned creviews", """SELECT cluster_id, rater_id, c_rating
        FROM creviews WHERE rater_id IN (SELECT rater_id FROM reviews SEMI JOIN (
            SELECT movie_id FROM assigned SEMI JOIN small USING (cluster_id)) USING (movie_id))"""),
    "trace_forward_model": sql("creviews", """SELECT DISTINCT movie_id FROM reviews
        SEMI JOIN (FROM creviews WHERE cluster_id = 0 AND c_rating = 5) USING (rater_id)"""),
    "ddmin_single": "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 499690",
    "ddmin_exhaustive": """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS solution_id, o_orderkey
        FROM orders WHERE o_totalprice > 499690""",
    # Halves in turn: the first that holds a dear order is split next.
    "ddmin_history": """WITH RECURSIVE c AS (
            SELECT row_number() OVER (ORDER BY o_orderkey) AS upto,
                sum(CASE WHEN o_totalprice > 499690 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS dear FROM orders
            UNION ALL SELECT 0, 0),
        s AS (SELECT 0 AS run, CAST(0 AS BIGINT) AS lo, (SELECT count(*) FROM orders) AS hi
            UNION ALL SELECT run + 1, CASE WHEN first THEN lo ELSE mid END, CASE WHEN first THEN mid ELSE hi END FROM (
                SELECT s.*, lo + (hi - lo) // 2 AS mid, m.dear > l.dear AS first FROM s
                JOIN c l ON l.upto = lo JOIN c m ON m.upto = lo + (hi - lo) // 2 WHERE hi - lo > 1)),
        h AS (SELECT s.run + 1 AS run, lo, lo + (hi - lo) // 2 AS mid, hi, m.dear > l.dear AS first FROM s
            JOIN c l ON l.upto = lo JOIN c m ON m.upto = lo + (hi - lo) // 2 WHERE hi - lo > 1)
        SELECT CAST(0 AS INTEGER) AS run, (SELECT count(*) FROM orders) AS size, CAST(1 AS INTEGER) AS granularity,
            'whole' AS kind, CAST(0 AS INTEGER) AS index, (SELECT max(dear) > 0 FROM c) AS failed
        UNION ALL SELECT CAST(run AS INTEGER), mid - lo, CAST(2 AS INTEGER), 'part', CAST(0 AS INTEGER), first FROM h
            WHERE (SELECT max(dear) > 0 FROM c)
        UNION ALL SELECT CAST(run AS INTEGER), hi - mid, CAST(2 AS INTEGER), 'part', CAST(1 AS INTEGER), true FROM h
            WHERE NOT first AND (SELECT max(dear) > 0 FROM c)""",
    "ddmin_own_split": """SELECT o_orderkey FROM orders WHERE o_totalprice IN (
        (SELECT max(o_totalprice) FROM orders), (SELECT min(o_totalprice) FROM orders))""",
    "localize_word_trace": sql("words", "SELECT DISTINCT doc_id, line_no FROM words WHERE starts_with(word, 'D')"),
    "ddmin_pair": """SELECT o_orderkey FROM orders WHERE o_totalprice IN (
        (SELECT max(o_totalprice) FROM orders), (SELECT min(o_totalprice) FROM orders))""",
    "localize_word_count": sql("words", """SELECT doc_id, line_no FROM words
        WHERE starts_with(word, 'D') ORDER BY doc_id, line_no LIMIT 1"""),
    "localize_omission": sql("reviews", """SELECT l_orderkey, l_linenumber, l_suppkey FROM reviews
        WHERE rating IN (1, 2) AND rater_id % 13 = 0
        ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice LIMIT 1"""),
    "centroid_model_file": sql("model", """SELECT cluster_id, movie_id, CAST(0 AS DOUBLE) AS similarity,
        CAST(count(*) AS INTEGER) AS total, CAST(count(*) AS INTEGER) AS read FROM model GROUP BY ALL"""),
    "ranked_index_top": sql("seqs", """SELECT phrase, CAST(0 AS BIGINT) AS segment,
            string_agg(count || '|' || doc, ',' ORDER BY count DESC, doc) AS postings FROM (SELECT * FROM seqs
        QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY count DESC, doc) <= 3) GROUP BY phrase"""),
    "kmeans_twice": sql("centre_lines2", f"""SELECT cluster_id, similarity, movie_id,
            len(string_split(r, ',')) AS n_reviews, r AS reviews FROM (
        SELECT *, substr(c, strpos(c, ':') + 1) AS r FROM (
            SELECT *, {cut('line')} AS c FROM centre_lines2))"""),
    "terasort_unique_keys": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations FROM lineitem",
    "terasort_hot_key": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations FROM lineitem",
    "diff_adjacency_segments": sql("vid_edges", f"""SELECT vertex, 'changed' AS status FROM (
        SELECT DISTINCT dst AS vertex FROM vid_edges WHERE substr(src, 15, 5) = '00013')
        SEMI JOIN {KEPT_EDGES} k ON k.dst = vertex"""),
    "diff_from_truth_text": sql("wc", """SELECT word, CASE WHEN starts_with(word, 'Z') THEN 'extra' ELSE 'changed' END AS status
        FROM wc WHERE starts_with(word, 'D') OR starts_with(word, 'Z') UNION ALL
        SELECT '?' || chr(9) || word, 'unreadable' FROM wc WHERE starts_with(word, 'Z')"""),
    "diff_from_expected_file": sql("reviews", """SELECT rating,
            count(*) FILTER (NOT (rating IN (1, 2) AND rater_id % 13 = 0)) AS count, count(*) AS expected
        FROM reviews GROUP BY rating HAVING count(*) <> count(*) FILTER (NOT (rating IN (1, 2) AND rater_id % 13 = 0))"""),
    "trace_where_id": sql("words", "SELECT DISTINCT doc_id, line_no FROM words WHERE word = 'the'"),
    "trace_count": sql("rare words", """SELECT count(*) AS records FROM (SELECT DISTINCT doc_id, line_no FROM words
        SEMI JOIN rare USING (word))"""),
    "trace_back_grep": sql("lines", """SELECT DISTINCT doc_id, line_no FROM (
        SELECT doc_id, line_no, unnest(regexp_extract_all(value, 'th[aeiou][a-z]*')) AS match FROM lines) SEMI JOIN (
        SELECT match FROM (SELECT unnest(regexp_extract_all(value, 'th[aeiou][a-z]*')) AS match FROM lines)
        GROUP BY match HAVING count(*) = 3) USING (match)"""),
    "trace_back_sequence": sql("seqs", """SELECT DISTINCT doc_id, line_no FROM (SELECT doc_id, line_no, doc,
            unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '|' || w[i + 1] || '|' || w[i + 2])) AS phrase
        FROM recs WHERE len(w) >= 3) SEMI JOIN (FROM seqs WHERE count > 3) USING (phrase, doc)"""),
    "trace_back_index": sql("tokens", """SELECT DISTINCT doc_id, line_no FROM tokens SEMI JOIN (
        SELECT word FROM tokens GROUP BY word HAVING count(DISTINCT doc) = 2) USING (word)"""),
    "trace_back_ranked_index": sql("seqs", """SELECT phrase, doc, count FROM seqs SEMI JOIN (
        SELECT phrase FROM seqs GROUP BY phrase HAVING count(*) > 2) USING (phrase)"""),
    "trace_back_terms": sql("tokens", """SELECT DISTINCT doc_id, line_no FROM tokens SEMI JOIN (
        SELECT doc, word FROM (SELECT doc, word, count(*) AS c FROM tokens GROUP BY ALL HAVING count(*) >= 2)
        QUALIFY max(c) OVER (PARTITION BY doc) > 2 AND count(*) OVER (PARTITION BY doc) > 2) USING (doc, word)"""),
    "trace_back_histogram": sql("reviews", "SELECT l_orderkey, l_linenumber FROM reviews WHERE rating = 1"),
    "trace_back_centre": sql("assigned", "SELECT movie_id, similarity FROM assigned WHERE cluster_id = 0"),
    "trace_back_category": "SELECT event_id, value FROM events WHERE value > 50 AND value < 100",
    "localize_rewritten_edge": """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = 13
        ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice LIMIT 1""",
    "localize_shifted_cluster": """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS movie_id FROM lineitem
        WHERE l_partkey = 1 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice LIMIT 1""",
}
