"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from backtrail.llm import (decontaminate, html_text, isotonic, language_id, line_dedup, mixing,
                           near_dedup, neighbours, quality, substring_dedup, textbytes, toxicity)
from backtrail.llm.boosting import grow
from backtrail.llm.common import remainder
from backtrail.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def messy(spark):
    """Null ids, texts and sources, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = " ".join(prose(rng, 120))
    near = base.replace(base.split()[60], "changed", 1)
    lines = "\n".join(" ".join(prose(rng, 9)) for _ in range(8))
    texts = [base, base, near, None, "", "   \n\t ", lines, lines + "\nlast line here", "one",
             " ".join(prose(rng, 30_000)), base.upper(), "É é ß", "!!!", lines, None]
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[6], (None, base, None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "fp", "copy", "position", "n_lines", "rows", "lines", "removed", "best", "toxicity", "__doc", "__fp",
                 "node", "bucket", "component", "block"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame


@pytest.fixture(scope="module")
def nothing(messy):
    return messy.limit(0)


def test_decontamination_brute_force(spark):
    rng = random.Random(1)
    items = [" ".join(prose(rng, n, 30)) for n in (25, 10, 4, 1, 12)] + ["", None, "A-b C"]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 80), 30)
        if i % 3 == 0:
            words[5:5] = items[i % 5].split()
        docs.append((i, " ".join(words).title() if i % 2 else ", ".join(words)))
    docs += [(60, None), (61, ""), (62, "x a\tB...c y")]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in got.collect():
        words = split(dict(docs)[r["doc_id"]])
        hit, found = set(), set()
        for item, text in enumerate(items):
            w = split(text)
            m = min(10, len(w))
            tests = {tuple(w[s:s + m]) for s in range(len(w) - m + 1)} if w else set()
            for s in range(len(words) - m + 1):
                if tuple(words[s:s + m]) in tests:
                    hit.update(range(s, s + m))
                    found.add(str(item))
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), len(hit), sorted(found))


def test_decontamination_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this, a b c d e f g h i J! and that"), (2, "a b"), (3, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string")
    got = {r[0]: r[1] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert got[1].split() == ["Keep", "this,", "!", "and", "that"] and got[2] == "a b" and got[3] is None
    assert {r[0] for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 12)).astype(np.float32)
    vectors[50:120] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [None] * 12), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 50))
    v = vectors.astype(float)
    for q, found in got.items():
        scores = [(-float(neighbours.cosine(v[q:q + 1], v[i:i + 1])[0]), i) for i in range(300) if i != q]
        want = sorted(scores)[:5]
        assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in want]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]


def test_quantization_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 16)) * rng.uniform(0.1, 50, (40, 1))
    cells, scale, error = neighbours.quantized(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    off = np.abs(unit @ unit.T - (cells * scale[:, None]) @ (cells * scale[:, None]).T)
    assert (off <= error[:, None] + (1 + error[:, None]) * error[None, :] + 1e-12).all()


def test_line_dedup_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(50)]
    docs += [(50, None), (51, docs[3][1])]
    for depth in (1, 2, 3, 5):
        rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), depth, False)
        got = {r["doc_id"]: r for r in rows.collect()}
        seen = set()
        for i, text in docs:
            if text is None:
                assert got[i]["text"] is None
                continue
            lines = text.split("\n")
            held = [j for j, x in enumerate(lines) if x.strip()]
            gone = set()
            for s in range(len(held) - depth + 1):
                run = tuple(lines[j] for j in held[s:s + depth])
                if run in seen:
                    gone.update(held[s:s + depth])
                seen.add(run)
            assert got[i]["text"] == "\n".join(x for j, x in enumerate(lines) if j not in gone), (i, depth)
            assert (got[i]["n_lines"], got[i]["n_lines_removed"]) == (len(held), len(gone))


def test_maximal_runs(spark):
    a = [f"line {i}" for i in range(20)]
    docs = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:9], "y", "", *a[11:16], "z", *a[17:19]])), (3, "\n".join(a)),
            (4, "\n".join(["q"] * 6)), (5, None), (6, "\n".join([*a[8:10], "x", *a[2:5]]))]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 3, False).collect()}
    assert {i: (r["n_runs"], r["longest_run"], r["n_lines_removed"]) for i, r in rows.items()} == {
        1: (0, 0, 0), 2: (2, 7, 12), 3: (1, 20, 20), 4: (3, 3, 5), 5: (0, 0, 0), 6: (2, 3, 4)}
    windows = line_dedup.repeated_suffixes(line_dedup.line_ids(spark.createDataFrame(docs, "doc_id long, text string")), 3)
    runs = line_dedup.maximal_runs(windows).filter("doc_id = 2").orderBy("pos").collect()
    assert [(r["pos"], r["lines"], r["first"]["doc_id"], r["first"]["pos"]) for r in runs] == [(1, 7, 1, 2), (9, 5, 1, 11)]


def test_line_dedup_long_short_runs(spark):
    rng = random.Random(12)
    pool = [" ".join(prose(rng, n, 10**6)) for n in (1, 1, 2, 3, 5, 8, 11, 13, 20, 24)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}"
                          for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    for depth, words in ((3, 20), (5, 12), (1, 4)):
        rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), depth, False, words)
        got = {r["doc_id"]: r for r in rows.collect()}
        seen = set()
        for i, text in docs:
            lines = text.split("\n")
            held = [j for j, x in enumerate(lines) if x.strip()]
            gone = set()
            for s in range(len(held)):
                for n in range(1, min(depth, len(held) - s) + 1):
                    run = tuple(lines[j] for j in held[s:s + n])
                    if run in seen and (n == depth or sum(len(x.split()) for x in run) >= words):
                        gone.update(held[s:s + n])
                    seen.add(run)
            assert got[i]["text"] == "\n".join(x for j, x in enumerate(lines) if j not in gone), (i, depth)
            assert (got[i]["n_lines"], got[i]["n_lines_removed"]) == (len(held), len(gone))
    passage = pool[9]  # on one line of two otherwise different documents
    docs = spark.createDataFrame([(1, f"one\n{passage}", None, "s", 0), (2, f"{passage}\ntwo", None, "s", 0)], DOCS)
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert rows == {1: f"one\n{passage}", 2: "two"}


def test_near_dedup_brute_force(spark):
    rng = random.Random(8)
    docs, bases = [], [prose(rng, rng.randrange(60, 200), 5000) for _ in range(12)]
    for i in range(150):
        words = list(bases[i % 12])
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(150, ""), (151, None), (152, "a b"), (153, "A  b"), (154, None)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seqs = [near_dedup.kmers(next(textbytes.chunks(pa.array([t], pa.string()))))[0] for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            if len(a) and len(b):
                m = lcs(a.tolist(), b.tolist())
                if m / (len(a) + len(b) - m) >= 0.8:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(docs))}


def lcs(a, b):
    if not set(a) & set(b):
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(keep, row[j])
            last = keep
    return row[-1]


def test_alignment_matches_plain_lcs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        b = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        want = lcs(a.tolist(), b.tolist())
        for needed in (0, want, want + 1):
            assert near_dedup.common(a, b, needed) == (want if needed <= want else -1)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (3, 4), (4, 5), (20, 21)] + [(100, i) for i in range(101, 160)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got[5] == 1 and got[10] == 9 and got[21] == 20 and got[159] == 100 and len(got) == 69


def test_substring_dedup_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(rng, n, 10**6) for n in (49, 50, 55, 140)]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 150), 10**6)
        for p in passages:
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = p
        docs.append((i, " \n".join(words)))
    docs += [(60, docs[7][1]), (61, None), (62, ""), (63, "r " * 130), (64, "r " * 90), (None, docs[9][1])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    texts = dict(docs)
    first = {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words = (text or "").split()
        for s in range(len(words) - 49):
            first.setdefault(tuple(words[s:s + 50]), i)
    for r in got.collect():
        words = (texts[r["doc_id"]] or "").split()
        gone = set()
        for s in range(len(words) - 49):
            if first[tuple(words[s:s + 50])] != r["doc_id"]:
                gone.update(range(s, s + 50))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(words), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_substring_dedup_ids_of_any_kind(spark):
    rng = random.Random(19)
    passage = prose(rng, 60, 10**6)
    docs = [(i, " ".join([*prose(rng, 20, 10**6), *passage, *prose(rng, 20, 10**6)])) for i in ("b", "a", None, "c", "a")]
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(
        spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == {(None, 0), ("a", 60), ("b", 60), ("c", 60)}
    # Many texts of one id: their hashes tell them apart.
    many = [(None, " ".join(prose(rng, 55, 10**6))) for _ in range(700)] + [(1, many_text) for many_text in ("x y",)]
    many += [(2, many[3][1] + " more words"), (3, many[5][1])]
    rows = substring_dedup.remove_repeats(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in rows if r["doc_id"] is None) == 0
    assert {r["doc_id"]: r["n_removed"] for r in rows if r["doc_id"] is not None} == {1: 0, 2: 55, 3: 55}


def test_neighbours_of_extreme_vectors(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [1e300, -2e300]), (4, [2.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, 3)
    assert [(r["vec_id"], round(r["score"], 9)) for r in got.orderBy("rank").collect()] == [(2, 1.0), (4, 0.8), (3, -0.6)]


def test_mixing_targets_and_order(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    docs += [(900, None, "e"), (0, docs[0][1], docs[0][2])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.plan(frame).collect()
    assert len(rows) == len(docs)
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        price = rest / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 2 * sizes[s] < price * weight[s]}
        if not more:
            break
        capped |= more
    for s in order:
        want = 2 * sizes[s] if s in capped else price * weight[s]
        assert targets[s] == pytest.approx(want) and abs(taken[s] - want) <= 60
    mixed = mixing.mix(frame).collect()
    assert len(mixed) == sum(r["copies"] for r in rows)
    assert all(0 <= r["position"] <= 1 for r in mixed)
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)


def test_positions_are_those_of_the_schedule(spark, messy):
    planned = mixing.plan(messy)
    rows = mixing.positions(planned)
    want = defaultdict(list)
    for r in mixing.schedule(planned).collect():
        want[r["doc_id"], r["fp"]].append(r["position"])
    seen = rows.collect()
    assert [r["first_position"] or 0 for r in seen] == sorted(r["first_position"] or 0 for r in seen)
    for r in seen:
        held = want[r["doc_id"], r["fp"]]
        if r["copies"]:
            assert r["first_position"] in held and r["last_position"] in held and r["first_position"] <= r["last_position"]
        else:
            assert r["first_position"] is None and r["last_position"] is None
    assert mixing.positions(mixing.plan(messy.limit(0))).count() == 0


def test_curriculum_inverts_the_integral(spark):
    for k, knots in enumerate(mixing.CURRICULUM):
        parts = spark.createDataFrame([(i / 20, k) for i in range(21)], "part double, turn int")
        for part, t in parts.select("part", mixing.when_reached(F.col("part"), F.col("turn"))).collect():
            area = whole = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                whole += (t1 - t0) * (w0 + w1) / 2
                end = min(max(t, t0), t1)
                at = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                area += (end - t0) * (w0 + at) / 2
            assert area / whole == pytest.approx(part, abs=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head>
<body class="page"><header><a href=/>Home</a> <nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, accept them all please.</p></div>
<div id=content><div class="sidebar"><p>Side text that is not in it.</p><a href=x>More</a></div>
<div class="post"><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b>
   paragraph with a <a href="l">link</a>, and enough text to be dense &#233; &lt;ok&gt;.<p>Second paragraph, also long enough to count as text of the page.<br>After a break.
<ul><li>An item<li>Another item</ul><div class="ad">Buy now</div><blockquote>Quoted words of some length, too.</blockquote>
<form><input name=q>Search<button>Go</button></form><!-- c <p>x</p> --></div>
<div id="comments"><p>A reader says something long about the article, at length, as readers do.</p></div></div>
<footer>&copy; someone</footer></body></html>"""


def test_html_text():
    want = ("The title & more First bold paragraph with a link, and enough text to be dense é <ok>. "
            "Second paragraph, also long enough to count as text of the page. After a break. An item "
            "Another item Quoted words of some length, too.")
    assert html_text.extract(PAGE) == want
    assert html_text.extract(PAGE[:PAGE.index("<footer")]) == want
    for text in (None, "", "<html><body></body></html>", "<nav>x</nav>", "<script>unclosed <p>x"):
        assert html_text.extract(text) == ""
    assert html_text.extract("just text &lt;3") == "just text <3"
    assert html_text.extract("<p>" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_html_densities_choose_in_articles():
    def text(k, n):
        return [f"{k}{i} has words enough to be a paragraph of an article, and some more of them." for i in range(n)]

    def inside(lines):
        return "".join(f"<p>{x}</p>" for x in lines)

    one, two, links = text("one", 6), text("two", 4), "<ul>" + "<li><a href=/x>Go there</a></li>" * 9 + "</ul>"
    box = f"<div class=box><h3>Elsewhere</h3>{links}</div>"
    for before, after in (("<main>", "</main>"), ("<div>", "</div>")):  # of two articles both stay
        page = f"<body>{before}<article>{inside(one)}</article>{box}<article>{inside(two)}</article>{after}</body>"
        assert html_text.extract(page) == " ".join(one + two)
    for name in ("article", "main"):  # a box of links goes, sections and titles stay
        page = (f"<body><{name}><header><h1>Title</h1></header><div>{inside(one)}</div>"
                f"<h2>Next</h2><div>{inside(two)}</div><div>{links}</div></{name}></body>")
        assert html_text.extract(page) == " ".join(["Title", *one, "Next", *two])
    page = f"<body><article><p>Short.</p></article><div>{inside(one)}</div></body>"
    assert html_text.extract(page) == " ".join(one)
    assert html_text.extract("<main><article>" + "<div>" * 5000 + "deep") == "deep"


def test_html_unwanted_without_an_end():
    text = "The body of the page, which is long enough to be told from what is around it."
    for start in ("<div class=ad>Buy", "<nav><a href=x>Go</a>", "<aside>Side", "<nav><ul><li>Go", "<svg><path d='M0'/>"):
        assert html_text.extract(f"<body>{start}<article><p>{text}</p></article></body>") == text
        assert text in html_text.extract(f"<body>{start}<p>{text}</p><p>{text}</p></body>")
        page = f"<body><div>{start}</div><article><p>{text}</p></article><div>{start}</div></body>"
        assert html_text.extract(page) == text
    script = '<script>document.write("<div>x")</script>'
    assert html_text.extract(f"<div class=ad>{script}</div><p>{text}</p>") == text
    assert html_text.extract(f"<head><meta charset=x><body><p>{text}</p></body>") == text
    page = f"<p>{text}<aside><p>Side</p></aside><button><div>Go</div></button><ul><li>One<menu><li>No</menu></ul>"
    assert html_text.extract(page) == text + " One"
    assert html_text.extract("<nav>" + "<div class=ad>" * 5000 + "deep" + "</div>" * 5000 + "</nav>") == ""


def test_html_names_of_wrappers():
    text = "The body of the page, which is long enough to be told from what is around it."
    for name in ("content-sidebar-wrap", "layout has-sidebar", "page-wrapper no-sidebar", "elementor-widget-container",
                 "widget_container", "sidebar", "ad"):
        for kind in ("article", "div"):
            page = f'<body><div class="{name}"><{kind}><p>{text}</p><p>{text}</p></{kind}></div></body>'
            assert html_text.extract(page) == text + " " + text, (name, kind)
    for header in ("header class=entry-header", "div class=entry-header", "div class=header"):
        page = f"<article><{header}><h1>Title</h1></{header.split()[0]}><div><p>{text}</p><p>{text}</p></div></article>"
        assert html_text.extract(page) == f"Title {text} {text}", header
    widgets = "".join(f"<div class=widget><article><p>{text}</p></article></div>" for _ in range(3))
    for page in (f"<body>{widgets}</body>", f"<main>{widgets}</main>"):
        assert html_text.extract(page) == " ".join([text] * 3)
    for name in ("ad", "ads top", "cookie-notice", "sidebar", "comment-list", "footer_nav", "Related"):
        page = f'<body><div><p>{text}</p><p>{text}</p></div><div class="{name}"><p>{text}</p></div></body>'
        assert html_text.extract(page) == text + " " + text, name
    page = f'<body><article><p>{text}</p></article><div class="related"><article><p>Short one.</p></article></div></body>'
    assert html_text.extract(page) == text


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "", None)],
                                  "page_id long, url string, html string, text string")
    rows = html_text.extract_pages(pages).collect()
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and rows[1]["text"] == ""
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(6)
    stems = {"xx": ["ba", "lo", "mi", "ta"], "yy": ["sch", "ung", "ein", "keit"], "zz": ["tion", "eux", "ré", "ou"]}
    docs = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), k)
            for i, k in enumerate(list(stems) * 120)]
    frame = spark.createDataFrame(docs + [(900, None, "xx"), (901, "123 !", "yy"), (902, "bala", None)],
                                  "doc_id long, text string, lang string")
    model = language_id.fit(frame, remainder("doc_id", 3) != 1, epochs=12)
    rows = language_id.predict(frame, model).withColumn("held", remainder("doc_id", 3) == 1).collect()
    by_id = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if r["held"] and r["doc_id"] < 900]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == "und" and by_id[902]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifiers_held_out(spark, sf):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    tox = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    rows = toxicity.score(docs.select("doc_id", "text"), tox).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.9
    measured = quality.measure(docs)
    model = quality.fit(measured, labels, remainder("doc_id", 4) != 2)
    rows = quality.score(measured, model).join(labels, "doc_id").withColumn("held", remainder("doc_id", 4) == 2).collect()
    held = [r for r in rows if r["held"]]
    assert np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in held]) > 0.9


def test_boosting_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = grow(x, y, np.ones(600))
    assert ((trees.margins(x) > 0) == (y > 0.5)).mean() > 0.95
    knots, rates = isotonic.fit(trees.margins(x), y)
    assert (np.diff(rates) >= 0).all() and 0 <= rates.min() and rates.max() <= 1


def test_awkward_tables(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (None, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (6, 1, 0), (9, 0, 1), (None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    for docs in (messy, nothing):
        n = docs.count()
        assert decontaminate.report(docs, bench).count() == n
        assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0
        assert decontaminate.decontaminate(docs, bench, remove="spans").columns == docs.columns
        assert line_dedup.dedup_lines(docs, drop_emptied=False).count() == n
        distinct = docs.select("doc_id", "text").distinct().count()
        assert near_dedup.classes(docs).count() == distinct
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() <= distinct
        assert mixing.plan(docs).count() == n
        assert mixing.mix(docs).count() >= 0
        assert substring_dedup.remove_repeats(docs).count() == n
        for used in (labels, labels.limit(0)):
            model = toxicity.fit(docs, used, per_class=50)
            assert toxicity.score(docs.select("doc_id", "text"), model).filter("score between 0 and 1").count() == n
            assert toxicity.keep_clean(docs, model).columns == docs.columns
            measured = quality.measure(docs)
            assert quality.score(measured, quality.fit(measured, used)).filter("score between 0 and 1").count() == n
        model = language_id.fit(docs, epochs=2)
        assert language_id.predict(docs, model).count() == n
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, F.lit(True)).count() == 0


def test_repeats_in_awkward_tables(messy):
    classes = {(r["doc_id"], r["fp"]): r["class_id"] for r in near_dedup.classes(messy).collect()}
    by_id = defaultdict(set)
    for (doc, _), c in classes.items():
        by_id[doc].add(c)
    assert by_id[0] == by_id[1] == by_id[2] == by_id[10] == {None}  # the text of a null id comes first
    assert by_id[3] == {3} and by_id[4] == {4}
    kept = near_dedup.keep_one(messy)
    assert kept.filter("doc_id in (0, 1, 2, 10)").count() == 0 and kept.filter("doc_id = 6").count() == 1


def test_pipeline(spark, sf):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count()
    classes = near_dedup.classes(out.dropDuplicates(["doc_id"]).drop("copy", "position"))
    assert classes.filter("not kept").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.report(out, bench).filter("contaminated").count() == 0
    assert math.isclose(out.agg(F.max("copy")).first()[0], 2, abs_tol=1)
