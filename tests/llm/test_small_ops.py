"""The operators of the subpackage against brute force, with nulls, empty and repeated rows, clashing names and empty tables."""

import collections
import hashlib
import random
import struct

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from sparkset.llm import bpe, decontaminate, html_text, licenses, line_dedup, quality_knn, quality_rules, simhash, suffixes, url_filter
from sparkset.llm import queries as q
from sparkset.llm.components import connected_components
from sparkset.llm.shared import keep, release
from sparkset.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, blank and repeated rows, ids that occur twice, a very long text, columns named like those that operators add."""
    long_text = "\n".join(f"line {i} of a very long text, with words {i * 7 % 1000} and more" for i in range(20_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (4, "one", "en", None, 3), (5, long_text, "en", "b", 1), (5, long_text, "en", "b", 1), (6, "é" * 300, "fr", "b", 300), (None, "no id " * 60, "en", "b", 360), (7, "x\x1cy\u00a0z  tail", "en", "c", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k1", "k2", "bytes", "key", "fp", "runs", "score", "words_", "limit_0", "text_", "kept", "part_", "window", "template"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(q.QUERIES[name](spark, SF), duck, q.ORACLE_SQL[name])


# -- 1: quality rules -------------------------------------------------------------------------------------------------


def test_quality_counts(spark):
    def brute(text):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = collections.Counter(grams)
        covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    rng = random.Random(4)
    texts = [None, "", "  ", "a b c d e a b c d e", "a " * 30, "x\n\nx\n \nx", "é#|<> b"] + ["".join(rng.choice("ab \n#") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.measured(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_sketch_buckets(spark):
    rows = spark.range(0, 5000).select("id", quality_rules.sketch_bucket(F.col("id")).alias("b"))
    rows = rows.select("id", "b", quality_rules.bucket_value(F.col("b")).alias("v")).orderBy("id").collect()
    assert all(r["v"] <= r["id"] < r["v"] * (1 + 1 / 32) + 1 for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_quality_rules_edges(odd, empty):
    rows = quality_rules.apply_rules(odd).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["n_words"] < 10)
    assert quality_rules.apply_rules(empty).count() == 0
    good = {r["doc_id"] for r in rows if r["kept"] and r["doc_id"] is not None}
    assert {r["doc_id"] for r in quality_rules.filter_documents(odd).collect()} == good and quality_rules.filter_documents(odd).columns == odd.columns


# -- 2: license scan --------------------------------------------------------------------------------------------------


def test_license_scan(spark, odd, empty):
    mit = "Released under the MIT License."
    long_notice = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted"))
    edited = long_notice.replace("charge", "cost")
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice("the of and to in is it that was for".split()) + str(rng.randrange(99)) for _ in range(n))
    texts = [mit, f"{noise(501)} {mit.upper()} {noise(77)}", f"{noise(13)}\n{long_notice}", f"{noise(7)} {edited} {noise(9)}", noise(300), "under the MIT License", "Licensed under CC BY-NC 4.0. " + mit]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    assert got == {(0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (6, "CC-BY-NC-4.0"), (6, "MIT")}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0 and licenses.scan(df, []).count() == 0


def test_license_windows_never_miss_at_any_offset(spark):
    texts = [" ".join(f"w{i}" for i in range(k)) + " This work is licensed under the GNU General Public License, version 3. " + " ".join(f"v{i}" for i in range(k)) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert licenses.scan(df).where("license = 'GPL-3.0'").select("doc_id").distinct().count() == 40


def test_license_short_templates_and_null_ids(spark):
    short = [("MIT", "MIT License"), ("none", " - "), ("RIGHTS", "All rights reserved."), ("MIT", "Released under the MIT License")]
    rows = [(1, "the mit-license, x"), (2, "license MIT"), (3, "All rights are reserved"), (4, "all Rights RESERVED"), (None, "Released under the MIT License"), (None, "all rights reserved here"), (None, "all rights reserved here"), (5, "no"), (5, "MIT license"), (5, "mit LICENSE mit license")]
    got = sorted(((r["doc_id"] or 0), r["template"], r["n_shared"], r["n_shingles"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), short).collect())
    assert got == [(0, 0, 1, 1), (0, 2, 1, 1), (0, 3, 1, 1), (1, 0, 1, 1), (4, 2, 1, 1), (5, 0, 1, 1)]


def test_license_bands_against_all_shingles(spark):
    """Thousands of templates, with edits: what bands retrieve and shingles verify is what all pairs of shingles say."""
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    templates = [(f"L{i}", " ".join(say(rng.randrange(5, 40)))) for i in range(5200)]
    texts = []
    for _ in range(150):
        words = templates[rng.randrange(len(templates))][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(say(rng.randrange(90)) + words + say(rng.randrange(90))))
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted, held = [cut(t.split()) for _, t in templates], [cut(t.split()) for t in texts]
    want = {(i, k, len(h & w)) for i, h in enumerate(held) for k, w in enumerate(wanted) if len(h & w) >= 0.8 * len(w)}
    got = {(r["doc_id"], r["template"], r["n_shared"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    assert got == want and len(want) > 60


# -- 3: URL filter ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.default_labelled(spark))


def test_url_rules_and_scores(spark, url_model):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "http://sub.www.example.com/en/", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://evilcom/", "http://x.com", "ftp://h.org/p://q", "http://spam-farm.example.org/en/7"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    model = url_model
    rows = {r["page_id"]: r for r in url_filter.judge(df, model).collect()}
    assert [(rows[i]["host"], rows[i]["path"]) for i in (0, 2, 3, 10, 11)] == [("", ""), ("", ""), ("a.example.com", "/en/x"), ("x.com", ""), ("h.org", "/p://q")]
    assert [rows[i]["rule"] for i in range(3, 11)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None]
    assert rows[3]["verdict"] == "block" and rows[4]["verdict"] == "allow" and rows[12]["verdict"] == "block"
    assert url_filter.judge(df.limit(0), model).count() == 0
    # the score against the same sum in Python
    buckets = df.select("page_id", url_filter.gram_buckets(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("b")).collect()
    for r in buckets:
        total = model.intercept + sum(model.weights[b] for b in r["b"]) / max(1, len(r["b"])) ** 0.5
        assert rows[r["page_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_many_url_rules_are_joined(spark):
    rng = random.Random(8)
    hosts = ["a.com", "b.a.com", "com", "net", "x.net", "y.x.net", "www.b.a.com", ""]
    paths = ["/", "/a/", "/a/b", "/b/"]
    rules = list({(rng.choice(["allow", "block"]), rng.choice(hosts[:-2]) + rng.choice(paths)) for _ in range(40)}) + [("block", f"h{i}.org/") for i in range(url_filter.MOST_IN_PLAN)]
    urls = [None, "no scheme"] + [f"http://{rng.choice(['', 'z.', 'h3.'])}{rng.choice(hosts)}{rng.choice(['', *paths])}{rng.choice(['', 'c', '?q'])}" for _ in range(200)] + ["http://www.h7.org/x"] * 2
    df = spark.createDataFrame([(i if i % 9 else None, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host_ string")
    both = df.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    plain = both.select("page_id", "host", "path", url_filter.ruled(F.col("host"), F.col("path"), rules[:60]).alias("r")).select("page_id", "host", "path", "r.rule", "r.verdict")
    model = url_filter.UrlModel([0.0] * url_filter.BUCKETS, -9.0)
    made = url_filter.judge(df, model, rules)
    key = lambda r: tuple(str(x) for x in r)
    few = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in plain.collect() if r["rule"] and not r["rule"].startswith("h7.")), key=key)
    many = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in made.collect() if r["rule"] and not r["rule"].startswith("h7.")), key=key)
    assert few == many and made.count() == len(urls) and made.columns == ["page_id", "url", "host_", "host", "path", "rule", "verdict", "score"]
    assert made.where("rule = 'h7.org/'").count() == 2 and url_filter.judge(df.limit(0), model, rules).count() == 0


def brute_buckets(host, path):
    import xxhash

    out = []
    for k, text in enumerate((f"^h{host}$", f"^p{path}$")):
        for n in url_filter.GRAMS:
            for i in range(len(text) - n + 1):
                of_text = xxhash.xxh64_intdigest(text[i : i + n].encode(), 42)
                h = xxhash.xxh64_intdigest(struct.pack("<i", k), of_text)
                out.append((h - (h >> 63 << 64)) % url_filter.BUCKETS)
    return out


def test_url_grams_and_training_against_numpy(spark, url_model):
    table = url_filter.default_labelled(spark)
    rows = table.select("label", url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    got = rows.select("label", "h", "p", url_filter.gram_buckets(F.col("h"), F.col("p")).alias("b")).collect()
    assert all(sorted(r["b"]) == sorted(brute_buckets(r["h"], r["p"])) for r in got)
    x = np.array([np.bincount(brute_buckets(r["h"], r["p"]), minlength=url_filter.BUCKETS) / len(r["b"]) ** 0.5 for r in got])
    y, model = np.array([r["label"] for r in got], float), url_model
    w = np.array(model.weights)
    error = 1 / (1 + np.exp(-(x @ w + model.intercept))) - y
    gradient = x.T @ error / len(y) + 0.001 * w  # zero where the regularised loss is least
    assert np.abs(gradient).max() < 1e-3 and abs(error.mean()) < 1e-3


def test_url_accuracy_on_unknown_hosts(spark):
    import zlib

    fold = lambda u: zlib.crc32(u.split("//")[1].split(".example")[0].split(".test")[0].encode()) % 5
    assert not any(x in u for u, _ in url_filter.LABELLED for x in ("ads-track", "spam-farm", "free-bets", "casino-win", "cheap-pills", "adult-x"))
    known, asked = ([r for r in url_filter.LABELLED if (fold(r[0]) == 0) == own] for own in (False, True))
    made = url_filter.judge(spark.createDataFrame(asked, "url string, y int"), url_filter.train(spark.createDataFrame(known, "url string, label int")), rules=(), threshold=0.5)
    assert made.where("(y = 1) = (verdict = 'block')").count() >= 0.9 * len(asked)


def test_url_edges(spark, url_model):
    rows = [(None, "http://a/" + "x" * 50_000), (1, "http://a/b"), (1, "http://a/b"), (None, None)]
    made = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_model).collect()
    assert len(made) == 4 and len([r for r in made if r["page_id"] == 1]) == 2 and all(0 <= r["score"] <= 1 for r in made)


def test_url_model_learns(spark, url_model):
    table = url_filter.default_labelled(spark)
    made = url_filter.judge(table.withColumnRenamed("label", "y"), url_model, rules=())
    assert made.where("(y = 1) != (score >= 0.5)").count() <= 0.02 * len(url_filter.LABELLED)


# -- 4: line dedup ----------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    """Every run of lines with enough words, by its first place."""
    first, runs = {}, []
    for d, t in enumerate(docs):
        units = [(i, tuple(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()]
        for a in range(len(units)):
            n = 0
            for b in range(a, len(units)):
                n += len(units[b][1])
                if n >= least:
                    key = tuple(u for _, u in units[a : b + 1])
                    runs.append((d, a, key, units[a][0], units[b][0]))
                    first[key] = min(first.get(key, (d, a)), (d, a))
    gone = collections.defaultdict(set)
    for d, a, key, x, y in runs:
        if first[key] != (d, a):
            gone[d] |= set(range(x, y + 1))
    out = {}
    for d, t in enumerate(docs):
        kept, before = [], False
        for i, line in enumerate((t or "").split("\n")):
            if line.split():
                before = i in gone[d]
            if not before:
                kept.append(line)
        out[d] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("least", [6, 50])
def test_line_dedup_against_all_runs(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 8, 30, 60]))) for _ in range(25)]
    docs = []
    for i in range(100):
        lines = [rng.choice([*pool, "", " "]) if rng.random() < 0.8 else f"u{i} {rng.random()}" for _ in range(rng.randrange(12))]
        if docs and rng.random() < 0.4:
            given = (rng.choice(docs) or "").split("\n")
            a = rng.randrange(len(given))
            lines[rng.randrange(len(lines) + 1) : 0] = given[a : a + rng.randrange(1, 6)]
        docs.append("\n".join(lines) if rng.random() > 0.03 else None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, min_words=least).collect()} == brute_lines(docs, least)


def test_line_dedup_edges(odd, empty):
    made = line_dedup.dedup_lines(odd)
    assert made.count() == odd.count() and made.columns == [*odd.columns, "n_lines", "n_removed"]
    assert made.where("doc_id = 5 and n_removed > 0").count() == 0  # rows with one id and text are one
    assert line_dedup.dedup_lines(empty).count() == 0


# -- 5: HTML ----------------------------------------------------------------------------------------------------------


def test_html_lines():
    page = "<html><head><title>t</title></head><body><header>top</header><nav><ul><li>m</ul></nav><div class='cookie-notice'>hi</div><main><h1>Head</h1><p>A &lt;b&gt; <b>x</b>y&nbsp; z<ul><li>1<li>2</ul><aside>no</aside><div id=comments>c<p>d</div><p>E<table><tr><td>q<td>r</table></main><form>f</form><p>z<script>if(a<b)</script>tail<!-- x -->"
    lines, kinds = html_text.lines_of(page)
    assert html_text.main_lines(lines, kinds, None) == ["Head", "A <b> xy z", "1", "2", "E", "q", "r"]
    assert html_text.lines_of(None) == ([], []) and html_text.lines_of("plain  text\n only") == (["plain text only"], [html_text.OPEN])
    assert html_text.lines_of("<p>a<br>b</p><p>unclosed <b>bold<p>next")[0] == ["a b", "unclosed bold", "next"]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in "ab")
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
        got = html_text.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == m[-1][-1] and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_html_neighbours_against_sorting(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(3)}.x/{rng.choice('ab')}/{rng.randrange(40)}", "<p>" + "<p>".join(rng.choice(["menu", "foot", "ad1", "ad2", f"own{i}", "t"]) for _ in range(rng.randrange(8)))) for i in range(150)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    parts = lambda r: (r[1].split("/")[2], r[1].split(".x", 1)[1])
    ordered = sorted(rows, key=lambda r: (*parts(r), str(r[0]).zfill(20)))
    for i, r in enumerate(ordered):
        near = [(html_text._common_start(parts(r)[1].encode(), parts(ordered[j])[1].encode()), -k, j) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < len(ordered) and parts(ordered[j])[0] == parts(r)[0] and ordered[j][2] != r[2]]
        lines, kinds = html_text.lines_of(r[2])
        assert got[r[0]] == "\n".join(html_text.main_lines(lines, kinds, html_text.lines_of(ordered[max(near)[2]][2])[0] if near else None))


def test_html_difference_beside_an_article(spark):
    page = lambda i: f"<div>site</div><div>lead {i}</div><article><p>text {i}<p>site</article><div>foot</div>"
    same_frame = lambda i: f"<div>site</div><article><p>text {i}</article>"
    rows = [*((i, f"http://a/{i}", page(i)) for i in (1, 2)), (3, "http://b/1", page(3)), *((i, f"http://c/{i}", same_frame(i)) for i in (4, 5))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "lead 1\ntext 1\nsite", 2: "lead 2\ntext 2\nsite", 3: "text 3\nsite", 4: "text 4", 5: "text 5"}


@pytest.mark.parametrize("copies", [3, 300])
def test_html_copies_in_a_row(spark, copies):
    page = lambda own: f"<div>site</div><div>{own}</div><div>foot</div>"
    urls = [("a", "http://a/1"), *(("copied", f"http://a/2?id={i}") for i in range(copies)), ("b", "http://a/3"), *(("alone", f"http://b/{i}") for i in range(copies))]
    df = spark.createDataFrame([(i, url, page(own)) for i, (own, url) in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}  # copies fill ranges of their own
    assert got == {i: "site\nalone\nfoot" if own == "alone" else own for i, (own, _) in enumerate(urls)}


def test_html_edges(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "x://h/p", ""), (3, "http://h/p", "<article>" + "<p>word" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("key_", F.lit(1))
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in html_text.extract(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 5 * 20_000 - 1)]  # copies delete nothing of each other
    assert html_text.extract(df.limit(0)).count() == 0


# -- 6: decontamination -----------------------------------------------------------------------------------------------


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and"] * 10 + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.randrange(5, 45))}. {say(rng.randrange(1, 20))}.") for i in range(60)] + [(90, None), (91, ""), (92, "just one"), (93, "just one")]
    docs = [None, "", say(500)]
    for i in range(120):
        words = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edited"
        docs.append(f"{say(rng.randrange(300))} {' '.join(words)} {say(rng.randrange(300))}")
    docs.append("It is just one, they say.")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    half = max(decontaminate.PASSAGE // 2, max(len(decontaminate.terms_of(t)) for _, t in items))
    want = set()
    for i, t in enumerate(docs):
        w = decontaminate.terms_of(t)
        for at in range(0, max(1, len(w) - half), half):
            here = w[at : at + 2 * half]
            for item, text in items:
                if text and here and all(decontaminate.share(decontaminate.shingles(p), decontaminate.shingles_in(here), here) >= 0.8 for p in decontaminate.question_and_answer(text)):
                    want.add((i, item))
    assert got == want and len(want) > 40
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()}
    assert clean == set(range(len(docs))) - {i for i, _ in want}
    parted = decontaminate.MOST_BYTES
    try:
        decontaminate.MOST_BYTES = 3000  # several passes find the same
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == want
    finally:
        decontaminate.MOST_BYTES = parted


def test_decontamination_of_a_long_text_and_many_blocks(monkeypatch):
    """Items in a text of many stretches, against an index whose blocks are all asked; common words make long posting lists."""
    rng = random.Random(66)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "in", *(f"w{rng.randrange(900)}" for _ in range(4))]) for _ in range(n))
    items = [(i, f"{say(20)}. {say(9)}.") for i in range(400)]
    words = [decontaminate.terms_of(t) for _, t in items]
    frequency = collections.Counter(w for ws in words for w in set(ws))
    text = " ".join(f"{say(rng.randrange(3000))} {items[i][1]}" for i in (7, 399, 42, 7, 0))
    monkeypatch.setattr(decontaminate, "AT_ONCE", 500)  # the least stretch: 16 passages
    index = decontaminate.Index(items, frequency, len(items), sum(map(len, words)) / len(words))
    assert index.blocks == 25 and index.long_max.shape[0] >= 4 and (index.list_size > 0).all()
    assert set(index.matches(text)) >= {0, 7, 42, 399} and index.matches("the of and in") == {} and index.matches("unknown " * 500) == {}
    index.alive = lambda ids: np.array([(p, b) for p in range(max(1, (len(ids) - 1) // index.half)) for b in range(index.blocks)])
    everything = index.matches(text)
    del index.alive
    assert everything == index.matches(text)


def test_decontamination_edges(spark, odd, empty):
    b = spark.createDataFrame([(1, "an item about nothing. And so on.")], "item_id long, text string")
    assert decontaminate.contaminated(odd, b).count() == 0 and decontaminate.contaminated(empty, b).count() == 0
    assert decontaminate.drop_contaminated(odd, b.limit(0)).count() == odd.count()


# -- 7: quality classifier --------------------------------------------------------------------------------------------


def test_quality_votes_against_numpy():
    rng = np.random.default_rng(1)
    shares, labels = np.abs(rng.normal(size=(200, quality_knn.TERMS))).astype(np.float32), rng.integers(0, 2, 200)
    model = quality_knn.Neighbours.fit(shares, labels)
    x = np.abs(rng.normal(size=(20, quality_knn.TERMS))).astype(np.float32)
    a, b = model.project(x).astype(float), model.vectors.astype(float)
    for i, got in enumerate(model.score(x)):
        cosines = b @ a[i]
        near = np.argsort(-cosines)[: quality_knn.NEIGHBOURS]
        w = np.maximum(cosines[near], 0) ** quality_knn.SHARPNESS
        assert got == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)


def test_quality_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = q.QUERIES["op7_quality_knn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_held_out_by_language(spark):
    sf = SF.replace("0.001", "0.1")
    rows = q.QUERIES["op7_quality_knn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for lang in {r["lang"] for r in rows}:
        own = [r["predicted"] == r["quality"] for r in rows if r["lang"] == lang]
        assert sum(own) >= 0.95 * len(own), lang


def test_quality_terms_tell_scripts_apart():
    pair = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    science, again, spam = (quality_knn.term_shares(t)[:-2] for t in ("Учёные измерили скорость света в вакууме и в воде", "Учёные измерили скорость звука в воде и в воздухе", "КУПИ СЕЙЧАС!!! Дёшево, бонус, выигрыш, скидка 90%"))
    assert pair(science, again) > 0.5 > pair(science, spam)
    assert quality_knn.pair_terms("a😀b").sum() == 2 and quality_knn.term_shares("\ud800x").any()


def test_quality_fit_takes_one_text_of_an_id(spark):
    texts = spark.createDataFrame([(1, "good words here")] * 50 + [(2, "$$ ## $$")] * 3 + [(3, "never asked")], "doc_id long, text string")
    model = quality_knn.fit(texts, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int"))
    assert len(model.vectors) == 2 and model.prior == 0.5
    assert len(quality_knn.fit(texts, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"), most=2).vectors) == 2


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (99, 1), (4, None)], "doc_id long, quality int")
    model = quality_knn.fit(odd, labels)
    made = quality_knn.score(odd, model)
    assert made.count() == odd.count() and all(0 <= r["score"] <= 1 for r in made.collect())
    assert quality_knn.score(empty, model).count() == 0
    assert {r["score"] for r in quality_knn.score(odd, quality_knn.fit(odd, labels.limit(0))).collect()} == {0.5}


# -- 8: suffixes ------------------------------------------------------------------------------------------------------


def brute_suffixes(docs, length):
    raw = [(d or "").encode() for d in docs]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = {}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[k] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length,seed", [(200, 1), (200, 2), (64, 3), (9, 4)])
def test_suffixes_against_all_strings(spark, length, seed):
    chunk = 300 if seed == 2 else suffixes.CHUNK  # texts in many stretches
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    docs = [base, base, base[100:1500] + "zzz" + base[1400:2000], "ab" * 400, "ab" * 150 + "x" * 199 + base[5:205], None, "", "q" * 199, "q" * 201, "Nd, " * 70 + base[700:899] + "W" + base[2000:2200], base[:120] + "K" + base[121:700]]
    for _ in range(40):
        s, n = rng.randrange(2500), rng.randrange(100, 500)
        docs.append("".join(rng.choice("xyzw") for _ in range(rng.randrange(50))) + base[s : s + n] + "".join(rng.choice("xyzw") for _ in range(30)) + rng.choice(["", "ba" * 130, "a" * 250]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    rows = suffixes.remove_repeats(df, length=length, chunk=chunk).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_suffixes(docs, length)


def test_suffixes_edges(spark, odd, empty):
    rows = suffixes.remove_repeats(odd).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(rows) == odd.count() and all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] == 5)
    assert suffixes.remove_repeats(empty).count() == 0
    named = spark.createDataFrame([("a", "x" * 250), ("b", "y" * 100)], "name string, body string")
    assert {r["name"]: r["n_removed"] for r in suffixes.remove_repeats(named, "name", "body").collect()} == {"a": 250, "b": 0}


# -- 9: BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_against_the_library(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.PrefixEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(9)
    alphabets = ["ab \n\t'", "the in'st re\x1c\x85  é中😀", "<|endoftext|> a", "0123 .,!?$%"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", "a" * 500, "\n" * 9 + "x", "=" * 99] + ["".join(chr(c) for c in range(s, s + 64) if not 0xD800 <= c < 0xE000) for s in range(0, 0x20000, 640)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        packed = ours.encode_packed(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
        assert ours.decode_packed(packed) == theirs.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_decode(odd, path).collect()
    assert len(rows) == odd.count() and sorted(r["decoded"] for r in rows) == sorted(r["text"] or "" for r in odd.select("text").collect())
    assert bpe.encode_decode(empty, path).count() == 0


def test_suffix_automaton_against_all_suffixes():
    from sparkset.llm.suffix_automaton import SuffixAutomaton

    rng = random.Random(10)
    for _ in range(60):
        strings = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25))}
        made = SuffixAutomaton((s, i) for i, s in enumerate(sorted(strings)))
        parts = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = bytes(rng.choice(b"abcd") for _ in range(60))
        state = length = 0
        for end, c in enumerate(text, 1):
            while (follows := made.step.get(state << 8 | c)) is None and state >= 0:
                state = made.links[state]
                length = made.longest[state] if state >= 0 else 0
            state, length = (follows, length + 1) if follows is not None else (0, 0)
            assert length == max([0, *(n for n in range(1, end + 1) if text[end - n : end] in parts)])
            assert [n for n, _ in made.ends[state] if n <= length] == [n for n in range(end, 0, -1) if text[end - n : end] in strings]


def test_bpe_reads_a_common_prefix_once(monkeypatch):
    """Pieces of several texts: each of their prefixes is read once; few remembered pieces and small stretches give the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), bpe.PrefixEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(9)
    stems = ["".join(rng.choice(["an", "th", "wh", "é", "ou", "7", "zq"]) for _ in range(9)) for _ in range(20)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["ing", "q", "ö", "'s", "<|endoftext|>", "\n\n ", "x" * 80]) for _ in range(40)) for _ in range(30)] + ["", " "]
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]

    class Counted(dict):
        n = 0

        def get(self, *args):
            Counted.n += 1
            return super().get(*args)

    def reads(encode):
        ours.packed, ours.old_packed, Counted.n = {}, {}, 0
        assert encode() == want
        return Counted.n

    ours.automaton.step = Counted(ours.automaton.step)
    alone = reads(lambda: [x for t in texts for x in [ours.encode_packed(t)]])
    together = reads(lambda: list(ours.encode_all(texts)))
    assert together < 0.75 * alone, (together, alone)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 900)
    reads(lambda: list(ours.encode_all(texts)))
    assert len(ours.packed) <= 50


def test_bpe_of_a_vocabulary_with_a_token_that_merges_never_make():
    """ab + c comes before a + b, so abc is never reached by way of b + c; and a token without a merge is no token of any text."""
    import json

    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "bc", "abc", "ab", "cc"])}
    merges = [["b", "c"], ["a", "b"], ["ab", "c"]]
    theirs = Tokenizer(models.BPE(vocab=vocabulary, merges=[tuple(m) for m in merges]))
    theirs.pre_tokenizer, theirs.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    ours = bpe.PrefixEncoder(json.dumps({"model": {"type": "BPE", "vocab": vocabulary, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}))
    assert b"abc" not in ours.whole and b"cc" not in ours.whole and ours.whole[b"bc"] == 3
    for text in ("abc", "ab", "abcabc", "cc", "aabbcc", "bcbc", "cab"):
        packed = ours.encode_packed(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == theirs.encode(text).ids


# -- 10: SimHash ------------------------------------------------------------------------------------------------------


def test_fingerprint():
    import xxhash

    text = "The Quick\tbrown É fox  jumps over"
    words = ["the", "quick", "brown", "É", "fox", "jumps", "over"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(4)]
    assert simhash.fingerprint(text) == sum((sum(h >> b & 1 for h in hashes) * 2 > 4) << b for b in range(64))
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(5)
    masks = simhash.table_masks()
    assert len(masks) == 31 and all(24 <= m.bit_count() <= 40 for m in masks)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(not m & diff for m in masks)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_midpoints_of_every_pair_in_the_radius(radius):
    flips, nearer = simhash.around(radius)
    near, all_of = {int(x) for x, n in zip(flips, nearer) if n}, {int(x) for x in flips}
    for d in range(1, radius + 1):
        apart = (1 << d) - 1
        assert any(x ^ apart in all_of for x in near)  # one of the two lies nearer
    assert all((a ^ b).bit_count() <= radius for a in list(near)[:80] for b in list(all_of)[-80:])


@pytest.mark.parametrize("bucket,radius", [(2048, 4), (8, 4), (8, 3)])
def test_links_against_all_pairs(spark, bucket, radius):
    rng = random.Random(bucket)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(40):
            values.add(x)
            y = x
            for _ in range(rng.randrange(1, 8)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
            x = rng.choice([x, y])
    values = sorted(values)
    root = {simhash._signed(v): simhash._signed(v) for v in values}
    df = spark.createDataFrame([(v,) for v in root], "fp long")
    root.update({r["node"]: r["root"] for r in connected_components(simhash.linked(df, radius, bucket)).collect()})
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    ours, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for i, v in enumerate(values):
        theirs[find(i)].add(v)
        ours[root[simhash._signed(v)]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_one_large_group_of_near_copies(spark):
    """A group in one ball and a chain that leaves it, beyond the bucket: rows named at midpoints are in proportion, whatever the buckets."""
    rng = random.Random(12)
    base = rng.getrandbits(64)
    ball = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(300)}
    chain = [base ^ (1 << 4 * k) - 1 for k in range(1, 12)]
    alone = [rng.getrandbits(64) for _ in range(50)]
    values = sorted({*ball, *chain, *alone})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    root = {r["node"]: r["root"] for r in connected_components(simhash.linked(df, bucket=16)).collect()}
    least = min(map(simhash._signed, {*ball, *chain}))
    assert {root.get(simhash._signed(v), simhash._signed(v)) for v in {*ball, *chain}} == {least}
    assert all(simhash._signed(v) not in root for v in alone)
    assert len(simhash.around(4)[0]) == 2081


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(5, 1), (1, 5), (5, 5)], [(i + 1, i) for i in range(40)], [(0, i) for i in range(1, 300)] + [(300, i) for i in range(250, 320)], [(None, 1), (2, None), (7, 3)]])
def test_components_against_union(spark, pairs):
    want = {}
    for a, b in pairs * 50:
        if a is not None and b is not None:
            low = min(want.get(a, a), want.get(b, b))
            want[a] = want[b] = low
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_kept_tables_go(spark):
    kept = keep(spark.range(5))
    path = kept.inputFiles()[0]
    assert kept.count() == 5 and shared_folder(spark).split("//")[-1] in path
    release(kept)
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()


def test_verified_groups_against_all_pairs(spark):
    """Of texts with edits, the first of each group that pairs of fingerprints and then exact shingles join stays."""
    rng = random.Random(88)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 3 + ["", None, "  "]
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4)) if w}
    sets, prints = [cut(t) for t in texts], [simhash.fingerprint(t, 2) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert all(simhash.similarity(simhash.shingle_set(texts[i]), simhash.shingle_set(texts[j])) == share(sets[i], sets[j]) for i in range(0, len(texts), 3) for j in range(len(texts)))
    pair = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 6 and share(sets[i], sets[j]) >= 0.8
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and pair(i, j):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in simhash.keep_first(df).orderBy("doc_id").collect()]
    assert set(kept) >= set(group) and len(set(kept) - set(group)) <= 1  # a text may hang on one that a tree does not ask
    assert len(set(group)) <= len(texts) - 15


def test_no_pair_that_is_alike_goes_unlinked(spark):
    """Edited texts of few and many words, against all pairs: whatever their fingerprints, and within a radius."""
    rng = random.Random(5)
    texts = ["", " ", None]
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 30, 70, 200]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(copy + [f"t{rng.randrange(9)}"] * rng.randrange(2)))
    sets, prints = [simhash.shingle_set(t) for t in texts], [simhash.fingerprint(t, 2) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if simhash.similarity(sets[i], sets[j]) >= 0.8}
    near = {(i, j) for i, j in alike if (prints[i] ^ prints[j]).bit_count() <= 6}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(alike - near) > 5
    for pairs, radius in ((alike, None), (near, 6)):
        group = list(range(len(texts)))
        for i, j in sorted(pairs):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
        assert sorted(r["doc_id"] for r in simhash.keep_first(df, radius=radius).collect()) == sorted(set(group))
    with pytest.raises(ValueError):
        simhash.keep_first(df, radius=3)


def test_prefixes_and_their_buckets():
    half = np.arange(1, 21, dtype=np.uint64)
    a = half << 32
    assert (simhash.prefix(a, (np.empty(0, np.uint64), np.empty(0, np.int64))) >> 32).tolist() == [1, 2, 3, 4, 5]
    assert (simhash.prefix(a, (half[:3], np.array([2, 1, 3]))) >> 32).tolist() == [4, 5, 6, 7, 8]
    name, root, fp = np.array([7, 5, 9, 8]), np.array([5, 5, 9, 8]), np.array([0, 0, 127, 1])
    n, place = np.array([20, 20, 20, 10]), np.array([0, 0, 1, 0])
    assert sorted(simhash.bucket_pairs(name, root, fp, n, place)) == [(5, 9), (7, 9)]
    assert len(simhash.bucket_pairs(name, root, fp, n, place, most=1)) == 1 and simhash.bucket_pairs(name, root, fp, n, place, radius=6) == []


def test_sets_move_only_for_pairs_that_may_be_alike(spark, monkeypatch):
    """Texts with one passage in common are told apart by parities; the halves of hashes are counted without a row for each."""
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, len(a) // 3 + 1) :], rng.integers(0, 2**63, rng.integers(0, len(a) // 4 + 1)).astype(np.uint64)]))
        assert simhash.similarity(a, b) < 0.8 or simhash.may_be_alike(len(a), simhash.parities(a), len(b), simhash.parities(b))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"w{rng.integers(10**6)}" for _ in range(240)) for _ in range(40)]
    texts += [texts[0] + " end"]
    sets = simhash._sets(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "name long, first long, text string"))
    links = spark.createDataFrame([(i, j) for j in range(41) for i in range(j)], "a long, b long")
    kept, keep = [], simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(simhash, "release", lambda table: None)
    assert [tuple(r) for r in simhash._verified(links, sets).collect()] == [(0, 40)]
    assert max(t.count() for t in kept if "shingles" in t.columns) < 10  # of 41 sets
    halves, places = simhash._common(sets)
    count = {}
    for t in texts:
        for h in simhash.shingle_set(t).tolist():
            count[h >> 32] = count.get(h >> 32, 0) + 1
    common = sorted((-n, h) for h, n in count.items() if n >= simhash.COMMON)
    assert [h for _, h in sorted(zip((-places).tolist(), halves.tolist()))] == [h for _, h in common] and len(common) >= 50


def test_simhash_edges(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns and simhash.keep_first(odd).where("doc_id = 5").count() == 1


def test_first_of_a_repeated_id(spark):
    rows = [(5, "alpha beta gamma delta epsilon"), (5, "one two three four five six"), (3, "one two three four five six"), (5, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"), (None, "alone")]
    for order in (rows, rows[1:] + rows[:1]):
        got = simhash.keep_first(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
        assert sorted(((r["doc_id"] or 0), r["text"]) for r in got.collect()) == [(0, "alone"), (3, rows[1][1]), (5, rows[0][1])]
