"""Language, near copies, leaks, spans and pages beside brute force, with nulls, ties, repeats and odd columns."""

import re

import pytest
from pyspark.sql import functions as F

from tallyward.llm import html_blocks, lang_mixture, leak_index, minhash_forest, repeated_lines, substring_dedup
from tallyward.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Clashing names: operators use some of these inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars int, rep string, size string, owner string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], EXTRA)


def sentence(seed, n):
    words, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        words.append("abcdefghijklmnopqrst"[state % 20] + "aeiou"[state // 20 % 5] + "klmnprst"[state // 100 % 8])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    base = [sentence(k, 120) for k in range(12)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(base)]
    rows += [(20 + k, base[0], "en", "s", 0) for k in range(5)]  # exact copies
    for k in range(6):  # near copies of one text, and of each other
        w = base[1].split()
        w[10 * k + 3] = "changed"
        rows.append((40 + k, " ".join(w), "en", "s", 0))
    long_text = "\n".join(sentence(100 + k, 30) for k in range(300))
    rows += [(60, long_text, "en", "s", 0), (61, long_text.upper(), "en", "s", 0)]
    rows += [(70, None, None, None, None), (71, "", "en", "s", 0), (72, "one", "en", "s", 0), (73, "One", "en", "s", 0)]
    rows += [(74, " \n\t ", "en", "s", 0), (75, "é " * 60, "en", "s", 0), (75, "é " * 60, "en", "s", 0)]
    rows += [(None, base[2], "en", "s", 0)]
    return documents(spark, rows), rows


def test_components_follow_long_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 200), (None, 1)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, size):
    docs, rows = corpus
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(shingles(r[1], size))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            linked = any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
            if a < b and linked:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    settings = minhash_forest.ForestSettings(words=size, part=4)
    got = minhash_forest.near_duplicates(docs, settings).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
        if r["doc_id"] is None:
            assert r["kept"]
        else:
            assert r["component_id"] == find(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_find_every_leaf_of_a_star(spark):
    """Leaves are near copies of one text but not of each other; the centre is not the smallest id."""
    base = sentence(7, 240).split()
    rows = [(500, " ".join(base), "en", "s", 0)]
    for k in range(300):
        w = list(base)
        for j in range(4):  # up to 20 of 236 shingles
            w[(k * 7 + j * 61 + (k // 30) * j * 5) % 240] = f"leaf{k}x{j}"
        rows.append((k + (k >= 150) * 1000, " ".join(w), "en", "s", 0))
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    want = {i for i, x in sets.items() if 100 * len(x & sets[500]) >= 80 * len(x | sets[500])}
    assert len(want) == 301
    assert sum(100 * len(sets[0] & x) >= 80 * len(sets[0] | x) for x in sets.values()) < 20
    settings = minhash_forest.ForestSettings(words=5, part=64, neighbours=1)
    got = minhash_forest.near_duplicates(documents(spark, rows), settings).collect()
    assert {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b, c = (sentence(k, 60) for k in (1, 2, 3))
    rows = [(3, a), (7, a), (7, b), (9, b), (9, ""), (11, c), (11, None), (12, "")]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = minhash_forest.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted(
        [(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 12, True)]
    )


def test_prefixes_of_similar_sets_meet(spark):
    """Families around the limit, whose members share regions: all pairs by brute force, whatever the table of levels."""
    rows = []
    for family in range(4):
        base = sentence(900 + family, 90).split()
        for k in range(20):
            w = list(base)
            for j in range(1 + k % 6):
                w[(k * 13 + j * 17) % 90] = f"own{k}x{j}"
            rows.append((family * 100 + k, " ".join(w[: 90 - k % 3])))
    sets = {i: shingles(t, 5) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for bits in (1, 18):
        settings = minhash_forest.ForestSettings(part=8, rarity_bits=bits)
        texts = minhash_forest.compressed(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]))
        heads = minhash_forest.prefixes(texts, settings)
        place = spark.createDataFrame([], "id long, component long")
        met = minhash_forest.rest_pairs(heads, place, settings)
        found = {(r["a"], r["b"]) for r in met.collect()}
        assert want <= found and all(a // 100 == b // 100 for a, b in found)
        assert {(r["a"], r["b"]) for r in minhash_forest.confirmed(met, texts, settings).collect()} == want


def test_near_duplicates_of_nothing(spark):
    assert minhash_forest.near_duplicates(documents(spark, [])).count() == 0


def test_language_mixture(spark):
    en, fr = "the thing that they then other with this ", "les que nous vous dans leur pour une est "
    rows = [(k, (en if k % 2 else fr) * 5, "en" if k % 2 else "fr", "s", 0) for k in range(20)]
    rows += [(30, en * 6 + fr * 3, None, "s", 0), (31, "12 34 !!", "en", "s", 0), (32, None, "en", "s", 0)]
    rows += [(33, "", None, None, None), (34, en * 4000, None, None, 0), (34, en * 4000, None, None, 0)]
    docs = documents(spark, rows)
    model = lang_mixture.fit(docs, F.col("doc_id") < 20)
    got = {r["doc_id"]: r for r in lang_mixture.detect(docs, model).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "fr") for k in range(20))
    assert got[30]["lang_pred"] == "en" and [x["lang"] for x in got[30]["languages"]] == ["en", "fr"]
    assert got[30]["languages"][1]["share"] == pytest.approx(1 / 3, abs=0.08)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (31, 32, 33))
    assert got[34]["lang_pred"] == "en" and got[34]["score"] == 1
    kept = lang_mixture.keep_determined(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(20), 30, 34}
    nothing = lang_mixture.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in lang_mixture.detect(docs, nothing).collect()} == {"und"}
    assert lang_mixture.detect(documents(spark, []), model).count() == 0


def test_language_of_one_letter(spark):
    rows = [(k, "A." if k % 2 else "les que nous", "en" if k % 2 else "fr", "s", 0) for k in range(8)] + [(9, "A.", None, None, 0), (10, "1.", None, None, 0)]
    docs = documents(spark, rows)
    model = lang_mixture.fit(docs, F.col("doc_id") < 8)
    got = {r["doc_id"]: r["lang_pred"] for r in lang_mixture.detect(docs, model).collect()}
    assert got[9] == "en" and got[10] == "und"
    assert 9 in {r["doc_id"] for r in lang_mixture.keep_determined(docs, model).collect()}


def test_bound_of_the_mixture_never_skips_a_better_one():
    import numpy as np

    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(60, 0.3), size=3).T + 1e-6
    model = lang_mixture.MixtureModel(("a", "b", "c"), np.log(p / p.sum(axis=0)), lang_mixture.MixtureSettings())
    for _ in range(60):
        weights = rng.dirichlet(np.full(3, 0.4))
        grams = rng.choice(60, size=80, p=(p / p.sum(axis=0)) @ weights)
        fast = lang_mixture.mixtures(grams, np.array([0, 80]), model)[0]
        assert np.allclose(fast, lang_mixture.proportions(model.log_probability[grams], model.settings))


def test_leaks_equal_a_full_scan_of_scores(spark, corpus):
    docs, rows = corpus
    items = [(k, sentence(500 + k, 15 + 3 * k)) for k in range(12)] + [(50, None), (51, ""), (52, "What is it? forty two")]
    items += [(0, items[0][1])]  # a repeated item
    planted = [(300 + k, f"{sentence(900 + k, 70)} {items[k][1].upper()}, {sentence(950 + k, 90)}", None, None, 0) for k in range(12)]
    planted += [(320, sentence(1, 40) + " what is it forty two", None, None, 0)]
    half = items[9][1].split()
    planted += [(330, sentence(2, 50) + " " + " ".join(half[: len(half) // 3]), None, None, 0)]  # too little of it
    table = documents(spark, rows + planted)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = {(300 + k, k) for k in range(12)} | {(320, 52)}
    for settings in (leak_index.LeakSettings(), leak_index.LeakSettings(block=2, shard_words=40)):
        got = leak_index.leaks(table, benchmark, settings).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        assert all(0.4 <= r["score"] <= 1 for r in got)
        left = leak_index.without_leaks(table, benchmark, settings)
        assert left.columns == table.columns and left.count() == len(rows) + 1
    assert leak_index.leaks(table, benchmark.limit(0)).count() == 0
    assert leak_index.leaks(documents(spark, []), benchmark).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    rows = [
        (3, "Keep this first line here.\nAnd a second one. It has two whole sentences inside. Yes.\nok\n"),
        (5, "KEEP this, first line here!\nSomething else entirely new now.\nok\nok\n"),
        (6, "Other words at first. It has two whole sentences inside. And é more of them"),
        (6, "Other words at first. It has two whole sentences inside. And é more of them"),
        (9, "twice the very same line\ntwice the very same line\n"),
        (10, None),
        (11, ""),
        (None, "keep this first line here"),
    ]
    got = repeated_lines.deduplicate(documents(spark, [(*r, None, None, 0) for r in rows])).collect()
    text = {(r["doc_id"], i): r["text"] for i, r in enumerate(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    by_id = {}
    for (i, _), t in text.items():
        by_id.setdefault(i, []).append(t)
    assert by_id[3] == [rows[0][1]]
    assert by_id[5] == ["Something else entirely new now.\nok\nok\n"]
    assert by_id[6] == ["Other words at first. And é more of them"] * 2
    assert by_id[9] == ["twice the very same line\n"]
    assert by_id[10] == [None] and by_id[11] == [""] and by_id[None] == [""]
    for r in got:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])
    assert repeated_lines.deduplicate(documents(spark, [])).count() == 0


def brute_spans(rows, window):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0] if rows[k][0] is not None else 2**63 - 1)
    first, out = {}, {}
    for k in order:
        data, rank = (rows[k][1] or "").encode(), rows[k][0] if rows[k][0] is not None else 2**63 - 1
        gone = bytearray(len(data))
        for j in range(len(data) - window + 1):
            if first.setdefault(data[j : j + window], rank) < rank:
                gone[j : j + window] = b"\x01" * window
        out.setdefault(rows[k][0], []).append(bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def test_substring_removal_equals_brute_force(spark, corpus):
    _, rows = corpus
    shared = sentence(77, 30)
    rows = rows + [(400 + k, f"{sentence(600 + k, 9)} {shared} {sentence(700 + k, 9)}", None, None, 0) for k in range(30)]
    rows += [(450, "ab" * 200, None, None, 0), (451, "ba" * 150, None, None, 0), (452, "a" * 49, None, None, 0)]
    rows += [(453, "x" * 500, None, None, 0), (454, "y" + "x" * 60, None, None, 0)]
    want = brute_spans(rows, 50)
    small = substring_dedup.SubstringSettings(bucket_bytes=4_000, refined=50, flush=500)
    got = substring_dedup.deduplicate(documents(spark, rows), small).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r["kept"]) in want[r["doc_id"]], r["doc_id"]
        assert r["n_bytes"] == len(r["kept"]) + sum(s["end"] - s["start"] for s in r["removed"])
    assert substring_dedup.deduplicate(documents(spark, [])).count() == 0


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    from tallyward.llm import byte_runs

    text = sentence(5, 400).encode()
    whole = byte_runs.runs_of([text], 50, 20)
    monkeypatch.setattr(byte_runs, "SEGMENT", 256)
    pieces = byte_runs.runs_of([text], 50, 20)

    def starts(r):
        return sorted(s + k for s, n in zip(r.start.tolist(), r.windows.tolist(), strict=True) for k in range(n))

    assert starts(whole) == list(range(len(text) - 49)) == sorted(set(starts(pieces)))


PAGE = """<html><head><title>no</title><script>var t="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=/a>no</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><header><h1>A&amp;B &copy;</h1></header><p>One <b>two</b>
 three<br>four<p>Five</p><aside>side</aside><form><p>fill</p></form><!-- <p>no</p> --><p>x &lt; y &unknown; z</p>
<section id="comments"><p>a reader writes this</p></section></article><footer>no</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p" * 3000, "x"), (4, "u", "<p" * 3000, "x")]
    rows += [(None, "u", "<article><p>" + "word " * 50000 + "</article>", "x"), (6, "u", "<article>&nbsp;</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(pages).collect()}
    assert got[1] == "A&B ©\nOne two three four\nFive\nx < y &unknown; z"
    assert got[2] == got[3] == got[4] == got[6] == "" and got[None] == ("word " * 50000).strip()
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_pages_outside_an_article_go_by_words_and_links():
    main = "This paragraph has a good number of words about one thing, as articles do. " * 3
    html = f"<body><p>{main}</p><p>{main}</p><ul><li><a href=a>One</a><li><a href=b>Two more</a></ul></body>"
    assert html_blocks.main_text(html) == f"{main.strip()}\n{main.strip()}"


def test_the_language_stage_infers_the_language(spark):
    from corpus_pipeline import language

    rows = [(i, "the cat sat on the mat with the hat", "en") for i in range(9)]
    rows += [(i, "der Hund schläft unter dem Tisch und träumt", "de") for i in range(9, 18)]
    rows += [(18, "der Tisch und der Hund", None), (19, "the mat and the cat", None), (20, "123 456", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang"] for r in language(spark, docs, "").collect()}
    assert (found[18], found[19]) == ("de", "en") and 20 not in found
    assert [found[i] for i in range(18)] == ["en"] * 9 + ["de"] * 9
