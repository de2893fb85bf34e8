"""The fitted operators: held-out accuracy, normalisation, exact digests, recall; and the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.llm import html_extraction as html
from canopia.llm.embedding_dedup import embedding_groups
from canopia.llm.labelled_pages import labelled_pages
from canopia.llm.language_model import score_texts
from canopia.llm.packing import CAPACITY, best_fit, pack, plan, reduce
from canopia.llm.pitman_yor import GROUPS, STRENGTH, UNKNOWN, Parent, Part, Scorer, Totals, arrangements, binomial, contexts, seat, unknown
from canopia.llm.quality import keep_good, score_quality
from canopia.llm.tokenizing import Encoder


def held(i, n, k=2):
    return i is not None and zlib.crc32(str(i).encode()) % n == k


# Extraction


def test_field_finds_main_blocks_of_unseen_pages():
    field = html.trained()
    right = total = 0
    for page in labelled_pages(200, 1234):
        blocks = html.leaf_blocks(page)
        got = field.main_blocks(blocks)
        right += sum(g == b.main for g, b in zip(got, blocks, strict=True))
        total += len(blocks)
    assert right / total > 0.98


def test_blocks_of_untidy_pages():
    page = "<!-- c --><title>t</title><div><p>One &eacute;&amp;\n  two<br>three<p>four <b>five</b>six<script>var x='</p>'</script><ul><li>a<li>b</ul></div>tail <"
    assert [b.text for b in html.leaf_blocks(page)][:5][:4] == ["One é& two three", "four fivesix", "a", "b"]
    assert html.leaf_blocks(None) == [] and html.leaf_blocks(" \n ") == []


def test_no_page_is_refused():
    """Declarations, cut tags and stray signs of any kind; and text after an unclosed hidden element stays."""
    for page in ("<![foo bar]><p>x</p>", "<![CDATA[a]]><p>x</p>", "<!x><!-><!--><p>x</p>", "<!DOCTYPE html [<!ELEMENT a>]><p>x</p>", "<?php <p>x</p>", "<svg><path><p>x</p>", "<canvas><p>x</p>", "<svg><svg></svg></svg><p>x</p>",
                 "<noscript><svg></noscript><p>x</p>", "<p x='<p>x</p>", "</p></div><p>x</p></svg>"):
        blocks = [b.text for b in html.leaf_blocks(page)]
        assert "x" in blocks or page.startswith(("<p x=", "<?")), page
    assert [b.text for b in html.leaf_blocks("<svg><title>t</title></svg><object><p>no</p></object><p>yes")] == ["yes"]
    r = random.Random(8)
    bits = ["<p>", "</p>", "<div class='a b'>", "</div>", "<!", "<![", "]>", "<svg>", "</svg>", "<script>", "</script>", "&amp", "&#x;", "word ", "<a href=x>", "<td", "'", '"', ">", "<!--", "-->", "<br/>", "<h1>", "\x00", "é"]
    field = html.trained()
    for _ in range(300):
        html.main_text(field, "".join(r.choice(bits) for _ in range(r.randint(1, 60))))


def test_deep_pages_take_linear_time():
    import time

    field, took = html.trained(), []
    for n in (20_000, 80_000):
        page = "".join(f'<div class="c{i % 50}">x y z ' for i in range(n))
        began = time.time()
        assert html.main_text(field, page) is not None
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1 and took[1] < 20


def test_pages_written_by_hand():
    """Layouts that no generator made: what a reader would call the text."""
    field = html.trained()
    say = "The council voted on Tuesday to repair the old bridge before winter, after years of delay and several failed bids."
    more = "Work starts in March and should be done by autumn, the mayor said, if the river stays low enough for the crews."
    pages = [
        (f"<body><article><h1>Bridge to be repaired</h1><p>{say}</p><p>{more}</p></article><section class='comments'><p>First!</p><p>I never liked that bridge anyway.</p></section></body>", f"Bridge to be repaired\n\n{say}\n\n{more}"),
        (f"<body><header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header><main><h1>Bridge</h1><p>{say}<p>{more}</main><footer>&copy; 2020 The Paper. All rights reserved.</footer>", f"Bridge\n\n{say}\n\n{more}"),
        (f"<body><div id=cookie-notice><p>We use cookies. <a href=/p>Privacy</a></p></div><div class=post-content><p>{say}</p><ul><li>{more}</li></ul></div><aside><h3>Related</h3><a href=1>Other bridges</a></aside>", f"{say}\n\n{more}"),
    ]
    for page, text in pages:
        assert html.main_text(field, page) == text


def test_extraction_of_whole_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").withColumn("text", F.lit("old"))
    got = {r.page_id: r for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(p.split()) for p in body.replace("<br>", " ").replace("<b>", "").replace("</b>", "").replace("<h1>", "<p>").replace("</h1>", "<p>").replace("</p>", "<p>").split("<p>")]
        import html as escapes

        assert got[r.page_id].text == "\n\n".join(" ".join(escapes.unescape(b).split()) for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "<nav><a href=x>home</a></nav>"), (3, "<article><p>" + "word " * 100_000 + "</article>")], "page_id long, html string")
    texts = sorted(((r.page_id, r.n_chars) for r in html.extract_text(odd).collect()), key=str)
    assert texts == sorted([(1, 0), (1, 0), (2, 0), (None, 0), (3, 499_999)], key=str)
    assert html.extract_text(odd.limit(0)).collect() == []


# Language model


def test_seating_weights_and_draws():
    d = 0.4
    s = arrangements(d, 5)
    assert np.exp(s[3, 1]) == pytest.approx((1 - d) * (2 - d)) and np.exp(s[3, 2]) == pytest.approx(3 * (1 - d)) and np.exp(s[4, 4]) == pytest.approx(1)
    n, mass = 40_000, 1.3
    key = np.random.default_rng(1).integers(0, 1 << 63, n, np.uint64)
    parent = Parent(np.full(n, 2), np.full(n, 1), np.full(n, 9), 0.3, np.full(n, 0.05))
    p = [(2 + j - 0.3) / (STRENGTH + 9 + j) + 0.05 for j in range(4)]
    for own, each in ((0.2, [0.2] * 4), (parent, p)):
        t = seat(key, np.full(n, 4), np.full(n, mass), own, d)
        weight = np.array([np.exp(s[4, k]) * np.prod([(mass + d * j) * each[j] for j in range(k)]) for k in range(1, 5)])
        assert np.allclose(np.bincount(t, minlength=5)[1:] / n, weight / weight.sum(), atol=0.01)
    large = seat(key[:3], np.array([10_000, 1, 0]), np.full(3, mass), 0.2, d)
    assert 1 < large[0] < 2000 and large[1] == 1 and large[2] == 0


def test_binomial_draws():
    u = np.random.default_rng(2).random(60_000)
    for n, q in ((1, 0.3), (7, 0.9), (40, 0.02), (500, 0.5), (100, 1.0), (100, 0.0)):
        x = binomial(u, np.full(len(u), n), np.full(len(u), q))
        assert x.min() >= 0 and x.max() <= n and abs(x.mean() - n * q) < 0.02 * max(1, n * q) and abs(x.var() - n * q * (1 - q)) < 0.05 * max(1, n * q * (1 - q))


def small_part():
    r = np.random.default_rng(3)
    words = np.sort(r.integers(1, 1 << 60, 300).astype(np.uint64))
    pairs = sorted({(int(w), int(u)) for w, u in zip(r.integers(0, 300, 4000), r.choice([0, 1, 64, 65, 4096], 4000), strict=True)})
    n = np.bincount([p[0] for p in pairs], minlength=300)
    return Part(words[n > 0], n[n > 0], np.array([p[1] for p in pairs]), r.integers(1, 50, len(pairs)), 64)


def test_predictions_add_up_to_one():
    part = small_part()
    t = part.fewest()
    for k in range(3):
        t = part.sweep(t, Totals.of(part.totals(t), 64), k)
    assert (part.expand(part.shrink(t)) == t).all()
    totals = Totals.of(part.totals(t), 64)
    scorer = Scorer(part, [t, t], [totals, totals])
    for u in (0, 1, 64, 4096, 70, contexts(64) - 2):
        p, _ = scorer.of(part.words, np.full(len(part.words), u))
        assert p.sum() + unknown(np.array([u]), scorer.shares, 64)[0] == pytest.approx(1, abs=1e-9)
    assert 64 * GROUPS + 1 == contexts(64)


def test_sweeps_agree_with_customers_seated_one_by_one():
    """The mean number of tables against a plain sampler that takes out each customer and seats it again, on a tiny corpus."""
    counts = {(0, 0): 6, (0, 1): 3, (1, 0): 4, (1, 2): 2, (2, 1): 5, (2, 2): 1}  # (word, context); both contexts in group 0
    keys = sorted(counts)
    words = np.array([11, 22, 33], np.uint64)
    part = Part(words, np.array([2, 2, 2]), np.array([k[1] for k in keys]), np.array([counts[k] for k in keys]), 64)
    d = Totals.of(part.totals(part.fewest()), 64).discounts()
    fixed = lambda self: d
    kept = Totals.discounts
    Totals.discounts = fixed
    try:
        t, got = part.fewest(), []
        for k in range(6000):
            t = part.sweep(t, Totals.of(part.totals(t), 64), k)
            got.append(t)
    finally:
        Totals.discounts = kept
    r = random.Random(5)
    base = (1 - UNKNOWN) / 3
    tables = {("u", k): [1] * counts[k] for k in keys}  # table sizes; every customer alone at first
    sizes = lambda level, w, u=None: tables[(level, (w, u))] if level == "u" else tables[(level, w)]
    for w in range(3):
        n = sum(len(tables[("u", k)]) for k in keys if k[0] == w)
        tables[("v", w)], tables[("w", w)] = [1] * n, [1] * n

    def chance(level, w, u=None):
        if level == "base":
            return base
        mine = [x for key, x in tables.items() if key[0] == level and (level != "u" or key[1][1] == u)]
        own, k = sizes(level, w, u), {"u": 0, "v": 1, "w": 2}[level]
        c, n = sum(map(sum, mine)), sum(map(len, mine))
        return (sum(own) - d[k] * len(own) + (STRENGTH + d[k] * n) * chance({"u": "v", "v": "w", "w": "base"}[level], w)) / (STRENGTH + c)

    def add(level, w, u=None):
        if level == "base":
            return
        own, up, k = sizes(level, w, u), {"u": "v", "v": "w", "w": "base"}[level], {"u": 0, "v": 1, "w": 2}[level]
        n = sum(len(x) for key, x in tables.items() if key[0] == level and (level != "u" or key[1][1] == u))
        weights = [x - d[k] for x in own] + [(STRENGTH + d[k] * n) * chance(up, w)]
        j = r.choices(range(len(weights)), weights)[0]
        if j == len(own):
            own.append(1)
            add(up, w)
        else:
            own[j] += 1

    def take(level, w, u=None):
        if level == "base":
            return
        own = sizes(level, w, u)
        j = r.choices(range(len(own)), own)[0]
        own[j] -= 1
        if not own[j]:
            own.pop(j)
            take({"u": "v", "v": "w", "w": "base"}[level], w)

    seen = []
    for sweep in range(4000):
        for w, u in keys:
            for _ in range(counts[(w, u)]):
                take("u", w, u)
                add("u", w, u)
        if sweep >= 200:
            seen.append([len(tables[("u", k)]) for k in keys])
    assert np.allclose(np.mean([t[:6] for t in got[200:]], 0), np.mean(seen, 0), rtol=0.08)


def test_scores_do_not_depend_on_the_shuffle(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    found = []
    for parts, shuffle in ((None, "8"), (7, "3")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        found.append({r.doc_id: r.score for r in score_texts(d, parts=parts).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0].keys() == found[1].keys() and all(found[0][i] == pytest.approx(found[1][i], abs=1e-6) for i in found[0])


def test_scores_of_a_table(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", F.lit("z").alias("score"))
    extra = spark.createDataFrame([(None, "the of"), (900_001, None), (900_002, ""), (900_003, "THE of\tthe"), (900_003, "THE of\tthe")], "doc_id long, text string").withColumn("score", F.lit("z"))
    rows = d.unionByName(extra).collect()
    got = score_texts(d.unionByName(extra)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(x for r in rows if not held(r.doc_id, 7) for x in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id, 7), len(x := tokens(r.text)), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert score_texts(d.limit(0)).collect() == []
    only = spark.createDataFrame([(i, "a b") for i in range(200) if held(i, 7)][:2], "doc_id long, text string")
    assert [(r.train_tokens, r.n_known) for r in score_texts(only).collect()] == [(0, 0), (0, 0)]


# Packing


def test_plan_is_close_to_the_bound_and_exact_on_small_cases():
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.randint(1, 10) for _ in range(r.randint(1, 8))]
        bins = plan(dict(Counter(sizes)), 10)
        used = Counter()
        for n, content in bins:
            assert sum(a * b for a, b in content) <= 10
            for a, b in content:
                used[a] += n * b
        assert used == Counter(sizes)

        def fits(k, left, rooms):
            if not left:
                return True
            x, tried = left[0], set()
            for j in range(k):
                if rooms[j] >= x and rooms[j] not in tried:
                    tried.add(rooms[j])
                    rooms[j] -= x
                    if fits(k, left[1:], rooms):
                        return True
                    rooms[j] += x
            return False

        least = next(k for k in range(1, 9) if fits(k, sorted(sizes, reverse=True), [10] * k))
        assert sum(n for n, _ in bins) <= least + (1 if least > 3 else 0)
        left = np.zeros(11, np.int64)
        for s in sizes:
            left[s] += 1
        fixed = reduce(left.copy(), 10)
        done = Counter()
        for n, content in fixed:
            for a, b in content:
                done[a] += n * b
        rest = sorted((Counter(sizes) - done).elements(), reverse=True)
        after = next(k for k in range(0, 9) if fits(k, rest, [10] * k))
        assert sum(n for n, _ in fixed) + after == least  # what the reduction fixes is never worse than the optimum
    assert plan({}, 10) == [] and sorted(best_fit(np.array([0, 0, 7, *[0] * 8]), 10)) == [(1, ((2, 2),)), (1, ((2, 5),))]


def test_packing_round_trip(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("piece"))
    extra = spark.createDataFrame([(None, "x"), (900_001, None), (900_002, ""), (900_003, "a " * 20_000), (900_004, "twice"), (900_004, "twice")], "doc_id long, text string").withColumn("piece", F.lit(1))
    rows = d.unionByName(extra).collect()
    got = pack(d.unionByName(extra)).collect()
    encoder = Encoder()
    ids = {r.doc_id: np.append(encoder.ids(r.text), np.array([0], "<u4")) for r in rows}
    times = Counter(r.doc_id for r in rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length <= CAPACITY and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == times[i] * len(ids[i])
        assert all(r.length == CAPACITY for r in pieces if r.piece > 0) and max(r.piece for r in pieces) + 1 == -(-len(ids[i]) // CAPACITY)
    assert set(by_doc) == set(times)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) <= -(-sum(r.length for r in got) // CAPACITY) + 1
    assert pack(d.limit(0)).collect() == []


# Quality


def test_votes_are_a_brute_force_neighbour_search(spark):
    """Scores from the vectors themselves, one text at a time; repeated rows and equal texts score alike."""
    from canopia.llm import quality

    folder = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(d, labels)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    rows = [*rows, rows[5], (910_000, rows[5][1]), (910_001, "the of and")]
    got = score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0).unionByName(labels)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, text in rows:
        x = model.latent(quality.terms([text]))[0]
        near = sorted(((float(x @ v), int(label)) for v, label in zip(model.vectors, model.labels, strict=True)), key=lambda p: -p[0])[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.POWER for c, _ in near]
        by_text[i] = sum(w * label for w, (_, label) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-12 else model.prior
    for r in got:
        assert r.score == pytest.approx(by_text[r.doc_id], abs=1e-4)
    words = quality.terms(["good words here", "other words here", "GOOD words here"])
    assert (words[0, : quality.SHAPES] == words[1, : quality.SHAPES]).all() and (words[0, quality.SHAPES :] != words[1, quality.SHAPES :]).any()
    assert (words[0, quality.SHAPES :] == words[2, quality.SHAPES :]).all()


def test_quality_is_fitted_without_dense_counts_of_all_labelled_rows(spark):
    """All counts at once took the driver 252 MB for 4,096 labelled rows, beside its JVM."""
    import tracemalloc

    from canopia.llm import quality

    r = random.Random(7)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(40)), i % 2) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.fit(d.limit(8), d)
    tracemalloc.start()
    model = quality.fit(d, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.vectors) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in rows) and peak < 60e6
    whole = quality.terms([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2])
    assert np.allclose(model.idf, np.log((1 + len(whole)) / (1 + (whole > 0).sum(0))) + 1)


def test_quality_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    extra = spark.createDataFrame([(None, "x"), (900_001, None), (900_002, ""), (900_003, "a b " * 50_000)], "doc_id long, text string")
    got = score_quality(d.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit(0)), labels).collect()
    tried = [r for r in got if r.held_out and r.doc_id in marks]
    assert all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted == marks[r.doc_id] for r in tried) / len(tried) > 0.95
    kept = keep_good(d.withColumn("predicted", F.lit("mine")), labels)
    assert kept.columns == [*d.columns, "predicted"] and 0.7 * d.count() < kept.count() < d.count()
    assert all(r.score == 0.5 for r in score_quality(d, labels.limit(0)).collect()) and score_quality(d.limit(0), labels).collect() == []


# Embeddings


def test_index_grows_with_the_number_of_vectors():
    """Recall at just the threshold, by pairs that the plan has not seen, for one and for several hashes more."""
    from canopia.llm.embedding_dedup import plan as index_plan
    from canopia.llm.embedding_dedup import probes

    r = np.random.default_rng(77)
    a, b = r.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    plans = [index_plan(n, 64, 0.9) for n in (1000, 10**8, 10**10)]
    assert [h for _, h in plans] == sorted(h for _, h in plans) and plans[0][1] == 2 and plans[2][1] > 2
    for tables, hashes in plans[:2]:
        x, y = probes(a, tables, hashes), probes(b, tables, hashes)
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.99


def test_embedding_links_are_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 64))
    rows = [(k, (base[k % 40] + r.standard_normal(64) * r.choice([0, 0.1, 0.3, 0.5])).tolist()) for k in range(400)]
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [1.0, float("nan")] + [0.0] * 62), (1003, [None] + [1.0] * 63), (1004, []), (1005, [float("inf")] * 64), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[0][1]), (None, rows[0][1])]
    got = {x.vec_id: x for x in embedding_groups(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int"), block=64).collect()}
    x = np.array([v for i, v in rows if i is not None and (i < 1000 or i == 1008)])
    ids = np.array([i for i, _ in rows if i is not None and (i < 1000 or i == 1008)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= near.sum(1)).all() and found.sum() / near.sum() > 0.98
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(1))
        if (new == root).all():
            break
        root = new
    same = np.mean([got[i].component_id == ids[root[k]] for k, i in enumerate(ids)])
    assert same > 0.98
    assert [got[i].n_links for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, None)] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    assert got[1007].component_id == 1006 and got[1000].kept and not got[1007].kept
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


# The pipeline


def test_pipeline_is_its_stages_by_brute_force(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, small_dir).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    lines = stages["line_dedup"](spark, good, small_dir).cache()
    assert lines.columns == docs.columns and lines.count() == good.count() and lines.where("n_chars <> length(text)").count() == 0
    single = stages["simhash_near_dedup"](spark, lines, small_dir).cache()
    from canopia.llm.simhash import bits_of, wide_fingerprint

    every = {r.doc_id: np.frombuffer(wide_fingerprint(r.text), np.uint64) for r in lines.collect()}
    root = {i: i for i in every}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in every:
        for j in every:
            if i < j and np.bitwise_count(every[i] ^ every[j]).sum() <= bits_of(0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    kept = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and kept >= (want := {find(i) for i in every}) and len(kept) <= 1.01 * len(want) and len(want) < len(every)
    clean = stages["benchmark_decontamination"](spark, single, small_dir).cache()
    bench = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    import re

    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {tuple(w[k : k + 10]) for w in map(word, bench) for k in range(max(1, len(w) - 9))}
    hit = {r.doc_id for r in single.collect() if any(tuple((w := word(r.text))[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(word(r.text)) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == kept - hit
    packed = corpus_pipeline.run(spark, small_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept - hit


def test_stages_take_any_rows(spark, small_dir):
    """Nulls, empty and blank texts, repeated rows, two texts under one id, columns with names that operators use, and empty tables."""
    import corpus_pipeline

    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    a, b = text(200), text(200)
    rows = [(1, a), (2, None), (3, ""), (4, " \n "), (None, b), (None, None), (5, b), (5, b), (6, text(80)), (6, text(90)), (7, a.replace(" ", "  ")), (8, "x")]
    d = spark.createDataFrame([(i, t, "k", 1.0, "en") for i, t in rows], "doc_id long, text string, _id string, score double, lang string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, small_dir)
        assert stage(spark, d.limit(0), small_dir).collect() == [], name
        if name != "best_fit_packing":
            assert out.columns == d.columns, name
        if name == "line_dedup":
            assert out.count() == len(rows)
        if name == "simhash_near_dedup":
            got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
            # 1 and 7 are alike, so are the texts without words; null ids are in no group, and rows that repeat id and text are one.
            assert got == sorted([x for k, x in enumerate(rows) if k not in (2, 3, 7, 10)], key=str)
        if name == "benchmark_decontamination":
            assert out.count() == len(rows)
        if name == "best_fit_packing":
            assert out.count() == len(rows)


def test_similar_texts_are_one_group(spark):
    """Copies with a part of the words changed: those that share 0.87 and more of their shingles are grouped, those that share 0.6 and less are not."""
    from canopia.llm.simhash import similar_groups

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, share = [], {}
    for k in range(40):
        base = [word() for _ in range(400)]
        rows.append((10 * k, " ".join(base)))
        for n, changed in ((1, 2), (2, 5), (3, 20), (4, 40)):
            copy = list(base)
            for at in r.sample(range(400), changed):
                copy[at] = word()
            one, two = ({tuple(w[i : i + 5]) for i in range(396)} for w in (base, copy))
            share[10 * k + n] = len(one & two) / len(one | two)
            rows.append((10 * k + n, " ".join(copy)))
    first = {x._id: x._first for x in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert all(first[10 * k] for k in range(40))
    assert all(not first[i] for i, s in share.items() if s >= 0.87) and all(first[i] for i, s in share.items() if s <= 0.6)
    assert sum(s >= 0.87 for s in share.values()) >= 40 and sum(s <= 0.6 for s in share.values()) >= 40


def test_added_tokens_have_the_ids_of_an_unmodified_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers
    from canopia.llm.queries import op4_token_counts, op8_best_fit_packing

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "é \n<|endoftext|><|endoftext|>\n x", "<|endoftext |> <|endoftext|", " plain"]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = Encoder()
    assert [encoder.ids(t).tolist() for t in texts] == want and want[0] == [64, 50256, 65]
    assert encoder.byte_starts(encoder.ids(texts[0])).tolist() == [0, 1, 14]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op8_best_fit_packing(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*want[r.doc_id], 0], "<u4").tobytes())
    counts = Counter()
    for r in op4_token_counts(spark, str(tmp_path)).collect():
        counts[r.doc_id] += r.n_tokens
    assert [counts[i] for i in range(len(texts))] == [len(w) for w in want]
