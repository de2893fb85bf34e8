"""Substring dedup, fill-in-the-middle and lexical search against brute force on small tables with nulls, ties, repeats, empty and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopia.llm import lexical_search, substring_dedup
from canopia.llm.fill_in_middle import cut_places, fill_in_middle, restored, select_bit, token_starts
from canopia.llm.lexical_search import build_index, rank_documents, search, top_places
from canopia.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, _id string, piece string, n long, score string, rank string, spans string"
rnd = random.Random(11)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 5, "c", "d", "e") for i, t in rows], SCHEMA)


def words(n, letters="abcdenst"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n)]


# --- substring dedup


def brute_repeats(rows, window):
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    times = Counter(tuple(w[k : k + window]) for w in tokens for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, tokens, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if times[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k, k + 1))
        out.append((i, len(w), len(gone), tuple(spans), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got_repeats(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.spans), r.text) for r in df.collect()), key=str)


def repeat_rows():
    share, long, round_ = words(50), words(400), words(7)
    rows = [(k, " ".join(words(rnd.randint(0, 90)))) for k in range(12)]
    rows += [(20 + k, " ".join(words(k) + share + words(9))) for k in range(20)]  # at every offset against the blocks
    rows += [(50, "\t".join(long)), (51, " ".join(long[3:300]) + "\n\n" + " ".join(long[280:])), (52, " ".join(share[:34])), (53, " ".join(share[:35]))]
    rows += [(60, " ".join(round_ * 40)), (61, None), (62, ""), (63, " \n "), (None, " ".join(share[10:48])), (64, " ".join(long)), (64, " ".join(long)), (None, None)]
    rows += [(70, "é日本 x " * 40), (71, " ".join(words(30000))), (72, " ".join(f"w{k % 5}" for k in range(34)))]
    return rows


@pytest.mark.parametrize("window,piece", [(35, 1 << 20), (35, 300), (8, 1000), (1, 1 << 20), (2, 500)])
def test_repeats_are_brute_force(spark, monkeypatch, window, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    rows = repeat_rows()
    assert got_repeats(remove_repeats(docs(spark, rows).repartition(5), window=window)) == brute_repeats(rows, window)


def test_many_copies_are_rows_by_piece_not_pairs(spark):
    copy = " ".join(words(120))
    rows = [(k, copy if k % 3 else " ".join(words(60))) for k in range(3000)]
    got = got_repeats(remove_repeats(docs(spark, rows)))
    assert sum(r[2] for r in got) == 2000 * 120 and all((r[4] == "") == (r[0] % 3 > 0) for r in got)


def test_repeats_without_rows_or_words(spark):
    assert remove_repeats(docs(spark, [])).collect() == []
    assert got_repeats(remove_repeats(docs(spark, [(1, None), (2, "")]))) == [(1, 0, 0, (), ""), (2, 0, 0, (), "")]
    named = spark.createDataFrame([("x", "a b"), (None, "a b")], "name string, body string")
    assert sorted((r.name is None, r.n_removed) for r in remove_repeats(named, "name", "body", window=2).collect()) == [(False, 2), (True, 2)]


# --- fill in the middle


def brute_cut(i, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return i, n, "spm" if h[3] % 100 < 20 else "psm", len(pre), len(mid), out


def cut_rows():
    rows = [(k, "".join(rnd.choice("abZ  \n.é日𝒳<>PS9\x00") for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "a<P>b"), (403, "<S>"), (404, "x<M"), (405, "M> <P"), (None, "no id here"), (406, "word"), (406, "word"), (407, "é"), (408, "Ab9 cd" * 50_000), (409, "a" * 100_000), (410, "Kµab")]
    return rows


def test_cuts_are_brute_force_and_round_trip(spark):
    rows = [r for r in cut_rows() if "\x00" not in (r[1] or "")] + [r for r in cut_rows() if "\x00" in (r[1] or "")]
    df = fill_in_middle(docs(spark, rows).repartition(3))
    got = df.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute_cut(*r) for r in rows), key=str)
    texts = Counter((i, t or "") for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == texts
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs(spark, [])).collect() == []
    assert all(r.form == "plain" for r in fill_in_middle(docs(spark, rows), rate=0).collect())
    other = {(r.doc_id, r.prefix_chars) for r in fill_in_middle(docs(spark, rows), seed=2).collect()}
    assert other != {(r.doc_id, r.prefix_chars) for r in got}


def test_ranked_bits():
    for text in ["", "a", "ab", "9", "a b", "ab,c  d", "é" * 70, "ab " * 100]:
        starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        bits = token_starts(text)
        assert [k for k in range(len(text)) if bits >> k & 1] == starts
        assert [select_bit(bits, k, len(text)) for k in range(len(starts))] == starts
    assert cut_places("ab cd", 2, 0) == (3, 0, 3) and cut_places("", 5, 7) == (0, 0, 0)


# --- lexical search


def brute_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in of.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search_rows():
    vocabulary = words(60)
    rows = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40)))) for k in range(300)]
    rows += [(400 + k, "Tie tie, TIE!") for k in range(25)] + [(7, "tie tie tie"), (None, "tie tie tie"), (500, None), (501, ""), (502, "... "), (503, "Ünder straße İx ünder"), (504, " ".join(rnd.choices(vocabulary, k=30_000)))]
    items = [(k, " ".join(rnd.choices(vocabulary, k=12))) for k in range(8)]
    items += [(20, "tie"), (21, None), (22, ""), (23, "nowhere-found"), (24, "ÜNDER Ünder straße"), (None, "tie nowhere"), (25, vocabulary[0].upper()), (25, vocabulary[1]), (26, "the " * 5)]
    return rows, items


@pytest.mark.parametrize("shard,block", [(1 << 18, 200_000), (200, 200_000), (50, 15), (1, 4)])
def test_search_is_brute_force(spark, shard, block):
    rows, items = search_rows()
    queries = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in items], "item_id long, text string, doc_id int, rank string, score double")
    index, n = build_index(docs(spark, rows).repartition(4), shard_terms=shard)
    got = search(index, n, queries, 10, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, items)


def test_search_over_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rank_documents(docs(spark, []), items).collect() == []
    assert rank_documents(docs(spark, [(1, None), (2, "...")]), items).collect() == []
    assert rank_documents(docs(spark, [(1, "a b")]), none).collect() == []
    assert rank_documents(docs(spark, [(1, "a b")]), none).columns == ["item_id", "rank", "doc_id", "score"]


def test_ids_of_text(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "one")], "name string, body string")
    index, n = build_index(d, "name", "body")
    q = spark.createDataFrame([("q", "two")], "key string, words string")
    assert [tuple(r)[:3] for r in search(index, n, q, 5, "key", "words", "name").orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_top_places_keep_the_lowest_of_ties():
    import numpy as np

    s = np.array([5, 0, 7, 5, 5, 9, 5, 0])
    assert sorted(top_places(s, 4).tolist()) == [0, 2, 3, 5] and sorted(top_places(s, 9).tolist()) == [0, 2, 3, 4, 5, 6] and top_places(s * 0, 3).tolist() == []
    assert lexical_search._terms("A-b_9 É") == [b"a", b"b", b"9", "É".encode()]


def test_index_reads_each_text_once_and_sends_few_bytes_at_once(spark):
    seen = spark.sparkContext.accumulator(0)
    one = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    rows, items = search_rows()
    index, n = build_index(docs(spark, rows).withColumn("text", one("text")))
    assert seen.value == len(rows)
    got = search(index, n, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, items) and seen.value == len(rows)
    sizes = lambda batches: (b.from_arrays([[b.nbytes]], ["mb"]) for b in batches)
    wide = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sent = [r.mb for r in wide.mapInArrow(sizes, "mb long").collect()]
    assert sum(sent) >= 40 << 20 and max(sent) <= 10 << 20


def test_wide_numbers_in_a_shard(spark):
    rows = [(1, "often " * 70_000 + "seldom"), (2, "seldom"), *[(k, "x y") for k in range(3, 400)]]
    index, n = build_index(docs(spark, rows).coalesce(1))
    got = search(index, n, spark.createDataFrame([(1, "often seldom"), (2, "y")], "item_id long, text string"))
    assert index.count() == 1 and sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, [(1, "often seldom"), (2, "y")])
