"""The text operators against brute force on small tables with nulls, ties, repeats, empty and clashing columns."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from canopia.llm.decontamination import contamination, decontaminate
from canopia.llm.line_dedup import dedup_lines
from canopia.llm.sharding import assign_shards, lookup_table
from canopia.llm.simhash import LISTED, MAX_BITS, PLACES, fingerprint, simhash_groups
from canopia.llm.token_counts import section_tokens

SCHEMA = "doc_id long, text string, _id string, spans string"
rnd = random.Random(5)


def words(n, letters="abcdenstr"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(rows, items, n=10):
    out = []
    for i, t in rows:
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            b = tokens(text)
            k = min(n, len(b))
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), len(hit) > 0))
    return sorted(out, key=str)


def contamination_rows():
    bench = [(2, " ".join(words(14))), (10, "Short ITEM é"), (3, None), (4, ""), (5, " ".join(words(10)))]
    rows = [(k, " ".join(words(20))) for k in range(5)]
    rows += [(7, "start " + bench[0][1].upper() + " end"), (8, "a short item é, b"), (9, None), (10, ""), (11, bench[4][1]), (11, bench[4][1]), (None, bench[4][1]), (12, " ".join([bench[4][1]] * 3)), (13, " ".join(words(4000)) + " " + bench[4][1])]
    return rows, bench


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_contamination_is_brute_force(spark, broadcast):
    rows, bench = contamination_rows()
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = contamination(docs(spark, rows), b, broadcast_windows=broadcast).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.n_hit > 0) for r in got), key=str)
    assert got == brute_contamination(rows, bench)
    clean = {x[0] for x in got if not x[5]}
    kept = [r.doc_id for r in decontaminate(docs(spark, rows), b, broadcast_windows=broadcast).collect()]
    assert set(kept) == clean and None not in kept


def test_contamination_without_benchmark_or_documents(spark):
    rows, bench = contamination_rows()
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in contamination(docs(spark, rows), none).collect())
    assert decontaminate(docs(spark, rows), none).count() == len(rows)
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert contamination(docs(spark, []), b).collect() == [] and decontaminate(docs(spark, []), b).collect() == []


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_any_five_places_hold_a_list():
    from itertools import combinations

    assert all(len(p) == LISTED for p in PLACES) and len(PLACES) == 14
    assert all(any(set(p) <= set(five) for p in PLACES) for five in combinations(range(8), 8 - MAX_BITS))


def test_simhash_groups_are_brute_force(spark):
    base = [" ".join(words(60)) for _ in range(12)]
    rows = []
    for k, t in enumerate(base):
        w = t.split()
        rows += [(k * 10, t), (k * 10 + 1, t.upper()), (k * 10 + 2, " ".join(w[:-1])), (k * 10 + 3, " ".join([*w, "zz"]))]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "One"), (505, "é two"), (506, "x " * 5000), (0, base[0]), (None, base[1]), (None, "alone")]
    got = simhash_groups(docs(spark, rows), block=4).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.fp % 2**64) for r in got), key=str) == sorted(prints, key=str)
    assert all(fingerprint(t) == f for (_, t), (_, f) in zip(rows, prints, strict=True))
    different = sorted({f for _, f in prints})
    root = {f: f for f in different}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in different:
        for b in different:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, least.get(find(f))) for i, f in prints), key=str)
    assert simhash_groups(docs(spark, [])).collect() == []


def line_rows():
    passage, other = " ".join(words(60)), " ".join(words(75))
    rows = [
        (1, " ".join(words(80)) + ". " + passage + " " + " ".join(words(70))), (2, " ".join(words(30)) + " " + passage + " " + " ".join(words(33))), (3, " ".join(words(100))),
        (4, None), (5, ""), (7, " ".join(words(20)) + "\n" + passage), (8, "x"), (9, "x"), (10, other + "\n\n" + other), (11, " ".join(words(40))), (12, "word " * 3000), (None, passage),
    ]
    copy = " ".join(words(120))
    return [*rows, (20, copy), (21, copy), (21, copy)], passage, other


def test_line_dedup_deletes_later_passages_and_nothing_else(spark):
    rows, passage, other = line_rows()
    got = dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got[0]._id == "x" and got[0].spans == "y"
    texts = {r.doc_id: r for r in got}
    assert texts[None].text == passage and texts[None].n_spans == 0  # a null id comes first
    for i in (1, 2, 7):
        original = dict(rows)[i]
        assert passage not in texts[i].text and texts[i].n_removed == 60 and texts[i].n_spans == 1
        before, after = original.split(passage)
        assert texts[i].text == before + after.lstrip()
    for i in (3, 4, 5, 8, 9, 11, 20):
        assert texts[i].text == dict(rows)[i] and texts[i].n_removed == 0
    assert texts[10].text.split() == other.split()
    assert [r.text for r in got if r.doc_id == 21] == ["", ""]
    assert dedup_lines(docs(spark, [])).collect() == []


def test_line_dedup_leaves_no_long_repeats_on_the_small_table(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: r for r in dedup_lines(d).collect()}
    original = {r.doc_id: r.text or "" for r in d.collect()}
    assert set(got) == set(original)
    seen, left, removed = set(), 0, 0
    for i in sorted(original):
        w, kept = original[i].split(), (got[i].text or "").split()
        grams = [" ".join(kept[k : k + 50]) for k in range(len(kept) - 49)]
        left += sum(g in seen for g in grams)
        seen.update(" ".join(w[k : k + 50]) for k in range(len(w) - 49))
        removed += got[i].n_removed
        assert len(w) - len(kept) == got[i].n_removed
    assert removed > 0 and left == 0


def test_line_dedup_finds_what_no_first_place_holds_whole(spark):
    """Each half of a passage stands first in a text of its own, too short to count; the whole stands in two later ones."""
    passage = words(70)
    rows = [(1, " ".join(words(60) + passage[:42])), (2, " ".join(passage[30:] + words(60))), (3, " ".join(words(20) + passage + words(20))), (4, " ".join(words(9) + passage + words(9)))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 70}


def test_line_dedup_compares_words_within_runs(spark):
    """Two texts that differ in single words: the stretches of 50 words and more go, the others stay."""
    a = words(400)
    b = [x + "q" if k in (10, 75, 100, 170, 175, 399) else x for k, x in enumerate(a)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 64 + 69 + 223 and got[2].n_spans == 3
    assert got[2].text.split() == [*b[:11], *b[75:101], *b[170:176], b[399]]


def test_sections_add_up_to_whole_texts(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = ["one two\nthree\n\n  four", "", None, "é\nü 漢字\n🙂🙂 x", "<|endoftext|>\nend\n", "a" * 5000 + "\n" + " ".join(words(3000)), "\n", "no end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x\ny"), (0, texts[0])]
    got = section_tokens(docs(spark, rows)).collect()
    for i, t in enumerate(texts):
        own_rows = sorted({(r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in got if r.doc_id == i})
        e = own.encode(t or "", add_special_tokens=False)
        assert sum(r[3] for r in own_rows) == len(e.ids)
        want = re.findall(r"[^\n]*\n|[^\n]+$", t or "") or [""]
        assert [(t or "")[r[1] : r[2]] for r in own_rows] == want
        for _, lo, hi, n, crossing in own_rows:
            assert n == sum(lo <= o[0] < hi for o in e.offsets)
            assert crossing == sum(lo <= o[0] < hi < o[1] for o in e.offsets)
    assert len([r for r in got if r.doc_id == 0]) == 8 and len([r for r in got if r.doc_id is None]) == 2
    assert section_tokens(docs(spark, [])).collect() == []


def test_sharding_table_is_fair_and_stable(spark):
    table = lookup_table([f"s{i}" for i in range(7)], 101)
    assert sorted(table.count(k) for k in range(7)) == [14, 14, 14, 14, 15, 15, 15]
    fewer = lookup_table([f"s{i}" for i in range(6)], 101)
    assert sum(a == b for a, b in zip(table, fewer, strict=True) if a != 6) >= 60
    with pytest.raises(ValueError):
        lookup_table(["a"], 100)
    with pytest.raises(ValueError):
        lookup_table(["a", "a"], 101)
    rows = [(k, "t") for k in range(2000)] + [(None, "t"), (None, "t"), (5, "t")]
    d = docs(spark, rows).withColumn("shard", F.lit("old"))
    got = assign_shards(d, ["doc_id"], 8, 1009).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 5}) == 1
    sizes = [sum(r.shard == k for r in got) for k in range(8)]
    assert min(sizes) > 180 and max(sizes) < 330
    assert len({r.shard for r in assign_shards(d.withColumn("source", F.lit("hot")), ["source"], 8, 1009, salt=["doc_id"]).collect()}) == 8


def test_item_digest_is_the_contracts(spark, small_dir):
    from canopia.llm.queries import op1_decontamination

    rows = op1_decontamination(spark, small_dir).collect()
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.contaminated) and any(r.contaminated for r in rows)


@pytest.mark.parametrize("letters", ["abcdenrst", "aeioubcdf", "абвгдежз", "αβγδεζηθ", "ابتثجحخد", "अआइईउऊकख"])
def test_line_dedup_finds_short_passages_in_any_script(spark, letters):
    passages = [words(51, letters) for _ in range(40)]
    rows = [(2 * k, " ".join([*words(45, letters), *p, *words(40, letters)])) for k, p in enumerate(passages)]
    rows += [(2 * k + 1, " ".join([*words(38, letters), *p, *words(47, letters)])) for k, p in enumerate(passages)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs(spark, rows)).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] >= 51 for k in range(len(passages)))


def test_line_dedup_deletes_what_goes_round_in_a_circle(spark):
    refrain = ". ".join(" ".join(words(4)) for _ in range(3)) + ".\n"
    head, other = " ".join(words(30)), " ".join(words(30))
    rows = [(1, head + "\n" + refrain * 100), (2, other + "\n" + refrain * 100), (3, "b " * 400), (4, "b " * 300)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[1].text == head + "\n" + refrain and got[1].n_removed == 99 * 12
    assert got[2].text == other + "\n" and got[2].n_removed == 1200
    assert got[3].text == "b " and got[4].text == ""


def test_line_dedup_extends_over_long_lines(spark):
    lines = [" ".join(words(80)) for _ in range(4)]
    copy = "\n".join(lines)
    parts = [" ".join(words(30)) for _ in range(40)]
    inner = " ".join(parts)
    rows = [(0, words(1)[0] + " " + copy), (1, copy + " " + words(1)[0])]
    # Each part but the first and last also stands in an earlier text, so only the ends of the passage lead to text 50.
    rows += [(10 + k, " ".join([*words(9), p, *words(9)])) for k, p in enumerate(parts[1:-1])] + [(50, inner), (60, " ".join([*words(9), inner, *words(9)]))]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[1].n_removed == 320 and len(got[1].text.split()) == 1
    assert got[60].n_removed == 1200 and got[60].n_spans == 1


def test_line_dedup_looks_for_repeated_rows_only_if_there_are_any(spark, monkeypatch):
    from canopia.llm import line_dedup

    plans, write = {}, line_dedup.materialize

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().analyzed().toString()
        return write(df, tag)

    monkeypatch.setattr(line_dedup, "materialize", noted)
    passage = words(70)
    rows = [(1, " ".join(words(60) + passage[:42])), (2, " ".join(passage[30:] + words(60))), (3, " ".join(words(20) + passage + words(20))), (4, " " + " ".join(words(9) + passage + words(9)))]
    for more, looked in (([], False), (rows[3:], True)):
        got = {(r.doc_id, r.n_removed) for r in dedup_lines(docs(spark, rows + more)).collect()}
        assert got == {(1, 0), (2, 0), (3, 0), (4, 70)}
        assert [bool(re.search("Deduplicate|Distinct", plans[t])) for t in ("repeated", "runs_of_least_length")] == [looked] * 2


def test_line_dedup_hashes_few_words(spark):
    """Places of fingerprints are words of 2, 10, 18... bytes; others only where 35 neighbours hold none of these. All windows of 35 hold a place."""
    from canopia.llm.line_dedup import _fingerprints

    few = [x * 3 for x in words(300) if len(x) % 8 != 6]
    few = [x + "x" if len(x) % 8 == 2 else x for x in few]
    texts = [words(300), few, [*few[:60], "by", *few[60:150], "of", "it", *few[150:]], words(15), ["by"] * 80, [*few[:40], "абвгд", *few[40:48]]]
    d = spark.createDataFrame([(i, 0, " ".join(t)) for i, t in enumerate(texts)], "_id long, _hash long, _text string")
    found = {}
    for r in _fingerprints(d, 50).collect():
        found.setdefault(r._id, set()).add(r._at)
    for i, t in enumerate(texts):
        starts, comes_first = range(len(t) - 15), [len(x.encode()) % 8 == 2 for x in t]
        at = found.get(i, set())
        assert at <= set(starts)
        assert all(any(p in at for p in range(s, s + 35)) for s in range(len(starts) - 34))
        for p in at:
            lo, hi = (next((q for q in way if comes_first[q]), end) for way, end in ((range(p, -1, -1), -1), (range(p, len(starts)), len(starts))))
            assert comes_first[p] or hi - lo > 35


def test_line_dedup_finds_passages_without_words_that_come_first(spark):
    """Passages of 50 words stand between words of other lengths: none, some or all of the places beside them come first."""
    dull = lambda n: [(x * 3)[:3] for x in words(n)]
    passages = [dull(50) for _ in range(24)]
    for k, p in enumerate(passages):
        p[k * 2] = "of" if k % 3 else p[k * 2]
    rows = [(k, " ".join([*dull(60 - k), *p, *dull(45)])) for k, p in enumerate(passages)]
    rows += [(100 + k, " ".join([*(["by"] + dull(2)) * (k + 4), *p, *["it", *dull(1)] * 12])) for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert got[k].n_removed == 0 and got[100 + k].n_removed >= 50 and " ".join(p) not in got[100 + k].text
