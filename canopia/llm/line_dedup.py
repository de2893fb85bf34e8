"""Dedup of repeated runs of words by winnowing over word hashes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.plans.shared import broadcast_if_small, discard, join_by_key, materialize

#: A repeated run counts from so many words on.
MIN_WORDS = 50
#: Words by which a run is extended on either side: more than a repeated run can go on without a further fingerprint, which starts a run of its own.
REACH = 48
#: Words whose lengths are added up together.
BLOCK = 64
#: Words that are hashed together where runs of the least length are looked for.
TEN = 10
#: Words of so many bytes, modulo ``CYCLE``, come before all others in the order that fingerprints are chosen by: about one in six of European languages.
COMES_FIRST, CYCLE = 2, 8
#: Rounds in which hashes that are no window's least are left out; what a last round would still drop is kept and does no harm.
ROUNDS = 6
SPANS = "array<struct<start:int,end:int>>"
SPACE = " \t\n\r\x0b\x0c"
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: A word with the white space after it.
SPACED = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once; an array bound like this is sliced without copying the whole of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(SPACE)), GAP)


def _spaced(text: Column | str) -> Column:
    """The words of a text that begins with one, each with the white space that follows it."""
    return F.regexp_extract_all(text, F.lit(SPACED), F.lit(0))


def _at(value: Column) -> Column:
    """The place in a hash with its place below it."""
    return value.bitwiseAND(F.lit((1 << 31) - 1))


def _thinned(values: Column, w: int, rounds: int = ROUNDS) -> Column:
    """``values`` without those between two lesser ones that all windows of ``w`` reach: the windows' least ones stay."""
    if not rounds:
        return values
    reached = lambda v, i: _at(F.get(v, i + 1)) - _at(F.get(v, i - 1)) > w
    keep = lambda v: F.filter(v, lambda x, i: F.coalesce(F.get(v, i - 1) > x, F.lit(True)) | F.coalesce(F.get(v, i + 1) > x, F.lit(True)) | reached(v, i))
    return _let(keep(values), lambda v: _thinned(v, w, rounds - 1))


def _sizes(min_words: int) -> tuple[int, int]:
    """Words of a fingerprint, and neighbouring places of which one is taken: together they are ``min_words`` and one more."""
    k = max(min_words // 3, 1)
    return k, min_words - k + 1


def _fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """``(_id, _hash, _at, _fp)``: the selected fingerprints of each text and the words they start at.

    A fingerprint is a run of k words; the one that starts at the least of w neighbouring places is selected (of equal ones the first),
    where k + w - 1 = ``min_words``. So every run of ``min_words`` words, in any script, has a fingerprint of its own,
    the same wherever it stands, and those of a longer run start at most w apart. Places are in order of the length of their word
    (``COMES_FIRST``), then of the hash of two words: only those that come first are hashed, and the others where w neighbours hold none of them.
    """
    k, w = _sizes(min_words)
    # The hash above, the place (from 1) below: the least of a window says where it stands. No text has 2^31 words.
    value = lambda t, i: F.shiftleft(F.xxhash64(F.get(t, i), F.get(t, i + 1)), 31).bitwiseOR((i + 1).cast("long"))
    comes_first = lambda t: F.array_compact(F.transform(t, lambda x, i: F.when((F.octet_length(x) % CYCLE == COMES_FIRST) & (i <= F.size(t) - k), value(t, i).bitwiseOR(F.lit(-1 << 63)))))
    ends = lambda t, u: F.concat(F.array(F.lit(0).cast("long")), u, F.array(F.greatest(F.size(t) - k + 2, F.lit(1)).cast("long")))
    wide = lambda u, x, i: _at(F.get(u, i + 1)) - _at(x) > w
    others = lambda t, lo, hi: F.transform(F.sequence(lo, hi - 2), lambda i: value(t, i.cast("int")).bitwiseAND(F.lit((1 << 63) - 1)))
    fill = lambda t, u: F.flatten(F.transform(u, lambda x, i: F.when(wide(u, x, i), F.concat(F.array(x), others(t, _at(x), _at(F.get(u, i + 1))))).otherwise(F.array(x))))
    filled = lambda t, c: _let(ends(t, c), lambda u: F.when(F.size(F.filter(u, lambda x, i: wide(u, x, i))) > 0, _let(fill(t, u), lambda v: F.slice(v, F.lit(2), F.size(v) - 2))).otherwise(c))
    start = lambda p: _at(p).cast("int") - 1
    prints = lambda t, v: F.transform(v, lambda p: F.struct(start(p).alias("_at"), F.xxhash64(F.slice(t, start(p) + 1, F.lit(k))).alias("_fp")))
    chosen = _let(_split(F.col("_text")), lambda t: _let(comes_first(t), lambda u: _let(filled(t, u), lambda v: prints(t, _thinned(v, w)))))
    return docs.where(F.col("_text").isNotNull()).select("_id", "_hash", F.inline(chosen))


def _chains(linked: DataFrame, among: list[str], min_words: int) -> DataFrame:
    """Chains of the fingerprints ``(_id, _hash, _at)`` of each text that stand at one distance ``_shift`` from an earlier place, each at most w on.

    ``among`` ends with the columns of the earlier place's text and ``_shift``.
    """
    k, w = _sizes(min_words)
    line = Window.partitionBy(*among).orderBy("_at")
    gap = F.col("_at") - F.lag("_at").over(line) > w
    return (
        linked.withColumn("_run", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(line))
        .groupBy(*among, "_run").agg(F.min("_at").alias("_from"), (F.max("_at") + k).alias("_to"))
        .select("_id", "_hash", "_from", "_to", F.col(among[-3]).alias("_id0"), F.col(among[-2]).alias("_hash0"), (F.col("_from") - F.col("_shift")).alias("_from0"))
    )


def _runs(near: DataFrame, min_words: int) -> DataFrame:
    """``(_id, _hash, _from, _to, _id0, _hash0, _from0)``: chains of repeated fingerprints, each at most w words on, at one distance from where they stand earlier:
    the place before in the same text if there is one, else the first of all.

    Texts are in order of their id (nulls first), then of their hash. What goes round in a circle is one run at the distance of a
    round. The words between two fingerprints of a chain may still differ.
    """
    within = Window.partitionBy("_id", "_hash", "_fp").orderBy("_at")
    # All places of a text come together once, for the places before and for the chains.
    placed = near.repartition("_id", "_hash").withColumn("_at_before", F.lag("_at").over(within))
    own = placed.where(F.col("_at_before").isNotNull()).select("_id", "_hash", "_at", (F.col("_at") - F.col("_at_before")).alias("_shift"))
    heads = materialize(near.groupBy("_fp", "_id", "_hash").agg(F.min("_at").alias("_at")), "first_in_texts")
    first = materialize(heads.groupBy("_fp").agg(F.min(F.struct("_id", "_hash", "_at")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1"), "first_places")
    later = join_by_key(heads, first, "_fp", "_times").where(~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_hash") == F.col("_first._hash"))))
    later = later.select("_id", "_hash", "_at", F.col("_first._id").alias("_id0"), F.col("_first._hash").alias("_hash0"), (F.col("_at") - F.col("_first._at")).alias("_shift"))
    own = _chains(own, ["_id", "_hash", "_shift"], min_words)
    return own.unionByName(_chains(later, ["_id", "_hash", "_id0", "_hash0", "_shift"], min_words))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _equal(a: Column, b: Column) -> Column:
    """Which words of two lists are equal, whatever white space follows them."""
    return F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) | F.btrim(x, F.lit(SPACE)).eqNullSafe(F.btrim(y, F.lit(SPACE))))


def _places(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """For places ``(_i, _h, _pos, _n)`` between words of texts: the characters before (``_offset``), the text of up to ``reach`` words before
    (``_before``) and of up to ``_n`` words after (``_after``, ``_m`` words), with the white space that follows.

    Lengths are added up by blocks of words, so a place in a long text costs no more than one in a short text.
    """
    per_doc = materialize(wanted.groupBy("_i", "_h").agg(F.collect_set(F.struct("_pos", "_n")).alias("_all")), "places_wanted")  # at most two for each fingerprint
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    joined = lambda t, b, n: F.length(F.array_join(F.slice(t, b * BLOCK + 1, n), ""))
    lengths = lambda t: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(t), 6)), lambda b: joined(t, b, F.lit(BLOCK)))
    by_block = lambda n: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(n), 6)), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
    part = lambda n, p: total(F.slice(n, F.shiftright(p, 6) * BLOCK + 1, p - F.shiftright(p, 6) * BLOCK))
    # Sums of blocks, and of blocks of blocks, so that very long texts cost no square.
    up_to = lambda t, one, two, p: _let(F.shiftright(p, 6), lambda b: total(F.slice(two, F.lit(1), F.shiftright(b, 6))) + part(one, b) + joined(t, b, p - b * BLOCK))
    before = lambda t, p: F.array_join(F.slice(t, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach))), "")

    def all_places(t: Column) -> Column:
        one = lambda x, a, b: F.struct(x["_pos"].alias("_pos"), x["_n"].alias("_n"), (F.col("_blank") + up_to(t, a, b, x["_pos"])).alias("_offset"), before(t, x["_pos"]).alias("_before"), F.array_join(F.slice(t, x["_pos"] + 1, x["_n"]), "").alias("_after"), F.least(x["_n"], F.size(t) - x["_pos"]).alias("_m"))
        return _let(lengths(t), lambda a: _let(by_block(a), lambda b: F.transform("_all", lambda x: one(x, a, b))))

    d = docs.join(broadcast_if_small(per_doc), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_i", "_h", "_all", "_text", F.ltrim("_text", F.lit(SPACE)).alias("_cut"))
    d = d.select("_i", "_h", "_all", (F.length("_text") - F.length("_cut")).alias("_blank"), "_cut")
    places = materialize(d.select("_i", "_h", F.inline(_let(_spaced("_cut"), all_places))), "places")
    if places.count() == (per_doc.agg(F.sum(F.size("_all"))).first()[0] or 0):
        return places
    single = materialize(places.dropDuplicates(["_i", "_h", "_pos", "_n"]), "places")  # rows that repeat id and text have given the same places
    discard(places)
    return single


def _extended(docs: DataFrame, runs: DataFrame, reach: int, least: int) -> DataFrame:
    """The parts of ``runs``, and of up to ``reach`` words beside them, over which the words themselves are equal: ``least`` words or longer.

    ``_start`` and ``_end`` are in characters.
    """
    runs = runs.withColumn("_n", F.col("_to") - F.col("_from") + reach)
    ends = [("_id", "_hash", "_from"), ("_id0", "_hash0", "_from0")]
    wanted = [runs.select(F.col(i).alias("_i"), F.col(h).alias("_h"), F.col(p).alias("_pos"), "_n") for i, h, p in ends]
    places = _places(docs, reduce(DataFrame.unionByName, wanted), reach)
    for i, h, p in ends:
        own = places.select("_i", "_h", "_pos", F.col("_n").alias("_n1"), *[F.col(c).alias(c + p) for c in (["_offset", "_m", "_before", "_after"] if i == "_id" else ["_before", "_after"])])
        runs = runs.join(own, F.col(i).eqNullSafe(F.col("_i")) & (F.col(h) == F.col("_h")) & (F.col(p) == F.col("_pos")) & (F.col("_n") == F.col("_n1"))).drop("_i", "_h", "_pos", "_n1")
    last_first = lambda c: F.reverse(_spaced(c))
    leading = lambda e: _let(F.array_position(e, False), lambda p: F.when(p > 0, p - 1).otherwise(F.size(e)).cast("int"))
    differ = lambda e: F.concat(F.array_compact(F.transform(e, lambda x, i: F.when(~x, i))), F.array(F.size(e)))
    same = F.col("_after_from") == F.col("_after_from0")
    cuts = lambda w, left: F.concat(F.array(-left - 1), F.when(same, F.array("_m_from")).otherwise(_let(_equal(w, _spaced("_after_from0")), differ)))
    bounds = lambda c: F.filter(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, j: F.struct((x + 1).alias("lo"), F.get(c, j + 1).alias("hi"))), lambda s: s["hi"] - s["lo"] >= least)
    length = lambda w, n: F.length(F.array_join(F.slice(w, F.lit(1), n), ""))

    def parts(b: Column, w: Column, v: Column) -> Column:
        at = lambda x: F.when(x < 0, F.col("_offset_from") - length(v, F.greatest(-x, F.lit(0)))).otherwise(F.col("_offset_from") + length(w, F.greatest(x, F.lit(0))))
        return F.transform(b, lambda s: F.struct(
            (F.col("_from") + s["lo"]).alias("_from"), (F.col("_from") + s["hi"]).alias("_to"), at(s["lo"]).alias("_start"), at(s["hi"]).alias("_end")
        ))

    every = _let(_spaced("_after_from"), lambda w: _let(last_first("_before_from"), lambda v: _let(
        leading(_equal(v, last_first("_before_from0"))), lambda left: _let(cuts(w, left), lambda c: _let(bounds(c), lambda b: parts(b, w, v)))
    )))
    moved = materialize(runs.select("_id", "_hash", F.inline(every)), "extended")
    discard(places)
    return moved


def _second_look(docs: DataFrame, near: DataFrame, several: DataFrame, short: DataFrame, min_words: int, single: bool) -> DataFrame | None:
    """Spans of runs that the earlier place looked at does not hold far enough, but another does.

    ``short`` has what was left: ``(_id, _hash, _from, _to)``. All places of those fingerprints are looked at, and each run of ``min_words`` words
    that holds one is known by two hashes of 64 bits; the later ones of equal ones are the spans. So nothing is compared pair by pair. Fingerprints with
    two places have no other to look at. ``single``: no rows of ``docs`` repeat both id and text.
    """
    k, w = _sizes(min_words)
    part = F.explode(F.sequence(F.shiftright("_from", 6), F.shiftright(F.col("_to") - k, 6)))
    of = short.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_from", "_to", part.alias("_part")).distinct()
    inside = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")) & (F.shiftright("_at", 6) == F.col("_part")) & F.col("_at").between(F.col("_from"), F.col("_to") - k)
    # Every repeated fingerprint is marked or not: the joins give back as many rows as there are, whatever the size of a group.
    held = near.join(of, inside, "left").groupBy("_fp").agg(F.max(F.col("_h").isNotNull()).alias("_held")).where("_held").select("_fp")
    fps = materialize(held.join(several.where("_times > 2"), "_fp", "left_semi"), "looked_at")
    if fps.isEmpty():
        return None
    marked = near.join(broadcast_if_small(fps.withColumn("_marked", F.lit(True))), "_fp", "left")
    per_doc = marked.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.collect_set(F.when(F.col("_marked"), F.col("_at"))).alias("_all")).where(F.size("_all") > 0)
    d = docs.join(broadcast_if_small(materialize(per_doc, "looked_at_texts")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_id", "_hash", "_all", "_text")
    starts = lambda t: F.array_distinct(F.flatten(F.transform("_all", lambda p: F.sequence(F.greatest(p - w + 1, F.lit(0)), F.greatest(F.least(p, F.size(t) - min_words), F.greatest(p - w + 1, F.lit(0)))))))
    # Parts of TEN words are hashed once for all runs that they stand in; the last two of a run may overlap.
    part_of = min(TEN, min_words)
    at = [*range(0, min_words - part_of, part_of), min_words - part_of]
    parts_from = lambda t: F.transform(t, lambda x, i: F.xxhash64(F.slice(t, i + 1, F.lit(part_of))))
    digest = lambda h, p: F.struct(p.alias("_from"), F.xxhash64(*[F.get(h, p + i) for i in at]).alias("_a"), F.xxhash64(F.lit(1), *[F.get(h, p + i) for i in at]).alias("_b"))
    runs = _let(_split(F.col("_text")), lambda t: _let(parts_from(t), lambda h: F.transform(F.filter(starts(t), lambda p: p + min_words <= F.size(t)), lambda p: digest(h, p))))
    grams = d.select("_id", "_hash", F.inline(runs))
    grams = materialize(grams if single else grams.distinct(), "runs_of_least_length")
    several = materialize(grams.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_hash", "_from")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1"), "repeated_runs")
    later = join_by_key(grams, several, ["_a", "_b"], "_times").where(~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_hash") == F.col("_first._hash")) & (F.col("_from") == F.col("_first._from"))))
    line = Window.partitionBy("_id", "_hash").orderBy("_from")
    apart = F.col("_from") - F.lag("_from").over(line) > min_words
    spans = later.withColumn("_run", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(line)).groupBy("_id", "_hash", "_run").agg(F.min("_from").alias("_pos"), (F.max("_from") - F.min("_from") + min_words).alias("_n"))
    spans = materialize(spans.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_pos", "_n"), "more_spans")
    if spans.isEmpty():
        return None
    return _places(docs, spans, 0).select(F.col("_i").alias("_id"), F.col("_h").alias("_hash"), F.col("_offset").alias("_start"), (F.col("_offset") + F.length("_after")).alias("_end"))


def _copies(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(_i, _h)``: the texts that an earlier id has as a whole; and whether no rows repeat both id and text."""
    texts = materialize(docs.select("_id", "_hash").distinct(), "texts")
    first = materialize(texts.groupBy("_hash").agg(F.min(F.struct("_id")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1"), "first_texts")
    found = join_by_key(texts, first, "_hash", "_times").where(~F.col("_id").eqNullSafe(F.col("_first._id")))
    return materialize(found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")), "copies"), texts.count() == docs.count()


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """``(__id, __hash, __spans, __whole)``: the characters to delete from each text, as sorted ``(start, end)``; or that an earlier id has the text as a whole."""
    copies, single = _copies(docs)
    copies = broadcast_if_small(copies)
    is_copy = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    prints = materialize(_fingerprints(docs.join(copies, is_copy, "left_anti"), min_words), "fingerprints")
    several = materialize(prints.groupBy("_fp").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"), "several")
    near = join_by_key(prints, several, "_fp", "_times")
    near = materialize(near if single else near.distinct(), "repeated")  # rows that repeat id and text are one
    discard(prints)
    runs = materialize(_runs(near, min_words), "runs")
    done = []
    if not runs.isEmpty():
        moved = _extended(docs, runs, max(REACH, min_words), _sizes(min_words)[0])
        long = F.col("_to") - F.col("_from") >= min_words
        more = _second_look(docs, near, several, moved.where(~long).select("_id", "_hash", "_from", "_to"), min_words, single)
        done += [moved.where(long).select("_id", "_hash", "_start", "_end"), *([] if more is None else [more])]
    of_text = [F.col("_i").alias("__id"), F.col("_h").alias("__hash")]
    spans = copies.select(*of_text, F.array().cast(SPANS).alias("__spans"), F.lit(True).alias("__whole"))
    if done:
        found = reduce(DataFrame.unionByName, done).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")).alias("_span"))
        per_doc = found.groupBy("_i", "_h").agg(F.array_sort(F.collect_set("_span")).alias("__spans"))
        spans = spans.unionByName(per_doc.select(*of_text, F.col("__spans").cast(SPANS), F.lit(False).alias("__whole")))
    return materialize(spans, "spans")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, spans: str = "n_spans", removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with later repeated runs of ``min_words`` words or more deleted from the text, and counts of spans and words deleted.

    Of each fingerprint the first place (in order of id, then of the text's hash, then in the text) stays; a run at a later place
    is extended both ways, word by word, as far as its words equal those at and around the earlier place, and deleted if it is long enough
    then. Every run of ``min_words`` words holds a fingerprint, and a longer one a further one within reach. Runs that are too short
    at that place are looked at again among all places of their fingerprints, so no run of ``min_words`` words that stands earlier is left. All other columns stay; columns with the names of the counts are replaced. A null text stays null, an empty one empty; of equal texts under different ids the later become empty.
    Rows that repeat both id and text are one document: they get equal results and never repeat each other. A null id is an
    id. An empty table gives an empty one.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    spans_of = broadcast_if_small(_spans(known, min_words))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    marked = docs.drop(spans, removed).join(spans_of, on, "left").drop("__id", "__hash")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"), F.lit("").alias("gone"), F.lit(0).alias("n"))

    def without(done: Column, s: Column) -> Column:
        """Copies what stands before a span, and what is deleted; ``n`` counts spans that do not touch the one before."""
        kept = F.concat(done["kept"], F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))))
        first = F.greatest(s["start"], done["at"])
        gone = F.concat(done["gone"], F.substring(text, first + 1, F.greatest(s["end"] - first, F.lit(0))))
        fresh = (s["start"] > done["at"]) | (done["n"] == 0)
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), kept.alias("kept"), gone.alias("gone"), (done["n"] + fresh.cast("int")).alias("n"))

    whole = F.coalesce("__whole", F.lit(False)) & (_words(text) >= min_words)
    some = F.coalesce(F.size("__spans") > 0, F.lit(False))
    rest = lambda d: F.struct(F.concat(d["kept"], F.substring(text, d["at"] + 1, F.length(text))).alias("kept"), d["gone"].alias("gone"), d["n"].alias("n"))
    all_gone = F.struct(F.lit("").alias("kept"), text.alias("gone"), F.lit(1).alias("n"))
    cut = marked.withColumn("__cut", F.when(some, F.aggregate("__spans", start, without, rest)).when(whole, all_gone))
    return cut.select(
        *[F.when(F.col("__cut").isNull(), text).otherwise(F.col("__cut.kept")).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in (spans, removed)],
        F.coalesce("__cut.n", F.lit(0)).cast("long").alias(spans),
        F.coalesce(_words(F.col("__cut.gone")), F.lit(0)).cast("long").alias(removed),
    )
