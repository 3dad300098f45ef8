"""MinHash near-duplicates: ProbMinHash signatures of weighted word shingles, banded and verified.

Every shingle is the source of a Poisson process whose rate is its weight; its arrivals go to
registers by chance, each register keeps the earliest, and a document stops when no later arrival
can change a register. Two documents agree in a register with the probability Jaccard similarity
of their weights as chance: a shingle weighs 1, or as often as it stands in the text. Bands of registers
give candidates, which are verified on the shingles themselves.

A bucket is a band and its key. Of all members of a band at most SHARE buckets can hold more than one
in SHARE; these large ones are few by that bound, so what is known of them is broadcast and their
members stay spread over all tasks. All other buckets are small beside a task's share of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectext
from .components import components
from .toxicity import words_in

#: Words of a shingle; least similarity; registers; registers of a band.
WORDS, ALIKE, REGISTERS, BAND = 5, 0.8, 128, 6
#: Members of a bucket up to which all its pairs are verified at once. It only moves work: beyond it
#: hubs and rare shingles find the same components.
SMALL = 24
#: A bucket with more than one in so many of a band's members is hot.
SHARE = 500

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct shingles, weights, where each text's begin, two hashes of the word sequence).

    A text of fewer words than a shingle has one shingle of all its words; a text without a word
    has none. A shingle's weight is how often it stands in the text.
    """
    w = words_in(texts)
    name = vectext.name_hashes(w.names) if w.names else np.zeros(0, np.uint64)
    each = name[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(each), dtype=np.uint64) - np.repeat(w.offsets[:-1], w.lengths).astype(np.uint64)
        term = vectext.mixed(each ^ vectext.mixed(place * np.uint64(_ODD[0])))
        other = vectext.mixed(each + vectext.mixed(place * np.uint64(_ODD[1]) + np.uint64(1)))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t, dtype=np.uint64)]) for t in (term, other)]
        whole = [vectext.mixed((s[w.offsets[1:]] - s[w.offsets[:-1]]) ^ w.lengths.astype(np.uint64)) for s in sums]
        padded = np.concatenate([each, np.zeros(words, np.uint64)])
        joined = np.zeros(len(each), np.uint64)
        for k in range(words):
            joined = vectext.mixed(joined * np.uint64(_ODD[2]) + padded[k : k + len(each)])
    owner = w.owner
    left = np.repeat(w.offsets[1:], w.lengths) - np.arange(len(each))
    full = left >= words
    short = np.flatnonzero((w.lengths > 0) & (w.lengths < words))
    owner = np.concatenate([owner[full], short])
    hashes = np.concatenate([joined[full], whole[0][short]])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.concatenate([at, [len(hashes)]]))
    begins = np.searchsorted(owner[at], np.arange(len(w.lengths) + 1))
    return hashes[at], weights, begins, whole[0], whole[1]


def signatures(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures of many documents at once: the shingle that came first, by register.

    In round t every shingle that still can matter has its t-th arrival: the time since the one
    before is exponential with the weight as rate, the register is uniform, both drawn from a hash
    of shingle and round. Documents without a shingle have zeros.
    """
    docs = len(begins) - 1
    owner = np.repeat(np.arange(docs), np.diff(begins))
    first = np.full(docs * registers, np.inf)
    came = np.zeros(docs * registers, np.uint64)
    shingle, rate, clock, turn = hashes, weights.astype(np.float64), np.zeros(len(hashes)), 0
    # the first arrivals alone settle most registers of long texts; the last of them bounds the rest
    while len(shingle):
        turn += 1
        with np.errstate(over="ignore"):
            draw = vectext.mixed(shingle + np.uint64(turn * _ODD[3] & (2**64 - 1)))
            where = vectext.mixed(draw ^ np.uint64(_ODD[4]))
        clock = clock - np.log((np.right_shift(draw, np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = owner * registers + (where % np.uint64(registers)).astype(np.int64)
        better = clock < first[slot]
        at, time, what = slot[better], clock[better], shingle[better]
        np.minimum.at(first, at, time)
        won = time == first[at]
        came[at[won]] = what[won]
        last = first.reshape(docs, registers).max(1)
        go_on = clock < last[owner]
        shingle, rate, clock, owner = shingle[go_on], rate[go_on], clock[go_on], owner[go_on]
    return came.reshape(docs, registers)


def bands(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    docs, registers = signature.shape
    out = np.zeros((docs, registers // band), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(registers // band):
            key = np.full(docs, b + 1, np.uint64)
            for k in range(b * band, (b + 1) * band):
                key = vectext.mixed(key * np.uint64(_ODD[0]) + signature[:, k])
            out[:, b] = key
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def _lists(flat: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(_signed(flat)))


def signed_documents(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, tie, h1, h2 (hashes of the word sequence), size (distinct shingles), bands.

    weighted: shingles weigh as often as they stand in the text; else all alike.
    """

    def made(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                hashes, weights, begins, h1, h2 = shingles(some.column(1))
                keys = bands(signatures(hashes, weights if weighted else np.ones(len(hashes)), begins))
                lists = _lists(np.ascontiguousarray(keys).ravel(), np.arange(some.num_rows + 1) * keys.shape[1])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(_signed(h1)), pa.array(_signed(h2)), pa.array(np.diff(begins)), lists], ["doc_id", "tie", "h1", "h2", "size", "bands"])

    return _rows(docs).mapInArrow(made, "doc_id long, tie long, h1 long, h2 long, size long, bands array<long>")


def shingle_lists(rows: DataFrame) -> DataFrame:
    """doc_id, list: the hashes of each text's distinct shingles."""

    def made(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                hashes, _, begins, _, _ = shingles(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(hashes, begins)], ["doc_id", "list"])

    return rows.select("doc_id", "text").mapInArrow(made, "doc_id long, list array<long>")


def verified(pairs: DataFrame, lists: DataFrame, alike: float) -> DataFrame:
    """Those of the pairs (a, b) of which the shingle sets have a Jaccard similarity of ``alike`` or more."""
    sized = lists.withColumn("n", F.size("list"))
    left = pairs.join(sized.select(F.col("doc_id").alias("a"), F.col("list").alias("x"), F.col("n").alias("n_a")), "a")
    both = left.join(sized.select(F.col("doc_id").alias("b"), F.col("list").alias("y"), F.col("n").alias("n_b")), "b")
    close = F.least("n_a", "n_b") >= alike * F.greatest("n_a", "n_b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(close).where(common >= alike * (F.col("n_a") + F.col("n_b") - common) - 1e-9).select("a", "b")


def sharing_rare(members: DataFrame, lists: DataFrame, alike: float) -> DataFrame:
    """Pairs (a, b) of ``members`` (rep, outside, of) in different components that can be ``alike``.

    In any order of elements that is the same for all, the rarest among the members first here: if
    two sets are alike, the smaller has one of its first n - ceil(2 s n / (1 + s)) + 1 elements among
    the first n - ceil(s n) + 1 of the larger. And from the first element that they share on, they
    share no more than either has left. One of a pair is outside the largest component of its
    bucket.
    """
    held = members.join(lists.select(F.col("doc_id").alias("rep"), F.size("list").alias("n"), F.explode("list").alias("g")), "rep")
    often = held.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    ranked = held.join(often, "g", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("c", "g"))).where("c > 1")
    first = lambda share: F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    rare = scratch.table(ranked.where(first(alike)).select("rep", "outside", "of", "n", "place", "g", first(2 * alike / (1 + alike)).alias("index")), "rare-shingles")
    side = lambda rows, t: rows.select("g", *[F.col(c).alias(f"{c}_{t}") for c in ("rep", "of", "n", "place")])
    common = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1
    fits = (F.col("n_x") >= alike * F.col("n_y") - 1e-9) & (common >= alike * (F.col("n_x") + F.col("n_y") - common) - 1e-9)
    ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rep_x") < F.col("rep_y")))
    out = None
    for small, large in ((rare.where("index and outside"), rare), (rare.where("index and not outside"), rare.where("outside"))):
        x, y = side(small, "x"), side(large, "y")
        pairs = x.join(y, (x["g"] == y["g"]) & (F.col("of_x") != F.col("of_y")) & ordered & fits)
        pairs = pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def with_bucket(rows: DataFrame, buckets: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``buckets`` on band and key; those of ``hot`` buckets by broadcast.

    hot: band and key of at most SHARE buckets a band, so its size is bounded.
    """
    key = ["band", "key"]
    few = F.broadcast(buckets.join(F.broadcast(hot), key, "left_semi"))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(buckets.join(F.broadcast(hot), key, "left_anti"), key)
    return rest.unionByName(rows.join(few, key))


def near_duplicates(docs: DataFrame, alike: float = ALIKE, small: int = SMALL, weighted: bool = False, share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, rep_id, class_id, kept, tie (hash of the text).

    rep_id: the smallest doc_id with the same words in the same order. class_id: the smallest
    doc_id reachable over links of similarity ``alike`` or more. kept: this row is that document;
    of rows that repeat both id and words, all are. Texts without a word, null ones too, link with
    nothing; rows without an id are kept and have no class. Texts of any length count whole; an
    empty table gives no rows. Other columns are not read, whatever their names. weighted: candidates
    are found by shingles that weigh as often as they stand in a text; links always are those of
    the shingle sets.

    Of a bucket of at most ``small`` different texts all pairs are verified. In a larger one each
    member is first verified against a few hubs of its bucket; then the pairs of members
    that are not yet in one component and share a rare shingle, as any link must, are verified. So
    no link that joins two components is lost, and the pairs inside a large group of near copies
    are never listed.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    signed = scratch.table(signed_documents(docs, weighted), "signatures")
    sound = signed.where("doc_id is not null and size > 0")
    # copies have the same bands, so only the smallest id has to be found
    reps = sound.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tie")).alias("r"), F.first("bands").alias("bands")).select("h1", "h2", F.col("r.doc_id").alias("rep"), F.col("r.tie").alias("tie"), "bands")
    keys = scratch.table(reps.select("rep", F.posexplode("bands").alias("band", "key")), "bands")
    hubs = F.array(F.min("rep"), F.max("rep"), *[F.min_by("rep", F.xxhash64(F.lit(k), "rep")) for k in range(2)])
    buckets = scratch.table(keys.groupBy("band", "key").agg(F.count("*").alias("members"), hubs.alias("hubs")).where("members > 1"), "hubs")
    least = keys.count() // (REGISTERS // BAND) // share
    hot = buckets.where((F.col("members") > small) & (F.col("members") > least)).select("band", "key")
    inside = scratch.table(with_bucket(keys, buckets, hot).select("band", "key", "rep", "members", "hubs"), "buckets")
    wanted = inside.select(F.col("rep").alias("doc_id")).distinct().join(reps.select(F.col("rep").alias("doc_id"), "tie"), "doc_id")
    lists = scratch.table(shingle_lists(_rows(docs).join(wanted, ["doc_id", "tie"], "left_semi")).dropDuplicates(["doc_id"]), "shingles")

    few = inside.where(F.col("members") <= small)
    all_pairs = few.select("band", "key", F.col("rep").alias("a")).join(few.select("band", "key", F.col("rep").alias("b")), ["band", "key"]).where("a < b").select("a", "b")
    hub = inside.where(F.col("members") > small).select("rep", F.explode("hubs").alias("hub")).where("rep <> hub")
    to_hubs = hub.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    tried = scratch.table(all_pairs.unionByName(to_hubs).distinct(), "pairs")
    links = scratch.table(verified(tried, lists, alike), "links")
    whole = scratch.table(components(links), "components")

    large = scratch.table(inside.where(F.col("members") > small).join(whole, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("of")), "large-buckets")
    parts = large.groupBy("band", "key", "of").agg(F.count("*").alias("n"))
    split = scratch.table(parts.groupBy("band", "key").agg(F.count("*").alias("components"), F.max_by("of", F.struct("n", "of")).alias("largest")).where("components > 1"), "split-buckets")
    open_ = scratch.table(with_bucket(large, split, hot).select("band", "key", "rep", "of", (F.col("of") != F.col("largest")).alias("outside")), "open-buckets")
    if not open_.isEmpty():
        rest = sharing_rare(open_.groupBy("rep").agg(F.max("outside").alias("outside"), F.min("of").alias("of")), lists, alike).join(tried, ["a", "b"], "left_anti")
        more = scratch.table(verified(rest, lists, alike), "links")
        links = links.unionByName(more)
        whole = scratch.table(components(links), "components")

    known = reps.select("h1", "h2", "rep").join(whole, F.col("rep") == F.col("node"), "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("class_id"))
    of_class = signed.join(known, ["h1", "h2"], "left")
    mine = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    class_id = F.when(mine, F.col("class_id")).otherwise(F.col("doc_id"))
    return of_class.select("doc_id", F.when(mine, F.col("rep")).otherwise(F.col("doc_id")).alias("rep_id"), class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"), "tie")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns, whatever their names.

    Rows that repeat id and text stay or go together; null ids and texts without a word stay. An
    empty table stays empty.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id", "tie").distinct().alias("gone")
    tie = F.xxhash64(F.coalesce(F.col("docs.text").cast("string"), F.lit("")))
    return docs.alias("docs").join(gone, (F.col("docs.doc_id").cast("long") == F.col("gone.doc_id")) & (tie == F.col("gone.tie")), "left_anti")


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: class of near copies by doc_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tie")
