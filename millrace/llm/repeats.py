"""Repeated passages by a sparse suffix array.

A passage repeats if a run of LEAST words stands at two places of the corpus, in
two documents of different text or in one. Suffixes are kept only at minimiser
positions: of every SPAN consecutive positions the one whose next PREFIX words
have the least hash. The choice depends on content alone and LEAST = PREFIX +
SPAN - 1, so each run of LEAST words has its own suffix, and equal runs have equal
ones, at the same distance from their start.

1. Documents of one text are one class, and repeat as a whole if it has LEAST
   words; one of them goes on. Classes are known by the text's SHA-256.
2. A count of the kept suffixes by the hash of their first PREFIX words drops
   those that have no equal, which is most, before any words move.
3. The others come with the words around them, as far as their runs reach. They
   are range-sorted by their words and neighbours are compared: those that agree
   in PREFIX words or more stand side by side as a group.
4. Within a group matches are extended left and right, word by word: a run that
   reaches `a` words to the left of its suffix repeats if another member agrees
   in those words and in what is left of LEAST to the right. All are settled, not
   only those of next neighbours, since one neighbour may agree further to the
   left and another further to the right.
5. A suffix of more than HOT equals, as of a passage in very many documents,
   isn't gathered. Members with the same words around them, as inside of a common
   passage, are first merged to one context, on the map side too. The contexts' runs,
   as 128-bit BLAKE2 digests of their words, are counted, and the counts joined
   back to the contexts and those to the members; Spark splits large partitions.

What meets in a task is a group of HOT members at most, or what one document has.

Result: a row for each document with a passage: doc_id, n_words, n_spans,
repeat_chars, spans ("start:end,...", code points, end exclusive), drop_spans
(those of which an earlier document has the run too, or which are behind the
run's first place in their own document and don't overlap it) and copies
(documents with the same text, itself included). Earlier is what has the lesser
doc_id, null last; a class counts by its least.

Defined results: null and empty texts, and those of fewer than LEAST words,
have no passage and no row. Rows that repeat a doc_id and its text are copies
like any other; of several texts of one doc_id each is a document of its own. Rows
with a null id are documents like the rest. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, Scratch, documents, map_rows, texts

PREFIX, SPAN = 26, 25
LEAST = PREFIX + SPAN - 1
#: Equal suffixes that one task takes.
HOT = 1000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _word_hashes() -> Kept:
    return Kept(xxhash.xxh3_64_intdigest, 60_000, 64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M1) ^ (b + _M2)
    h ^= h >> np.uint64(32)
    h *= _M2
    return h ^ (h >> np.uint64(29))


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, put together from runs of powers of two."""
    out, done, power, width = None, 0, w, 1
    while True:
        if n & width:
            out = power if out is None else _join(out[: len(out) - width], power[done:]) if len(out) > width else out[:0]
            done += width
        if done == n:
            return out
        power = _join(power[:-width], power[width:]) if len(power) > width else power[:0]
        width *= 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))


def kept_suffixes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the kept suffixes, the hashes of their first PREFIX words, and the first and the number of the runs that each is the suffix of."""
    h = run_hashes(w, PREFIX)
    least = np.lib.stride_tricks.sliding_window_view(h, SPAN).argmin(1) + np.arange(len(h) - SPAN + 1)
    at, first, runs = np.unique(least, return_index=True, return_counts=True)
    return at, h[at], first, runs


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_chars and the hashes of the kept suffixes, for texts of LEAST words or more."""

    def start():
        def batch(ids, rows, digests):
            out = {"doc_id": [], "digest": [], "n_words": [], "n_chars": [], "kept": []}
            for i, text, digest in zip(ids, rows, digests, strict=True):
                words = text.encode().split()
                if len(words) >= LEAST:
                    for name, x in zip(out, (i, digest, len(words), len(text), kept_suffixes(word_hashes(words))[1].view(np.int64)), strict=True):
                        out[name].append(x)
            return out

        return batch

    return map_rows(_digested(docs), "doc_id long, digest binary, n_words long, n_chars long, kept array<long>", start)


def _digested(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


_SEEDS = "digest binary, rep long, cold array<struct<prefix:string,before:string,after:string,places:array<long>>>, hot array<struct<context:binary,runs:array<binary>,places:array<long>,behind:array<boolean>>>"


def _seeds():
    """For map_rows: the suffixes that have equals, with the words that their runs reach, and the runs of the hot ones, which tell their context."""

    def batch(digests, reps, rows, found):
        cold_of, hot_of = [], []
        for text, equal in zip(rows, found, strict=True):
            words = text.encode().split()
            at, h, first, runs = kept_suffixes(word_hashes(words))
            spots = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
            places = (spots[: len(words) - LEAST + 1, 0] << 32) | spots[LEAST - 1 :, 1]
            is_hot = {e["h"]: e["hot"] for e in equal}
            joined = lambda i, j: b" ".join(words[i:j]).decode()  # noqa: E731, B023
            cold, hot, seen = [], [], {}
            for p, key, s, n in zip(at.tolist(), h.view(np.int64).tolist(), first.tolist(), runs.tolist(), strict=True):
                if key not in is_hot:
                    continue
                own = places[s : s + n].tolist()
                if not is_hot[key]:
                    cold.append({"prefix": joined(p, p + PREFIX), "before": joined(s, p), "after": joined(p + PREFIX, s + n - 1 + LEAST), "places": own})
                    continue
                of = [blake2b(b" ".join(words[i : i + LEAST]), digest_size=16).digest() for i in range(s, s + n)]
                ends = [seen.setdefault(run, place) & 0xFFFFFFFF for run, place in zip(of, own, strict=True)]  # of each run's first place
                hot.append({"context": blake2b(b"".join(of), digest_size=16).digest(), "runs": of, "places": own, "behind": [place >> 32 >= end for place, end in zip(own, ends, strict=True)]})
            cold_of.append(cold)
            hot_of.append(hot)
        return {"digest": digests, "rep": reps, "cold": cold_of, "hot": hot_of}

    return batch


Member = tuple[tuple, str, str, list[int]]


def settle(group: list[Member]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Digest, repeated places and places to drop of the members of a group of equal suffixes.

    A member: its document, as (id is null, id, digest), the words before and
    after the suffix and the places of its runs, from the first to the last.
    """
    contexts: dict[tuple[str, str], list[int]] = {}
    for i, (_, before, after, _) in enumerate(group):
        contexts.setdefault((before, after), []).append(i)
    ways: dict[tuple[int, str, str], list[tuple[list[int], int]]] = {}
    for (before, after), members in contexts.items():
        left, right = before.split(), after.split()
        for j in range(len(group[members[0]][3])):
            a = len(left) - j
            ways.setdefault((a, " ".join(left[j:]), " ".join(right[: LEAST - PREFIX - a])), []).append((members, j))
    found: dict[int, tuple[list[int], list[int]]] = {}
    for held in ways.values():
        if len(held) == 1 and len(held[0][0]) == 1:
            continue
        spots = [(group[i][0], group[i][3][j], i) for members, j in held for i in members]
        doc, place, _ = min(spots)
        end = place & 0xFFFFFFFF
        for who, here, i in spots:
            places, drops = found.setdefault(i, ([], []))
            places.append(here)
            if who != doc or here >> 32 >= end:
                drops.append(here)
    for i, (places, drops) in found.items():
        yield group[i][0][2], _packed(places), _packed(drops)


def merged(places: list[int]) -> list[tuple[int, int]]:
    """Spans from packed starts and ends."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        a, b = p >> 32, p & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _packed(places: list[int]) -> list[int]:
    return [a << 32 | b for a, b in merged(places)]


_PLACES = "digest binary, places array<long>, drops array<long>"
_PLACES_ARROW = pa.schema([("digest", pa.binary()), ("places", pa.list_(pa.int64())), ("drops", pa.list_(pa.int64()))])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their prefixes: neighbours that agree form a group, which is settled when the next prefix differs."""
    last, group, out = None, [], []

    def done() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACES_ARROW, strict=True)], schema=_PLACES_ARROW)

    for batch in batches:
        for prefix, digest, rep, before, after, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if prefix != last:
                if len(group) > 1:
                    out.extend(settle(group))
                if len(out) > 2000:
                    yield done()
                last, group = prefix, []
            group.append(((rep is None, rep or 0, digest), before, after, places))
    if len(group) > 1:
        out.extend(settle(group))
    if out:
        yield done()


def _spans():
    def batch(digests, places, drops):
        all_ = [merged(p) for p in places]
        text = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        return {"digest": digests, "n_spans": [len(s) for s in all_], "repeat_chars": [sum(b - a for a, b in s) for s in all_], "spans": [text(s) for s in all_], "drop_spans": [text(merged(d)) for d in drops]}

    return batch


def _settle_hot(each: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, places and drops of members of large groups: digest, rep, context, runs, places, behind."""
    who = F.struct(F.col("rep").isNull().alias("none"), "rep", F.col("digest").alias("by"))
    contexts = scratch.cut(each.groupBy(F.col("context").alias("c2")).agg(F.count(F.lit(1)).alias("n"), F.min(who).alias("who"), F.first("runs").alias("runs")))
    runs = contexts.select("c2", "n", "who", F.posexplode("runs").alias("j", "run"))
    shared = scratch.cut(runs.groupBy(F.col("run").alias("run2")).agg(F.sum("n").alias("total"), F.min("who")["by"].alias("by")).where("total > 1").select("run2", "by"))
    found = scratch.cut(runs.join(shared, F.col("run") == F.col("run2")).groupBy("c2").agg(F.collect_list(F.struct("j", "by")).alias("found")))
    out = each.join(found, F.col("context") == F.col("c2"))
    each_run = F.transform("found", lambda x: F.struct(F.get("places", x["j"]).alias("place"), (F.get("behind", x["j"]) | (x["by"] != F.col("digest"))).alias("drop")))
    return out.select("digest", each_run.alias("of")).select("digest", F.col("of.place").alias("places"), F.filter("of", lambda x: x["drop"])["place"].alias("drops"))


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = scratch.cut(suffixes(docs))
    one = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kept")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.cut(one.select("digest", "copies", F.col("r.doc_id").alias("rep"), F.col("r.kept").alias("kept")))
    twice = scratch.cut(reps.select(F.explode("kept").alias("h2")).groupBy("h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h2", (F.col("n") > hot).alias("hot")))
    kept = reps.select("digest", "rep", F.explode(F.array_distinct("kept")).alias("h"))
    equal = kept.join(twice, F.col("h") == F.col("h2")).groupBy("digest", "rep").agg(F.collect_list(F.struct("h", "hot")).alias("found"))
    # One row a class: by digest and id, so that the copies of a text don't meet; merge, as the classes grow with the documents.
    who = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("who")
    equal = equal.select(F.col("digest").alias("d2"), who(F.col("rep")).alias("who2"), "rep", "found")
    near = _digested(docs).select("digest", "text", who(F.col("doc_id"))).join(equal.hint("merge"), (F.col("digest") == F.col("d2")) & (F.col("who") == F.col("who2")))
    near = near.groupBy("digest", "who").agg(F.first("rep").alias("rep"), F.first("text").alias("text"), F.first("found").alias("found")).select("digest", "rep", "text", "found")
    seeds = scratch.cut(map_rows(near, _SEEDS, _seeds))
    scratch.drop(twice)
    cold = seeds.select("digest", "rep", F.inline("cold")).select("prefix", "digest", "rep", "before", "after", "places")
    cold = cold.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(_neighbours, _PLACES)
    again = _settle_hot(seeds.select("digest", "rep", F.inline("hot")), scratch)
    hits = cold.union(again).groupBy("digest").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("drops")).alias("drops"))
    spans = map_rows(hits, "digest binary, n_spans long, repeat_chars long, spans string, drop_spans string", _spans)
    classes = reps.select("digest", "rep", "copies").join(spans.withColumnRenamed("digest", "d3"), F.col("digest") == F.col("d3"), "left").where("copies > 1 OR n_spans > 0")
    classes = scratch.cut(classes.select(F.col("digest").alias("d4"), "rep", "copies", "n_spans", "repeat_chars", "spans", "drop_spans"))
    scratch.drop(seeds, reps)
    out = rows.select("doc_id", "digest", "n_words", "n_chars").join(classes, F.col("digest") == F.col("d4"))
    copy = F.col("copies") > 1
    whole = F.concat(F.lit("0:"), F.col("n_chars"))
    later = copy & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    return scratch.result(out.select(
        "doc_id", "n_words", F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(copy, F.col("n_chars")).otherwise(F.col("repeat_chars")).alias("repeat_chars"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"), F.when(later, whole).otherwise(F.coalesce("drop_spans", F.lit(""))).alias("drop_spans"), "copies",
    ))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
