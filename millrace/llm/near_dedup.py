"""MinHash near-dedup with bottom-k sketches.

A document is the set of its 5-word shingles, each a 64-bit hash by one
function. Its sketch is the K smallest hashes.

1. Documents of one set are one class; only its least doc_id goes on.
2. Inverted lists: the sketch values that two classes or more retain. Of two
   documents with similarity 0.75 or more, the union's sketch has so many
   values in both that, Z standard deviations of the draw below the mean, each
   must share at least `needed` of its own; for small sets this is exact.
   Classes that share fewer go. Of the others' values, ordered from the rarest
   list to the longest, all but `needed` - 1 suffice for any two such documents
   to meet in a list, which leaves out the long lists of common passages. A
   list of more than LONG is spread over several tasks by salt.
3. Each list is handed to its hub, the member whose values are most common.
   Lists of the same group of copies have the same hub, so a group comes
   together once and not once a value. Nobody pairs up a hub's members as rows:
   they are dealt to blocks of bounded size, in members and in bytes, and each block's
   task counts shared sketch values for all its pairs at once. For the pairs that share
   enough it estimates the similarity from the union's sketch, the K least
   values of both sketches together, and confirms on full sets those whose
   estimate is within Z deviations of the limit. It returns a forest of the links, so a
   block gives fewer links than it has members.
4. A hub with several blocks gets a second turn. A member with more than a
   quarter of its full set in no other member's is linked with none and goes; a
   count of each hub's shingles tells. Of the rest, members that are not yet
   linked with the hub are held against all, block by block. Those that
   are linked with it need not be held against each other.
5. Links become components; every member of a class has its class's.

Every pair that meets in a list is settled, whatever the lengths of lists and
groups, so a link is lost only if fewer values are shared than Z standard
deviations allow for: about one in 10^10 of those right at 0.75, and far fewer above.

Defined results: a null text has no words; documents without words have
n_shingles 0, are linked with nothing and kept. Fewer than five words are one
shingle. Rows of one doc_id are one document; where their texts differ it is
linked with whatever any of them is. Null ids stand for no document: such a row
gets the component of its text's other documents, or null. deduplicate keeps one
row a component: with the component's id, and of several the one with the
largest text digest and other columns, written as JSON; of rows without an id whose text no
document has, one a shingle set. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, Scratch, documents, map_rows, numbered, texts
from .graph import components

SHINGLE, PERCENT, K, Z = 5, 75, 128, 6.5
#: A block's members, the bytes of their sets, about, and the members of a list that go to one task.
BLOCK, BLOCK_BYTES, LONG = 512, 8 << 20, 1024
#: Columns of a task's matrices, and pairs that are estimated, at once.
COLUMNS, PAIRS = 4096, 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


@lru_cache(maxsize=1)
def _word_hashes() -> Kept:
    return Kept(xxhash.xxh3_64_intdigest, 60_000, 64)


def shingle_set(text: str) -> np.ndarray:
    """The set's hashes in rising order, unsigned."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    of = _word_hashes()
    w = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : i + n]) * _M1
        h ^= h >> np.uint64(32)
    h ^= h >> np.uint64(33)  # a second round of mixing, as the order of hashes has to be random
    h *= _M2
    h ^= h >> np.uint64(33)
    h *= _M3
    h ^= h >> np.uint64(33)
    return np.unique(h)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text_key (of rows without an id), n (set size), digest of the set (null if empty) and its sketch."""

    def start():
        def batch(ids, rows, keys):
            sets = [shingle_set(t) for t in rows]
            return {
                "doc_id": ids,
                "text_key": keys,
                "n": [len(s) for s in sets],
                "digest": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sketch": [s[:k].view(np.int64) for s in sets],
            }

        return batch

    rows = texts(docs)
    return map_rows(rows.withColumn("text_key", F.when(F.col("doc_id").isNull(), _key(F.col("text")))), "doc_id long, text_key binary, n long, digest binary, sketch array<long>", start)


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def needed(n, k: int = K, percent: int = PERCENT, z: float = Z):
    """Sketch values that a set of n shares with any other that is similar enough; n a number, an array or a Column.

    The union has at most n / j members, of which the sketch draws k without
    replacement; at least j of them are shared.
    """
    j = percent / 100
    if isinstance(n, (int, float, np.ndarray)):
        spread = np.sqrt(j * (1 - j) * k * np.maximum(0.0, 1 - j * k / np.maximum(n, 1)))
        return np.maximum(1, np.ceil(j * np.minimum(n, k) - z * spread - 1e-9)).astype(int)
    spread = F.sqrt(F.greatest(F.lit(0.0), 1 - F.lit(j * k) / n) * (j * (1 - j) * k))
    return F.greatest(F.lit(1), F.ceil(F.least(n, F.lit(k)) * j - spread * z - 1e-9)).cast("int")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in a with each in b, by products of 0-1 matrices, COLUMNS values at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(va, vb)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))

    def where(v, rows):
        at = np.searchsorted(common, v)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == v[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    (ca, ra), (cb, rb) = where(va, ra), where(vb, rb)
    for low in range(0, len(common), COLUMNS):
        high = min(low + COLUMNS, len(common))
        parts = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            s, e = np.searchsorted(c, (low, high))
            m = np.zeros((n, high - low), np.float32)
            m[r[s:e], c[s:e] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _estimated(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, k: int, percent: int, z: float) -> np.ndarray:
    """For pairs of complete sets' sketches: whether the union's sketch, the k least of both together, allows for the similarity.

    Sketches are of k values; the last slot is filled up with the largest number.
    """
    out = np.zeros(len(rows), bool)
    full = np.uint64(2**64 - 1)
    pad = [np.stack([np.concatenate([s, np.full(k - len(s), full)]) for s in x]) for x in (a, b)]
    for low in range(0, len(rows), PAIRS):
        r, c = rows[low : low + PAIRS], cols[low : low + PAIRS]
        both = np.sort(np.concatenate([pad[0][r], pad[1][c]], axis=1), axis=1)
        real = both != full
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        place = np.cumsum(real & ~again, axis=1)  # of each value among the union's
        shared, drawn = (again & (place <= k)).sum(1), np.minimum(place[:, -1], k)
        size = np.array([len(a[i]) for i in r]) + np.array([len(b[i]) for i in c])
        j = percent / 100
        # Where a sketch is full its set may be larger, so the draw's spread counts; else the sketches are the sets.
        spread = np.where(size >= k, np.sqrt(j * (1 - j) * drawn), 0.0)
        out[low : low + PAIRS] = shared >= j * drawn - z * spread - 1e-9
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], k: int = K, percent: int = PERCENT, z: float = Z) -> np.ndarray:
    """Which sets of a are similar enough to which of b: the union sketch's estimate first, full sets for what passes."""
    na, nb = (np.array([len(s) for s in x]) for x in (a, b))
    likely = _shared([s[:k] for s in a], [s[:k] for s in b]) >= np.maximum(needed(na, k, percent, z)[:, None], needed(nb, k, percent, z)[None, :])
    likely &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    at = np.nonzero(likely)
    likely[at] = _estimated([s[:k] for s in a], [s[:k] for s in b], *at, k, percent, z)
    rows, cols = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
    out = np.zeros((len(a), len(b)), bool)
    if len(rows):
        both = _shared([a[i] for i in rows], [b[i] for i in cols])
        union = na[rows][:, None] + nb[cols][None, :] - both
        out[np.ix_(rows, cols)] = (100 * both >= percent * union) & likely[np.ix_(rows, cols)]
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """The least member of each one's component, from a symmetric matrix of links."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] >= 0:
            continue
        seen = np.zeros(len(links), bool)
        new = seen.copy()
        new[i] = True
        while new.any():
            seen |= new
            new = links[new].any(0) & ~seen
        root[seen] = i
    return root


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(zero_copy_only=False).view(np.uint64), chunk.offsets.to_numpy()
        out += [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _first_turn(table: pa.Table) -> pa.Table:
    """One block with its hub: links to each component's least member."""
    table = table.sort_by("member")
    sets, ids = _sets(table["set"]), table["member"].to_numpy()
    root = forest(linked(sets, sets)) if len(sets) > 1 else np.zeros(1, int)
    apart = ids[root] != ids
    return pa.Table.from_arrays([pa.array(ids[apart]), pa.array(ids[root][apart])], schema=_LINKS)


def _second_turn(table: pa.Table) -> pa.Table:
    """One block of members apart from their hub (left) and one of any members."""
    left = table["left"].to_numpy()
    sets, ids = _sets(table["set"]), table["member"].to_numpy()
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(a) or not len(b):
        return _LINKS.empty_table()
    links = np.zeros((len(ids), len(ids)), bool)
    links[np.ix_(a, b)] = linked([sets[i] for i in a], [sets[i] for i in b])
    order = np.argsort(ids, kind="stable")
    links = (links | links.T)[np.ix_(order, order)]
    ids = ids[order]
    root = forest(links)
    apart = ids[root] != ids
    return pa.Table.from_arrays([pa.array(ids[apart]), pa.array(ids[root][apart])], schema=_LINKS)


def stars(reps: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """hub, member and the member's n, the hub one of them: any two similar classes are members of one hub. reps: rep, n, sketch."""
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    # Written, so that the join reads both sides as they are shuffled and its large partitions can be split.
    often = scratch.cut(values.groupBy(F.col("v").alias("v2")).agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = values.join(often, F.col("v") == F.col("v2")).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("pop"))
    left = shared.withColumn("needed", needed(F.col("n"), k)).where("size(vs) >= needed").select("rep", "n", "pop", F.slice("vs", F.lit(1), F.size("vs") - F.col("needed") + 1).alias("vs"))
    left = scratch.cut(left)
    scratch.drop(often)
    parts = F.ceil(F.col("df") / LONG).cast("int")
    lists = left.select("rep", "n", "pop", F.inline("vs"))
    hubs = lists.groupBy(F.col("v").alias("v2")).agg(F.max(F.struct("pop", "rep"))["rep"].alias("hub"), F.count(F.lit(1)).alias("members"), F.max("df").alias("df")).where("members > 1")
    hubs = hubs.select("v2", "hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt2"))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    out = scratch.cut(salted.join(hubs, (F.col("v") == F.col("v2")) & (F.col("salt") == F.col("salt2"))).select("hub", F.col("rep").alias("member"), "n").distinct())
    scratch.drop(left)
    return out


def _partnered(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of hubs with members left whose sets, but for what no other member of the hub has, are large enough for a link."""
    waiting = marked.where("left").select(F.col("hub").alias("hub2")).distinct()
    rows = marked.join(waiting, F.col("hub") == F.col("hub2"), "left_semi")
    values = rows.join(sets, F.col("member") == F.col("id")).select("hub", "member", F.explode("set").alias("v"))
    # Counts and minima combine before they are shuffled, so a value that all of a hub's members have is a row a task.
    own = values.groupBy("hub", "v").agg(F.count(F.lit(1)).alias("having"), F.min("member").alias("member")).where("having = 1")
    own = own.groupBy(F.col("hub").alias("hub2"), F.col("member").alias("member2")).agg(F.count(F.lit(1)).alias("own"))
    rows = rows.join(own, (F.col("hub") == F.col("hub2")) & (F.col("member") == F.col("member2")), "left")
    return rows.where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= PERCENT * F.col("n")).select("hub", "member", "n", "left")


def links(docs: DataFrame, reps: DataFrame, scratch: Scratch, k: int = K, block: int = BLOCK) -> DataFrame:
    """Links a, b between classes, enough of them to join all that are similar."""
    star = stars(reps, scratch, k)
    members = star.select("member").distinct()

    def start():
        return lambda ids, rows: {"id": ids, "set": [shingle_set(t).view(np.int64) for t in rows]}

    # Both sides are shuffled, as members grow with the documents; ids are hashed, so texts stream past them and aren't sorted.
    rows = texts(docs).join(members.hint("shuffle_hash"), F.col("doc_id") == F.col("member"), "left_semi")
    sets = scratch.cut(map_rows(rows, "id long, set array<long>", start))
    # Blocks; a hub joins each block of its own.
    count = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size * 8 / BLOCK_BYTES)).cast("int")
    sizes = star.groupBy(F.col("hub").alias("hub2")).agg(count(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    dealt = scratch.cut(star.join(sizes, F.col("hub") == F.col("hub2")).select("hub", "member", "n", "blocks", F.when(F.col("hub") == F.col("member"), -1).otherwise(F.pmod(F.xxhash64("member", "hub"), "blocks").cast("int")).alias("block")))
    scratch.drop(star)
    placed = dealt.withColumn("at", F.when(F.col("block") >= 0, F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", "member", F.explode("at").alias("at"))
    first = scratch.cut(placed.join(sets, F.col("member") == F.col("id")).select("hub", "at", "member", "set").groupBy("hub", "at").applyInArrow(lambda t: _first_turn(t.select(["member", "set"])), "a long, b long"))
    # Hubs of several blocks: members that their own block has not joined to the hub.
    big = dealt.where("blocks > 1")
    if big.isEmpty():
        return first
    joined = components(first, scratch)
    with_root = big.join(joined, F.col("member") == F.col("node"), "left").select("hub", "member", "n", F.coalesce("root", "member").alias("root"))
    hub_root = with_root.where("hub = member").select(F.col("hub").alias("hub2"), F.col("root").alias("hub_root"))
    marked = scratch.cut(with_root.join(hub_root, F.col("hub") == F.col("hub2")).select("hub", "member", "n", (F.col("root") != F.col("hub_root")).alias("left")))
    kept = scratch.cut(_partnered(marked, sets))
    scratch.drop(marked)
    counts = kept.groupBy(F.col("hub").alias("hub2")).agg(count(F.count_if("left"), F.sum(F.when(F.col("left"), F.col("n")).otherwise(0))).alias("rows"), count(F.count(F.lit(1)), F.sum("n")).alias("cols")).where("rows > 0")
    spread = kept.join(counts, F.col("hub") == F.col("hub2")).withColumns({"r": F.pmod(F.xxhash64("member", "hub"), "rows").cast("int"), "c": F.pmod(F.xxhash64("hub", "member"), "cols").cast("int")})
    as_row = spread.where("left").select("hub", "member", F.lit(True).alias("left"), "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    as_col = spread.select("hub", "member", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "c")
    pairs = as_row.unionByName(as_col).join(sets, F.col("member") == F.col("id")).select("hub", "r", "c", "member", "left", "set")
    second = pairs.groupBy("hub", "r", "c").applyInArrow(lambda t: _second_turn(t.select(["member", "left", "set"])), "a long, b long")
    return scratch.cut(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))


def _judged(docs: DataFrame, scratch: Scratch, k: int, block: int) -> DataFrame:
    """doc_id, text_key, n, digest of the set and component_id of every row."""
    rows = scratch.cut(sketches(docs, k))
    full = rows.where("digest IS NOT NULL")
    # A null id never stands for its class while there is another.
    one = full.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "sketch")).alias("r"))
    reps = scratch.cut(one.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch")))
    near = links(docs, reps.where("rep IS NOT NULL"), scratch, k, block)
    # Texts of one doc_id.
    several = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    texts_of = full.join(several, "doc_id", "left_semi").select("doc_id", "digest").join(reps.select(F.col("digest").alias("d2"), "rep"), F.col("digest") == F.col("d2"))
    found = components(near.union(texts_of.select("doc_id", "rep")), scratch)
    classes = reps.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("digest2"), F.coalesce("root", "rep").alias("component_id"))
    out = full.join(classes, F.col("digest") == F.col("digest2")).select("doc_id", "text_key", "n", "digest", "component_id")
    return out.unionByName(rows.where("digest IS NULL").select("doc_id", "text_key", "n", "digest", F.col("doc_id").alias("component_id")))


def near_dedup(docs: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """Every row's component: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    out = _judged(docs, scratch, k, block)
    return scratch.result(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def deduplicate(docs: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """One row of docs for each component, with all its columns."""
    scratch = Scratch(docs.sparkSession, "near")
    judged = scratch.cut(_judged(docs, scratch, k, block).where("doc_id = component_id OR (doc_id IS NULL AND component_id IS NULL)"))
    named_ones = judged.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("stays")).distinct()
    others = judged.where("doc_id IS NULL").groupBy(F.coalesce("digest", "text_key").alias("class")).agg(F.min("text_key").alias("stays"))
    rows, named = numbered(docs)
    text = F.coalesce(named["text"], F.lit(""))
    row = F.struct(*rows.columns)
    order = F.struct(_key(text).alias("text"), F.to_json(F.struct(*[c for i, c in enumerate(rows.columns) if docs.columns[i] != "text"])).alias("rest"))
    one = lambda df, by: df.groupBy(by.alias("by")).agg(F.max_by(row, order).alias("row")).select("row.*")
    out = one(rows.join(named_ones.hint("merge"), named["doc_id"] == F.col("stays"), "left_semi"), named["doc_id"])
    nameless = rows.where(named["doc_id"].isNull()).withColumn("key", _key(text)).join(others, F.col("key") == F.col("stays"), "left_semi")
    return scratch.result(out.union(one(nameless, F.col("key"))).toDF(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


#: Exact, by pairs that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rep AS node, rep AS root FROM classes
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN roots r ON r.node = c.rep
"""
