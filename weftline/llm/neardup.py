"""Records that share most of their terms, found by tiled bit comparison.

Records with the same terms are one class and are compared once. Every class gets a sketch:
each term flips one of 256 bits. Two sketches then differ in at most as many bits as the
two records differ in terms, so a similarity threshold becomes a radius on the exclusive-or's
bit count, and no pair above the threshold is ever lost. Sketches are compared in tiles
with numpy; tile pairs whose term counts lie so far apart that the radius cannot be met are
skipped. Survivors are compared exactly, term by term.

To keep the number of tiles from growing with the square of the collection, classes only meet
in tiles that belong to one of their rarest terms: two records with ``t`` of their terms in
common share at least one of the first ``n - ceil(t n) + 1`` terms of any fixed order of all
terms, here the rarest first. That is exact as well; there is no cap on terms, tiles, partners
or candidates. The classes of a term are sorted by term and size over all partitions at once, so a
frequent term's lie in as many partitions and tiles as they need; most terms have one tile, which is
compared where it was sorted. Only terms of several tiles write them, to compare them with each other: T tiles
of one term are read T times each, at most, and less where their sizes lie apart. With prefixes rarest
first such terms are those that nearly all records have in their prefix, as in collections of very short records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.groups import connected_groups
from weftline.operators.frequent import frequent_share, join_counted
from weftline.session import cut, drop, parallelism, ship

#: At most so many terms are ordered by their counts; the others are rarer than all of these
#: and ordered by hash. Any fixed order is exact, so this bounds the broadcast and nothing else.
FREQUENT_TERMS = 65_536
TILE = 4_096
BITS = 256


@dataclass(frozen=True)
class Threshold:
    """A least share of terms in common, as a fraction of whole numbers."""

    num: int = 7
    den: int = 10

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (n * self.num + self.den - 1) // self.den + 1

    def radius(self, both: np.ndarray) -> np.ndarray:
        """Most terms in which two records of so many terms together can differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def longest(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num

    def met(self, common: Column, both: Column) -> Column:
        return common * self.den >= (both - common) * self.num


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: (id, class_id) of every record with terms. ``pairs``: (class_a, class_b,
    similarity) of different classes, ``class_a < class_b``. Ids of classes are their least member."""

    members: DataFrame
    pairs: DataFrame


def near_duplicates(records: DataFrame, id_column: str, terms_column: str, threshold: Threshold = Threshold(), tile: int = TILE) -> NearDuplicates:
    """All pairs of records of which at least the threshold's share of distinct terms is common.

    ``id_column`` is an integer and unique; ``terms_column`` an array of strings. Repeated terms,
    their order, null terms and empty terms don't count. Records without terms (null, empty)
    are in neither result. Records with equal terms share a class, however many they are; pairs
    are between classes. Further columns are not read. An empty table gives empty results.
    """
    ship(records.sparkSession)
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(terms_column), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))))
    docs = records.select(F.col(id_column).cast("long").alias("id"), clean.alias("terms")).filter(F.size("terms") > 0)
    # The terms are known by a digest of 256 bits; they themselves go on only once for each class.
    docs = cut(docs.select("id", F.unhex(F.sha2(F.to_json("terms"), 256)).alias("key"), "terms"))
    classes = cut(docs.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    members = cut(join_counted(docs.select("id", "key"), classes, "key", "n", ["class_id"]).select("id", "class_id"))
    sets = docs.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi").select(F.col("id").alias("class_id"), "terms")
    sets = cut(sets)
    drop(docs, classes)
    entries = cut(_entries(sets, threshold))
    tiles = cut(_tiles(entries, threshold, tile))
    drop(entries)
    near = cut(_compare(tiles, threshold))
    drop(tiles)
    left = sets.select(F.col("class_id").alias("class_a"), F.col("terms").alias("a"))
    right = sets.select(F.col("class_id").alias("class_b"), F.col("terms").alias("b"))
    exact = near.join(left, "class_a").join(right, "class_b")
    common, both = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    exact = exact.withColumn("common", common).withColumn("both", both).filter(threshold.met(F.col("common"), F.col("both")))
    pairs = cut(exact.select("class_a", "class_b", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity")))
    drop(near, sets)
    return NearDuplicates(members, pairs)


def _entries(sets: DataFrame, threshold: Threshold) -> DataFrame:
    """(token, class_id, n, sketch) for each of a class's first terms in the common order."""
    spark = sets.sparkSession
    hashed = sets.select("class_id", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"))
    counted = hashed.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    total = sets.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    # No more than FREQUENT_TERMS rows can reach this count.
    rows = counted.filter(F.col("df") >= max(2, frequent_share(FREQUENT_TERMS, total))).collect()
    rows.sort(key=lambda r: r["h"])
    known = spark.sparkContext.broadcast((np.array([r["h"] for r in rows], np.int64), np.array([r["df"] for r in rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _prefixes_and_sketches(batch, *known.value, threshold)

    return hashed.mapInArrow(run, "token long, class_id long, n int, sketch binary")


def _prefixes_and_sketches(batch: pa.RecordBatch, known: np.ndarray, counts: np.ndarray, threshold: Threshold) -> pa.RecordBatch:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    df = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        df = np.where(known[at] == h, counts[at], 0)
    order = np.lexsort((h, df, row))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    first = order[rank < np.repeat(threshold.prefix(n), n)]
    bit = (h.view(np.uint64) >> np.uint64(17)).astype(np.int64) % BITS
    flips = np.bincount(row * BITS + bit, minlength=len(n) * BITS) & 1
    sketches = np.packbits(flips.astype(np.uint8).reshape(len(n), BITS), axis=1)
    of = row[first]
    width = BITS // 8
    taken = np.ascontiguousarray(sketches[of])
    binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((np.arange(len(of) + 1) * width).astype(np.int32)), pa.py_buffer(taken)])
    return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(ids[of].astype(np.int64)), pa.array(n[of].astype(np.int32)), binary], names=["token", "class_id", "n", "sketch"])


TILES = "class_a long, class_b long, token long, piece long, low int, high int, ids array<long>, sizes array<int>, sketches binary"


def _tiles(entries: DataFrame, threshold: Threshold, tile: int) -> DataFrame:
    """Pairs (class_a, class_b) within the radius inside one tile; and tiles (token, piece, low, high, ids, sizes, sketches) that
    other tiles of the same token may follow or precede: those of tokens with more than ``tile`` entries in a
    partition, and those at the edge of a partition. Pieces of a token are in order of size."""
    ordered = entries.repartitionByRange(parallelism(entries), "token", "n", "class_id").sortWithinPartitions("token", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rest, begun = TaskContext.get().partitionId(), 0, None, None
        first = True  # the token that the partition begins with may have entries in the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _columns(batch)
            rows = rows if rest is None else tuple(np.concatenate(c) for c in zip(rest, rows))
            token = rows[0]
            last = int(np.searchsorted(token, token[-1]))  # where the last token, which may go on, begins
            bounds = _cut_points(token[:last], tile)
            while len(token) - last >= 2 * tile:  # a whole tile of it is there, and more
                bounds.append(last + tile)
                last += tile
                begun = token[-1]
            if len(bounds) > 1 or bounds[-1]:
                done = tuple(c[: bounds[-1]] for c in rows)
                out, made = _compared(done, bounds, threshold, part, made, first, begun)
                yield from out
                first = first and token[bounds[-1] - 1] == token[-1] == token[0]
            rest = tuple(c[bounds[-1] :] for c in rows)
        if rest is not None:
            # The token that the partition ends with may go on in the next one.
            out, made = _compared(rest, _cut_points(rest[0], tile), threshold, part, made, first, rest[0][-1])
            yield from out

    return ordered.mapInArrow(run, TILES)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Token, id, size and sketch words."""
    token, ids, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    return token, ids, n, _words(batch.column(3))


def _words(sketches: pa.Array) -> np.ndarray:
    if not len(sketches):
        return np.empty((0, BITS // 64), np.uint64)
    first = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset]
    return np.frombuffer(sketches.buffers()[2], np.uint8)[first : first + len(sketches) * (BITS // 8)].view(np.uint64).reshape(len(sketches), BITS // 64)


def _cut_points(token: np.ndarray, tile: int) -> list[int]:
    """Where tiles end: at the end of each token, and after ``tile`` rows of one. Begins with 0."""
    if not len(token):
        return [0]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(starts, len(token)))
    if (lengths <= tile).all():
        return [0, *(starts + lengths).tolist()]
    return [0, *[int(s + min(k, n)) for s, n in zip(starts, lengths) for k in range(tile, n + tile, tile)]]


def _compared(rows: tuple, bounds: list[int], threshold: Threshold, part: int, made: int, first: bool, open_token) -> tuple[list[pa.RecordBatch], int]:
    """The pairs of all tiles, and the tiles that may have to meet others."""
    token, ids, n, words = rows
    ends = np.array(bounds[1:])
    begins = np.array(bounds[:-1])
    of = token[begins]
    several = np.concatenate([[False], of[1:] == of[:-1]]) | np.concatenate([of[1:] == of[:-1], [False]])
    if open_token is not None:
        several |= of == open_token
    if first:
        several |= of == token[0]
    sizes = ends - begins
    x, y = _within((np.repeat(np.arange(len(sizes)), sizes), ids, n, words), threshold)
    empty = lambda t, k: pa.nulls(k, t)
    schema = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64()), ("token", pa.int64()), ("piece", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sketches", pa.binary())])
    out = []
    if len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        near = np.unique(np.stack([low, high]), axis=1)
        out.append(pa.RecordBatch.from_arrays([pa.array(near[0]), pa.array(near[1]), *[empty(f.type, near.shape[1]) for f in schema][2:]], schema=schema))
    for i in np.flatnonzero(several):
        a, b = begins[i], ends[i]
        values = [None, None, int(of[i]), (part << 32) + made, int(n[a]), int(n[b - 1]), ids[a:b], n[a:b].astype(np.int32), words[a:b].tobytes()]
        out.append(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema))
        made += 1
    return out, made


def _compare(tiles: DataFrame, threshold: Threshold) -> DataFrame:
    """(class_a, class_b), distinct: all pairs within and between tiles of a token whose sketches
    lie within the radius."""
    split = tiles.filter("piece IS NOT NULL")
    names = split.select("token", "piece", "low", "high")
    other = names.select("token", F.col("piece").alias("piece_b"), F.col("low").alias("low_b"))
    # Pieces are in order of size. Where the smallest of one is too large for the largest of another, the pair is skipped.
    meet = names.join(other, "token").filter(F.col("piece_b") > F.col("piece")).filter(F.col("low_b") * threshold.num <= F.col("high") * threshold.den)
    columns = ["ids", "sizes", "sketches"]
    pairs = meet.select("piece", "piece_b").join(split.select("piece", *columns), "piece")
    pairs = pairs.join(split.select(F.col("piece").alias("piece_b"), *[F.col(c).alias(f"{c}_b") for c in columns]), "piece_b").select(*columns, *[f"{c}_b" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = _between(_unpack(batch, i, 0), _unpack(batch, i, 3), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["class_a", "class_b"])

    between = pairs.mapInArrow(run, "class_a long, class_b long")
    return tiles.filter("class_a IS NOT NULL").select("class_a", "class_b").unionByName(between).filter("class_a != class_b").distinct()


def _unpack(batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Id, size and sketch words of a tile, which is in order of size."""
    ids, n = (batch.column(at + k).slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    words = np.frombuffer(batch.column(at + 2)[row].as_py(), np.uint64).reshape(len(ids), BITS // 64)
    return np.zeros(len(ids), np.int64), ids, n, words


def _within(rows, threshold: Threshold, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within tiles. Rows are in order of tile and size, so the partners of a row that are
    not too large follow it without a gap."""
    tile, ids, n, words = rows
    span = int(n.max()) * 2 + 2 if len(n) else 1
    key = tile * span + n
    last = np.searchsorted(key, tile * span + np.minimum(threshold.longest(n), span - 1), side="right")
    partners = last - np.arange(len(n)) - 1
    ends = np.cumsum(partners)
    out_a, out_b, at = [], [], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
        p = partners[at:to]
        a = np.repeat(np.arange(at, to), p)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(p) - p, p)
        apart = np.zeros(len(a), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[a, w] ^ words[b, w])
        close = apart <= threshold.radius(n[a] + n[b])
        out_a.append(ids[a[close]])
        out_b.append(ids[b[close]])
        at = to
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2


def _between(rows_a, rows_b, threshold: Threshold, side: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between two tiles, in squares small enough for the processor's cache."""
    (_, ids_a, n_a, words_a), (_, ids_b, n_b, words_b) = rows_a, rows_b
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(ids_a), side):
        na, wa = n_a[i : i + side], words_a[i : i + side]
        for j in range(0, len(ids_b), side):
            nb, wb = n_b[j : j + side], words_b[j : j + side]
            if nb[0] > threshold.longest(na[-1]) or na[0] > threshold.longest(nb[-1]):
                continue
            apart = np.zeros((len(na), len(nb)), np.uint16)
            for w in range(wa.shape[1]):
                apart += np.bitwise_count(wa[:, w, None] ^ wb[None, :, w])
            x, y = np.nonzero(apart <= threshold.radius(na[:, None] + nb[None, :]))
            out_a.append(ids_a[i + x])
            out_b.append(ids_b[j + y])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicate_groups(found: NearDuplicates) -> DataFrame:
    """One row for each record with terms: ``id``, ``class_id``, ``n_links`` (records it is near to,
    those of its own class included) and ``group_id``, the least class linked to it directly or
    through others."""
    sizes = found.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    pairs = cut(found.pairs.select("class_a", "class_b"))
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    links = both.join(sizes.withColumnRenamed("class_id", "class_b"), "class_b").groupBy("class_a").agg(F.sum("size").alias("others"))
    groups = connected_groups(pairs, "class_a", "class_b")
    classes = sizes.join(links.withColumnRenamed("class_a", "class_id"), "class_id", "left").join(groups.withColumnRenamed("record_id", "class_id"), "class_id", "left")
    classes = classes.select("class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    return found.members.join(classes, "class_id").select("id", "class_id", "n_links", "group_id")
