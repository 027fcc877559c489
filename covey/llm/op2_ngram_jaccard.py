"""N-gram Jaccard join with count-vector R-trees.

A document's set of word shingles is hashed into groups; the group counts are a
point.  Two sets share at most the sum of the coordinate minima of their points,
and a node of an R-tree (the coordinate maxima below it) bounds all of its
points at once.  Surviving pairs are verified on the sets themselves.

Points of unrelated texts of one length lie close together in every coordinate,
so one R-tree over the corpus would visit most of its leaves for every point.
Therefore the trees are built in shards: two sets with a Jaccard similarity of
at least ``t`` share one of the first ``n - ceil(t n) + 1`` of their ``n``
shingles in any common order, so a shard holds the sets that have one of these
shingles.  The order puts frequent shingles last (by counts in a table of fixed
size), so shared passages and lines make no large shards.  A larger shard is cut
into blocks and every two blocks meet in one task.

1. Equal sets become one class with one representative.
2. Shards; in each, pairs that pass the R-tree's bound, as a spanning forest.
3. Components of these candidates; each is verified exactly, with overlaps
   counted in an inverted index; large ones again in pairs of blocks.  Sets that
   are known to hang together don't meet again, and a task holds the shingles of
   a bounded part of a block at a time.
4. Components of the verified links, carried back to every member.

Only spanning forests leave a task, never all pairs of a group, and no link
between different sets is lost.  Sets are compared by 64-bit shingle hashes.
Nulls, empty texts and texts without words have no shingles and no links; each
keeps its own id as component, a null one if that is null.  Otherwise a
component's id is its smallest id that isn't null.  Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import Forest, components
from ..sources.scratch import stored
from . import _words

#: Entries of the table of shingle counts, which is on the driver and in every task.
SLOTS = 1 << 19
#: Members of a shard, or of a component, that meet at once.
SHARD_BLOCK, TEXT_BLOCK = 1000, 400
#: Trees whose first sets all sets of a component meet before the exact check; shingles of the sets that one part of it holds, and of their meetings at once.
FIRST, AT_ONCE, SPAN = 4, 1 << 20, 1 << 21
#: Compressed bytes of texts that are cut into shingles at once.
TEXT_BYTES = 1 << 18
#: Coordinates of the points that are compared at once.
COORDINATES = 1 << 22
#: Points in a leaf and children of a node; a shard up to a leaf is a tree of one leaf, whose points meet.
LEAF, FANOUT = 16, 16
#: Coordinates of a point: a power of two, about one for this many shingles, so that none exceeds a byte.
SHINGLES_PER_GROUP, LEAST_GROUPS = 16, 32


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    words = _words.split(column, lower=True)
    runs = _words.grams(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(_words.grams(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slot_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in _words.slices(_words.unpacked(batches), "text"):
            sets = shingles(batch.column("text"), size)
            total += np.bincount((np.concatenate(sets) % SLOTS).astype(np.int64), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["slot", "n"])

    return run


def frequency_classes(texts: DataFrame, size: int) -> np.ndarray:
    """For each slot 0, or how many times as frequent as usual its shingles are, as a logarithm."""
    rows = texts.select("text").mapInArrow(_slot_counts(size), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most SLOTS rows
    n = np.zeros(SLOTS)
    n[table["slot"].to_numpy()] = table["n"].to_numpy()
    ratio = n / max(n.mean(), 16)
    return np.where(ratio > 4, np.clip(np.log2(np.maximum(ratio, 1)), 0, 40), 0).astype(np.uint8)


def _point(h: np.ndarray) -> bytes:
    """The group counts of a set, a byte each."""
    mixed, groups = _words.mix(h), max(LEAST_GROUPS, 1 << (len(h) // SHINGLES_PER_GROUP).bit_length())
    while (point := np.bincount((mixed % groups).astype(np.int64), minlength=groups)).max() > 255:
        groups *= 2
    return point.astype(np.uint8).tobytes()


def _points(size: int, threshold: tuple[int, int], classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = classes.value
        for batch in _words.slices(_words.unpacked(batches), "text"):
            rows = []
            for h in shingles(batch.column("text"), size):
                n = len(h)
                if not n:
                    rows.append((0, 0, 0, None, [], []))
                    continue
                own = frequent[(h % np.uint64(len(frequent))).astype(np.int64)]
                order = np.lexsort((h, own))[: n + threshold[0] * n // -threshold[1] + 1]
                key, hot = h[order].view(np.int64), own[order] > 0
                first, second = (int(_words.mix(h ^ np.uint64(salt)).sum().astype(np.int64)) for salt in (1, 2))
                rows.append((n, first, second, _point(h), key[~hot], key[hot]))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "n", "f1", "f2", "point", "keys", "hot_keys"])

    return run


def _folded(raw: list[bytes], rows: np.ndarray, groups: int) -> np.ndarray:
    """Points of the rows with ``groups`` coordinates: a finer one adds up coordinates."""
    return np.stack([np.frombuffer(raw[i], np.uint8).reshape(-1, groups).sum(0, dtype=np.int32) for i in rows.tolist()])


def _needed(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Least overlap of sets of these sizes: ``o (q + p) >= p (a + b)`` for a threshold of ``p / q``."""
    p, q = threshold
    return -(-p * (a + b) // (p + q))


class Tree:
    """An R-tree over the points of one shard, packed by size and then by coordinates."""

    def __init__(self, n: np.ndarray, points: np.ndarray, threshold: tuple[int, int], leaf: int = LEAF, fanout: int = FANOUT):
        self.n, self.points, self.threshold, self.fanout = n, points, threshold, fanout
        spread = np.argsort(-points.var(0), kind="stable")[:2]
        tile = np.argsort(np.argsort(n, kind="stable"), kind="stable") // (leaf * fanout)
        order = np.lexsort((points[:, spread[-1]], points[:, spread[0]], tile))
        self.leaves = [order[i : i + leaf] for i in range(0, len(n), leaf)]
        #: From the leaves up to the root's children: coordinate maxima, least and largest size of each node.
        self.levels = [(np.stack([points[x].max(0) for x in self.leaves]), np.array([n[x].min() for x in self.leaves]), np.array([n[x].max() for x in self.leaves]))]
        while len(self.levels[-1][1]) > fanout:
            top, least, most = self.levels[-1]
            at = range(0, len(least), fanout)
            self.levels.append((np.stack([top[i : i + fanout].max(0) for i in at]), np.array([least[i : i + fanout].min() for i in at]), np.array([most[i : i + fanout].max() for i in at])))
        self.visited = 0

    def _near(self, leaf: int) -> np.ndarray:
        """Leaves from ``leaf`` on that may hold a partner of its points, found from the root down."""
        p, q = self.threshold
        own_top, own_least, own_most = (x[leaf] for x in self.levels[0])
        nodes = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, least, most = (x[nodes] for x in self.levels[level])
            self.visited += len(nodes)
            bound = np.minimum(own_top, top).sum(1)
            nodes = nodes[(bound >= _needed(own_least, least, self.threshold)) & (q * most >= p * own_least) & (q * own_most >= p * least)]
            if level:
                nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][1])]
        return nodes[nodes >= leaf]

    def pairs(self, apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that pass the bound; ``apart(xs, ys)`` tells whether two leaves still have anything to link."""
        for i, xs in enumerate(self.leaves):
            for j in self._near(i).tolist():
                ys = self.leaves[j]
                if apart(xs, ys):
                    a, b = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
                    ok = a < b if i == j else np.ones(len(a), bool)
                    ok &= close(self.n, self.points, a, b, self.threshold)
                    yield a[ok], b[ok]


def close(n: np.ndarray, points: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether the sum of coordinate minima allows each pair."""
    p, q = threshold
    ok = q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])
    at = np.flatnonzero(ok)
    ok[at] = np.minimum(points[a[at]], points[b[at]]).sum(1) >= _needed(n[a[at]], n[b[at]], threshold)
    return ok


def _candidates(threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table, starts in _words.whole_groups(batches, ["key", "low", "high"]):
            row, n = table["row"].to_numpy(), table["n"].to_numpy().astype(np.int64)
            raw = table["point"].to_pylist()
            groups = np.array([len(x) for x in raw])
            sizes = np.diff(np.append(starts, len(row)))
            group = np.repeat(np.arange(len(starts)), sizes)
            small = sizes[group] <= LEAF
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(1, int(sizes[sizes <= LEAF].max(initial=1))):
                a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
                pairs.append((a, a + step))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                shared = np.minimum(groups[a], groups[b])
                for d in np.unique(shared).tolist():
                    x, y = a[shared == d], b[shared == d]
                    need = np.unique(np.concatenate([x, y]))
                    points = _folded(raw, need, d)
                    x_at, y_at = np.searchsorted(need, x), np.searchsorted(need, y)
                    step = max(1, COORDINATES // d)
                    for lo in range(0, len(x), step):
                        cut = slice(lo, lo + step)
                        ok = close(n[need], points, x_at[cut], y_at[cut], threshold)
                        for i, j in zip(row[x[cut][ok]].tolist(), row[y[cut][ok]].tolist(), strict=True):
                            forest.join(i, j)
            for g in np.flatnonzero(sizes > LEAF).tolist():
                shard = np.arange(starts[g], starts[g] + sizes[g])
                # Sets that can link differ in size by less than half, so in the number of groups by a step at most.
                for d in np.unique(groups[shard]).tolist():
                    own = shard[(groups[shard] == d) | (groups[shard] == 2 * d)]
                    ids, fine = row[own].tolist(), groups[own] > d

                    def apart(xs: np.ndarray, ys: np.ndarray, ids: list[int] = ids) -> bool:
                        return len({forest.root(ids[i]) for i in (*xs.tolist(), *ys.tolist())}) > 1

                    for a, b in Tree(n[own], _folded(raw, own, d), threshold).pairs(apart):
                        coarse = ~(fine[a] & fine[b])  # two fine ones meet in the finer tree
                        for i, j in zip(a[coarse].tolist(), b[coarse].tolist(), strict=True):
                            forest.join(ids[i], ids[j])
        yield _edge_batch(forest)

    return run


def _edge_batch(forest: Forest) -> pa.RecordBatch:
    stars = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], ["a", "b"])


def _verified(size: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, unpack = Forest(), zstandard.ZstdDecompressor().decompress
        p, q = threshold

        def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
            part = np.cumsum([len(x) for x in texts]) // TEXT_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield from shingles(pa.array([unpack(x).decode() for x in texts[lo:hi]], pa.string()), size)

        for table, starts in _words.whole_groups(batches, ["component", "low", "high"]):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                rows, texts = table["row"].slice(a, b - a).to_pylist(), table["text"].slice(a, b - a).to_pylist()
                # First each set meets the first sets of a few trees, which settles most of a cluster of copies.
                n, held, first = np.zeros(len(rows), np.int64), [], {}
                for i, own in enumerate(sets_of(texts)):
                    n[i] = len(own)
                    for j, other in first.items():
                        if forest.root(rows[i]) != forest.root(rows[j]):
                            small, large = (own, other) if len(own) < len(other) else (other, own)
                            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                            if q * (shared := int((large[at] == small).sum())) >= p * (n[i] + n[j] - shared):
                                forest.join(rows[i], rows[j])
                    if len(first) < FIRST and all(forest.root(rows[i]) != forest.root(rows[j]) for j in first):
                        first[i] = own
                    if held is not None:
                        held.append(own)
                        held = held if n.sum() <= AT_ONCE else None
                # Then all sets of different trees meet, in parts of bounded size.
                part = (np.cumsum(n) - n) // AT_ONCE
                parts = [np.flatnonzero(part == k) for k in np.unique(part).tolist()]
                for k, xs in enumerate(parts):
                    for ys in parts[k:] if len(parts) == 1 else parts[k + 1 :]:
                        both = xs if ys is xs else np.concatenate([xs, ys])
                        if len({forest.root(rows[i]) for i in both.tolist()}) > 1:
                            sets = [held[i] for i in both.tolist()] if held is not None else list(sets_of([texts[i] for i in both.tolist()]))
                            _join_close(sets, [rows[i] for i in both.tolist()], threshold, forest)
        yield _edge_batch(forest)

    return run


def _join_close(sets: list[np.ndarray], rows: list[int], threshold: tuple[int, int], forest: Forest) -> None:
    """Join all sets that link, with overlaps counted in an inverted index; sets of the largest tree don't meet each other."""
    p, q = threshold
    n = np.array([len(s) for s in sets])
    tree = np.array([forest.root(r) for r in rows])
    names, many = np.unique(tree, return_counts=True)
    inner = tree == names[many.argmax()]
    owner = np.repeat(np.arange(len(sets)), n)
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_code = owner[np.argsort(code, kind="stable")]
    start = np.concatenate([[0], np.cumsum(many)])
    bounds = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(~inner).tolist():
        own = code[bounds[i] : bounds[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        cut = np.cumsum(many[own]) // SPAN
        for lo in np.unique(cut).tolist():
            some = own[cut == lo]
            span = many[some]
            at = np.repeat(start[some] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            shared += np.bincount(by_code[at], minlength=len(sets))
        link = (q * shared >= p * (n + n[i] - shared)) & (inner | (np.arange(len(sets)) < i))
        for j in np.flatnonzero(link).tolist():
            forest.join(rows[i], rows[j])


def _in_blocks(members: DataFrame, count: str, block: int) -> DataFrame:
    """Each row once for every two blocks it takes part in: once if its group is one block."""
    blocks = members.withColumn("blocks", F.expr(f"cast(ceil({count} / {block}) as int)"))
    blocks = blocks.withColumn("own", F.expr("cast(pmod(xxhash64(row), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return blocks.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "own", "other", count)


def _numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, none, rest``: rows with an id and their compressed text, stored; ``rest`` has the other columns."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("none"), rest)
    return stored(rows.mapInArrow(_words.packed, T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema])))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``row, doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two rows link when their sets' Jaccard similarity is at least the fraction
    ``threshold``.  Rows are numbered once and stored with their texts.
    """
    return _linked(_numbered(docs.select("doc_id", "text")), shingle, threshold)


def _linked(rows: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    classes = sc.broadcast(frequency_classes(rows, shingle))
    points = stored(rows.select("row", "doc_id", "text").mapInArrow(_points(shingle, threshold, classes), "row long, doc_id long, n int, f1 long, f2 long, point binary, keys array<long>, hot_keys array<long>"))
    same = points.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("row").alias("row"))
    first = points.join(same.select("row").hint("shuffle_hash"), "row", "left_semi")
    # A set has something to meet in a shard if the next smaller or larger set there is of about its size.
    p, q = threshold
    by_key = W.partitionBy("key")
    keys = first.select("row", "n", F.explode("keys").alias("key")).withColumns({"below": F.lag("n").over(by_key.orderBy("n", "row")), "above": F.lead("n").over(by_key.orderBy("n", "row")), "members": F.count("*").over(by_key)})
    keys = keys.filter(f"{q} * below >= {p} * n or {q} * n >= {p} * above").select("row", "n", "key", "members")
    # Frequent keys are told apart by bands of sizes as well; sets that link lie in one band or in two next to each other.
    band = F.floor(F.log("n") / float(np.log(q / p))).cast("int") if p < q else F.col("n")
    hot = first.filter(F.size("hot_keys") > 0).select("row", "n", F.explode("hot_keys").alias("key"), band.alias("band"))
    hot = hot.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).select("row", "n", F.xxhash64("key", "band").alias("key"))
    hot = hot.join(hot.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "key").select("row", "n", "key", "members")
    # Blocks are dealt after the joins, which hold a row a member then and not one for each of its blocks.
    shards = _in_blocks(keys.unionByName(hot).join(points.select("row", "point"), "row"), "members", SHARD_BLOCK)
    shards = shards.select("key", "low", "high", "row", "n", "point").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "row")
    candidates = components(shards.mapInArrow(_candidates(threshold), "a long, b long"))
    members = candidates.unionByName(candidates.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "row")
    members = members.join(members.groupBy("component").agg(F.count("*").alias("members")), "component")
    texts = _in_blocks(rows.select("row", "text").join(members.hint("shuffle_hash"), "row"), "members", TEXT_BLOCK)
    texts = texts.select("component", "low", "high", "row", "text").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "row")
    linked = components(texts.mapInArrow(_verified(shingle, threshold), "a long, b long"))
    # From representatives to all members of their classes, then the smallest id of each component.
    classes_of = same.join(linked.withColumnRenamed("node", "row"), "row", "left").select("n", "f1", "f2", F.coalesce("component", "row").alias("component"))
    slim = points.select("row", "doc_id", "n", "f1", "f2")
    least = slim.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least")).join(classes_of, ["n", "f1", "f2"])
    named = classes_of.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component")
    return slim.join(named, ["n", "f1", "f2"], "left").select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each component of ``docs``: the first with the smallest id.  Rows without words stay."""
    rows = _numbered(docs)
    found = _linked(rows, shingle, threshold)
    groups = found.filter("n_shingles > 0 and doc_id <=> component_id").groupBy("component_id").agg(F.min("row").alias("row")).select("row")
    kept = groups.unionByName(found.filter("n_shingles = 0").select("row"))
    kind = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in rows.schema])
    out = rows.join(kept.hint("shuffle_hash"), "row", "left_semi").mapInArrow(_words.unpacked, kind)
    return out.select(*(F.when(~F.col("none"), F.col("text")).alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, a Jaccard similarity of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (90, 100)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ranked AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM (SELECT s.*, count(*) OVER (PARTITION BY g) AS f FROM s) JOIN n USING (doc_id)),
prefix AS (SELECT doc_id, g FROM ranked WHERE k <= n - CAST(ceil(n * 0.9) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id),
link AS (
  SELECT x, y FROM (SELECT x, y, count(*) AS o FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y) c
  JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * o >= 90 * (na.n + nb.n - o)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN (SELECT x, y FROM link UNION ALL SELECT y, x FROM link) e ON r.other = e.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
