"""Near-duplicates by fingerprints: exact comparison in tiles of equal population counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.operators.ordered import settle

SHINGLE = 4                         # words
RADIUS = 4                          # bits
SEED = 42
TILE_ROWS = 1 << 16                 # fingerprints of a tile
CELLS = 1 << 22                     # pairs that are compared at a time
PART_BITS = 16                      # bits of each part whose population is counted


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the shingles of one text; of the whole sequence where it is shorter, of nothing without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())), dtype=np.uint64,
                       count=len(words) - size + 1)


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column("text")]
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(found, pa.int64())], names=[*keep, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text, NULL as 0) and ``fp`` of every input row."""
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_with_fingerprint, f"doc_id {kind}, key bigint, fp bigint")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows ``(node, smallest node of its component)`` for the nodes that the links join."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = ends[:len(a)], ends[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rows = np.stack((nodes, nodes[root]), axis=1)
    return rows[rows[:, 0] != rows[:, 1]]


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four parts of each fingerprint."""
    parts = np.stack([(fp >> np.uint64(s)) & np.uint64(0xFFFF) for s in range(48, -1, -PART_BITS)], axis=1)
    return np.bitwise_count(parts).astype(np.int16)


def _tiles(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted into tiles of equal counts: the order's values, the counts of each tile, tile bounds."""
    counts = _counts(fp)
    order = np.lexsort(counts.T[::-1])
    kinds, at = np.unique(counts[order], axis=0, return_index=True)
    return fp[order], kinds, np.append(at, len(fp))


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius; tile pairs whose counts differ by more in sum are skipped, as no pair there can be."""
    out_a, out_b = [], []
    left, kinds_l, at_l = _tiles(left)
    right, kinds_r, at_r = (left, kinds_l, at_l) if same else _tiles(right)
    for i in range(len(kinds_l)):
        gap = np.abs(kinds_r - kinds_l[i]).sum(axis=1)
        others = np.flatnonzero(gap <= radius)
        others = others[others >= i] if same else others
        if not len(others):
            continue
        b = np.concatenate([right[at_r[j]:at_r[j + 1]] for j in others])
        step = max(1, CELLS // len(b))
        for lo in range(at_l[i], at_l[i + 1], step):
            a = left[lo:min(lo + step, at_l[i + 1])]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            apart = a[x] != b[y]
            out_a.append(a[x[apart]])
            out_b.append(b[y[apart]])
            if sum(map(len, out_a)) > CELLS:               # many links: a forest joins the same nodes
                tree = forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [tree[:, 0]], [tree[:, 1]]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        sides = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for side, fps in zip(table["side"].to_pylist(), table["fps"]):
            sides[side].append(fps.values.to_numpy())
        a, b = (np.concatenate(x).view(np.uint64) for x in sides)
        same = table["l"][0] == table["r"][0]
        rows = forest(*close_pairs(a, b, radius, same)).view(np.int64)
        return pa.table({"a": rows[:, 0], "b": rows[:, 1]})
    return run


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``: a forest of links for every task, so that all fingerprints within the radius are joined.

    Distinct fingerprints are dealt to groups by their population count, and a group of more than ``tile_rows`` to
    tiles by hash.  Fingerprints within the radius have counts that differ by no more, so only tiles of
    such counts meet.  A task holds one pair of tiles and compares it exactly, part by part.
    """
    distinct = prints.select("fp").distinct().withColumn("ones", F.bit_count("fp"))
    sizes = distinct.groupBy("ones").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("tiles"))   # 65 rows at most
    dealt = (distinct.join(F.broadcast(sizes), "ones")
             .groupBy("ones", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
             .agg(F.collect_list("fp").alias("fps")))
    # The partners of a tile, itself and later ones: every tile of the group, and of groups at most ``radius`` counts on.
    other = sizes.select(F.col("ones").alias("ones2"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile2"))
    own = sizes.select("ones", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    meet = (own.withColumn("ones2", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius))).join(other, "ones2")
            .filter((F.col("ones2") > F.col("ones")) | (F.col("tile2") >= F.col("tile"))))
    name = lambda ones, tile: F.concat_ws(".", ones, tile)
    meet = settle(meet.select(name("ones", "tile").alias("l"), name("ones2", "tile2").alias("r")))
    tiles = settle(dealt.select(name("ones", "tile").alias("name"), "fps"))
    left = tiles.join(meet, tiles["name"] == meet["l"]).select("l", "r", F.lit(0).alias("side"), "fps")
    right = tiles.join(meet.filter("l <> r"), tiles["name"] == meet["r"]).select("l", "r", F.lit(1).alias("side"), "fps")
    return left.unionByName(right).groupBy("l", "r").applyInArrow(_compare(radius), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each linked node reaches.

    Every round ties the larger neighbours of each node to its smallest neighbour, then its smaller neighbours;
    rows never exceed the links, and the links shrink to stars in a number of rounds logarithmic in the longest path.
    Each round is a written table, so a lost executor costs a read.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        new = settle(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def classes(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id``, ``key``, ``fp``, ``component_id`` and ``root`` (a name of the class) of every input row.

    Rows with equal fingerprints are one class, texts without words too (fingerprint zero, linked like any
    other).  ``component_id`` is the smallest id of the class; NULL ids take part and are named only where a class has
    no other.  Repeated rows stay, an empty table gives none, and other columns are left out.
    """
    prints = settle(fingerprints(docs))
    named = components(links(prints, radius, tile_rows))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    members = named.select(F.col("node").alias("fp"), "root").unionByName(named.select(F.col("root").alias("fp"), "root").distinct())
    # Written tables, so that the joins below are of plain exchanges and a hot class can be split.
    linked = settle(members.join(ids, "fp"))
    least = settle(linked.groupBy("root").agg(F.min("least_id").alias("component_id")))
    known = settle(linked.join(least, "root").select("fp", "component_id", "root"))
    per_print = ids.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(settle(per_print), "fp").select("doc_id", "key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One input row of each class, that with the smallest id; of rows with equal ids one with the smallest text hash."""
    found = classes(docs, radius, tile_rows)
    chosen = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
              .agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key"))
    return _matching(docs, chosen)


def _matching(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("unnamed"),
                       F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"))
    wanted = chosen.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("unnamed"), "key")
    on = ["id", "unnamed", "key"]
    kept = rows.join(wanted, on, "left_semi").dropDuplicates(on)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
