"""Near-dedup of whole texts by SimHash: tiles of fingerprints propose pairs, the exact similarity of five-word shingles decides.

Fingerprints of the distinct five-word shingles meet in tiles, where numpy compares them by exclusive-or and bit counts; tile pairs whose
population counts differ beyond the radius are skipped. Which fingerprints meet is said by bands of minimum hashes: texts of a
similarity of 0.8 share one of 20 bands of four with a chance of 1 - (1 - 0.8^4)^20 = 0.99997, and more similar ones sooner. Their
fingerprints differ by about 10 bits, so the radius of 24 leaves room for the spread. A proposed pair is a link only if its Jaccard
similarity, counted on the whole texts, is 0.8 or more. Pairs that a first forest does not join are compared where their tile's shingle
sets meet, and only links leave it: a group of n texts just below 0.8 takes n^2 comparisons in numpy, but no row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, small, with_row
from .simhash import SEED, components, majority

WORDS = 5
BANDS, BAND = 20, 4
RADIUS = 24
#: Fingerprints in one tile.
TILE = 1024
#: Shingles whose minimum hashes are taken at once, which bounds the memory of long texts.
BLOCK = 4096
#: Shingles of one part of a tile whose sets are compared; two parts meet at once, which bounds the memory of long texts.
PART = 1 << 20
_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, ascending; a shorter text is one shingle, a text without words has none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    shingles = [b" ".join(x) for x in zip(*(w[k:] for k in range(words)))] if len(w) >= words else [b" ".join(w)] if w else []
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key of each band: the hash of its minimum hashes."""
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), BLOCK):
        mixed = shingles[i : i + BLOCK, None] * _ODD + _ADD
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return np.array([xxh64_intdigest(low[k * BAND : (k + 1) * BAND].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, digest of the shingle set, n of its shingles, fp and band keys for rows of row, doc_id and text."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for text in frame["text"]:
                s = shingle_set(text)
                made.append((blake2b(s.tobytes(), digest_size=16).digest(), len(s), majority([s], len(s)), band_keys(s) if len(s) else np.array([], dtype=np.int64)))
            digest, n, fp, keys = (list(x) for x in zip(*made)) if made else ([], [], [], [])
            yield pd.DataFrame({"row": frame["row"], "doc_id": frame["doc_id"].astype("Int64"), "digest": digest, "n": np.array(n, dtype=np.int64), "fp": np.array(fp, dtype=np.uint64).view(np.int64), "keys": keys})

    return rows.mapInPandas(batches, "row string, doc_id long, digest binary, n long, fp long, keys array<long>")


def _near(fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits between two nodes, or 65 if they are beyond the radius or their sizes say that they can't be similar."""
    bits = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]).astype(np.int16)
    return np.where((bits <= RADIUS) & (5 * np.minimum.outer(sizes, sizes) >= 4 * np.maximum.outer(sizes, sizes)), bits, 65)


def _forests(tiles: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes: a forest of the closest pairs of each tile."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for nodes, fps, sizes in zip(*(frame[c] for c in ("node", "fp", "n"))):
                nodes, fps, sizes = (np.asarray(x, dtype=np.int64) for x in (nodes, fps, sizes))
                out += [(min(a, b), max(a, b)) for a, b in ((int(nodes[i]), int(nodes[j])) for i, j in spanning_forest(_near(fps, sizes)))]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tiles.select(*(F.col(f"cells.{c}").alias(c) for c in ("node", "fp", "n"))).mapInPandas(compare, "a long, b long").distinct()


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a forest of the closest pairs that spans all nodes that are near each other."""
    n = len(near)
    if n == 2:
        return [(0, 1)] if near[0, 1] <= RADIUS else []
    best, hung, left, edges = np.full(n, 66, dtype=np.int16), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), []
    for _ in range(n):
        i = int(np.where(left, best, 67).argmin())
        left[i] = False
        if best[i] <= RADIUS:
            edges.append((int(hung[i]), i))
        closer = left & (near[i] < best)
        best[closer], hung[closer] = near[i][closer], i
    return edges


def open_nodes(key: int, near: np.ndarray, roots: np.ndarray, sides: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which nodes of a tile pair have a near one of another root; a pair counts at the first key only that both share."""
    found = np.zeros(len(roots), dtype=bool)
    for i in range(len(roots)):
        j = i + 1 + np.flatnonzero((near[i, i + 1 :] <= RADIUS) & (roots[i + 1 :] != roots[i]) & ((sides[i + 1 :] != sides[i]) | (sides[i] == 2)))
        if len(j):
            j = j[keys[i, (keys[j] == keys[i]).argmax(axis=1)] == key]
            found[j] = True
            found[i] |= len(j) > 0
    return np.flatnonzero(found)


def parts_of(sizes: np.ndarray, part: int) -> list[np.ndarray]:
    """Places of a tile's nodes, in parts of which any two nodes share one: all, or each two of the runs of about so many shingles."""
    run = np.cumsum(sizes) // part
    runs = [np.flatnonzero(run == k) for k in np.unique(run)]
    return runs if len(runs) == 1 else [np.concatenate([x, y]) for k, x in enumerate(runs) for y in runs[:k]]


def _opened(tiles: DataFrame, part: int) -> DataFrame:
    """tile, part, node, fp, root of the nodes of each tile pair that have a near one of another root."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, tile, *cells in frame[["key", "tile", "node", "fp", "n", "root", "side", "keys"]].itertuples(index=False, name=None):
                keys = np.stack(cells.pop())
                nodes, fps, sizes, roots, sides = (np.asarray(x, dtype=np.int64) for x in cells)
                at = open_nodes(key, _near(fps, sizes), roots, sides, keys)
                out += [(tile, k, int(nodes[i]), int(fps[i]), int(roots[i])) for k, some in enumerate(parts_of(sizes[at], part)) for i in at[some]]
            yield pd.DataFrame(out, columns=["tile", "part", "node", "fp", "root"], dtype="int64")

    cells = [F.col(f"cells.{c}").alias(c) for c in ("node", "fp", "n", "root", "side", "keys")]
    return tiles.select("key", "tile", *cells).mapInPandas(find, "tile long, part long, node long, fp long, root long")


def joins(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) of similarity 0.8 or more that join all roots which such pairs within the radius connect, and no more."""
    sizes, label, out = np.array([len(x) for x in sets]), roots.copy(), []
    near, starts = _near(fps, sizes) <= RADIUS, np.cumsum(sizes) - sizes
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    for i in range(len(sets) - 1):
        maybe = near[i, i + 1 :] & (label[i + 1 :] != label[i])
        if not maybe.any():
            continue
        mine = np.zeros(len(values), dtype=bool)
        mine[at[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(mine[at], starts, dtype=np.int64)[i + 1 :]
        for j in i + 1 + np.flatnonzero(maybe & (9 * both >= 4 * (sizes[i + 1 :] + sizes[i]))):  # 5 * both >= 4 * (the two sizes - both)
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _joined(opened: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links src, dst between the roots of each tile's opened nodes: their shingle sets meet in the tile."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "shingles": [shingle_set(x).tobytes() for x in frame["text"]]})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, fp, root, sets in frame[["node", "fp", "root", "shingles"]].itertuples(index=False, name=None):
                out += [(int(node[i]), int(node[j])) for i, j in joins(np.asarray(fp, dtype=np.int64), np.asarray(root, dtype=np.int64), [np.frombuffer(x, dtype=np.uint64) for x in sets])]
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    sets = _texts(opened.select("node"), nodes, rows).mapInPandas(make, "node long, shingles binary")
    met = opened.join(sets, "node").groupBy("tile", "part").agg(F.collect_list(F.struct("node", "fp", "root", "shingles")).alias("cells"))
    return met.select(*(F.col(f"cells.{c}").alias(c) for c in ("node", "fp", "root", "shingles"))).mapInPandas(join, "src long, dst long")


def _gathered(rows: DataFrame, a: str, b: str, side: str) -> DataFrame:
    """key, tile, cells: one row for each tile pair, of two tiles' rows at most."""
    cell = F.struct("node", "fp", "n", *(c for c in ("root", "keys") if c in rows.columns), F.expr(side).alias("side"))
    pairs = rows.groupBy("key", F.expr(a).alias("ta"), F.expr(b).alias("tb")).agg(F.collect_list(cell).alias("cells")).filter(F.size("cells") > 1)
    return pairs.select("key", F.xxhash64("key", "ta", "tb").alias("tile"), "cells")


def _own_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Each key's rows in tiles by hash, each tile with itself: another key deals the same nodes out anew."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("all")).filter("all > 1")
    return _gathered(rows.join(sizes, "key").withColumn("t", F.expr(f"cast(pmod(xxhash64(node, key), ceil(all / {tile})) as int)")), "t", "t", "2")


def _cut_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """key, runs, tiles: each key's main and other rows by population count, cut every so many rows into tiles from lo to hi bits.

    A tile takes several counts where these have few rows, so a key of n rows has about n / tile tiles and not one for each count.
    """
    runs = rows.groupBy("key", "cls", "bits").agg(F.count(F.lit(1)).alias("n"))
    runs = cut(runs.withColumn("start", F.sum("n").over(Window.partitionBy("key", "cls").orderBy("bits")) - F.col("n")))
    each = runs.withColumn("t", F.explode(F.expr(f"sequence(cast(start div {tile} as int), cast((start + n - 1) div {tile} as int))")))
    tiles = each.groupBy("key", "cls", "t").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi"))
    tiles = tiles.groupBy("key").agg(F.collect_list(F.struct("cls", "t", "lo", "hi")).alias("tiles"))
    return runs.groupBy("key").agg(F.collect_list(F.struct("cls", "bits", "n", "start")).alias("runs")).join(tiles, "key")


def _root_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Tile pairs of the keys whose rows have several roots, without the pairs within a key's largest component.

    The rows of the largest component (main) are dealt out once and meet all others; tiles are runs of population counts, and a row goes
    only where a tile has counts within the radius of its own. A key that fits into one tile is one.
    """
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("m").alias("all")).filter("roots > 1").drop("roots")
    rows = cut(rows.join(main, "key").withColumn("cls", F.expr("if(root = main, 0, 1)")).withColumn("bits", F.bit_count("fp")))
    one = _gathered(rows.filter(f"all <= {tile}"), "0", "0", "2")
    large = rows.filter(f"all > {tile}")
    large = large.join(_cut_tiles(large, tile), "key").withColumn("at", F.expr("filter(runs, r -> r.cls = cls and r.bits = bits)[0]"))
    large = large.withColumn("own", F.expr(f"struct(cls, cast((at.start + pmod(xxhash64(node), at.n)) div {tile} as int) as t)"))
    others = f"transform(filter(tiles, c -> bits between c.lo - {RADIUS} and c.hi + {RADIUS} and c.cls + cls > 0), c -> struct(c.cls as cls, c.t as t))"
    large = large.withColumn("other", F.explode(F.expr(others)))
    many = _gathered(large, "least(own, other)", "greatest(own, other)", "if(own = other, 2, if(own < other, 0, 1))")
    return one.union(many)


def _texts(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text of each wanted node."""
    named = cut(wanted.distinct().join(nodes, "node").select("node", "row"))
    return rows.select("row", "text").join(small(named), "row").select("node", "text")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more, as links src, dst; rows has the texts."""
    texts = cut(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows))

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for a, b, x, y in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"]):
                x, y = shingle_set(x), shingle_set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 9 * both >= 4 * (len(x) + len(y)):  # 5 * both >= 4 * (len(x) + len(y) - both)
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["src", "dst"], dtype="int64")

    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(alike, "src long, dst long")


def similar_links(nodes: DataFrame, rows: DataFrame, tile: int = TILE, part: int = PART) -> DataFrame:
    """Links that connect all nodes (node, row, n, fp, keys) of similarity 0.8 or more, directly or through others; rows has their texts.

    First a forest of the closest fingerprints of each tile is verified, which joins most of a group with few pairs. Then the nodes that
    are within the radius of one not joined yet meet in their tiles again, with their shingle sets, and are compared there.
    """
    some = nodes.filter("n > 0")
    met = some.select("node", "fp", "n", F.explode("keys").alias("key"))
    pairs = cut(_forests(_own_tiles(met, tile)))
    links = cut(_verified(pairs, nodes, rows))
    rooted = some.select("node", "fp", "n", "keys").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    opened = cut(_opened(_root_tiles(rooted.withColumn("key", F.explode("keys")), tile), part))
    return links if opened.isEmpty() else links.union(_joined(opened, nodes, rows))


def near_copies(docs: DataFrame, row: str) -> DataFrame:
    """The row key of each row that goes: of a component, the row with the smallest doc_id stays, a null one only if all are null.

    Equal sets are collapsed first, so that copies cost nothing; a null text is an empty one, and all texts without words are copies.
    """
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(sketches(rows))
    nodes = sets.groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(similar_links(nodes, rows))
    named = cut(nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")))
    rooted = cut(sets.select("digest", "doc_id", "row").join(named, "digest").select("row", "doc_id", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rooted.join(kept, "row", "left_anti").select("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, with its columns.

    Rows are known by their place and not by doc_id: null and repeated ids are rows like any other. Null and empty texts are copies of each
    other; whole texts of any length are compared; of ties the smallest doc_id stays; an empty table stays empty; columns of any name stay.
    """
    key = free_name(docs, "__row")
    rows = with_row(docs, key)
    gone = cut(near_copies(rows, key).select(F.col("row").alias(key)))
    return rows.join(small(gone), key, "left_anti").select(*docs.columns)
