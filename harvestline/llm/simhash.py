"""SimHash near-dedup: fingerprints of word shingles, exact tiled comparison in numpy, connected components in DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 42
RADIUS = 2
#: Fingerprints in one tile.
TILE = 1024
#: Bits of the four blocks; two fingerprints at most two bits apart agree in two of the blocks at least.
BLOCKS = 4


def fingerprint_bits(shingles: list[bytes]) -> int:
    """The bits that are set in over half of the shingles' XXH64 values; 0 for none."""
    from xxhash import xxh64_intdigest

    step = 1 << 15
    return majority((np.array([xxh64_intdigest(s, SEED) for s in shingles[i : i + step]], dtype="<u8") for i in range(0, len(shingles), step)), len(shingles))


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n hashes, which come in blocks."""
    counts = np.zeros(64, dtype=np.int64)
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint, for each row of docs; a null text is an empty one."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = []
            for text in frame["text"]:
                w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
                shingles = [b" ".join(x) for x in zip(*(w[k:] for k in range(words)))] if len(w) >= words else [b" ".join(w)] if w else []
                fps.append(fingerprint_bits(shingles))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": np.array(fps, dtype=np.uint64).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(batches, "doc_id long, fp long")


def _keys(fp: Column, radius: int, blocks: int) -> Column:
    """Keys of which two fingerprints within the radius share one at least: each choice of blocks - radius blocks."""
    width = 64 // blocks
    block = [F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(blocks)]
    return F.array(*(F.struct(F.lit(i).alias("part"), F.xxhash64(*(block[k] for k in chosen)).alias("bits")) for i, chosen in enumerate(combinations(range(blocks), blocks - radius))))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Exact comparison of two tiles; a matrix of those at most radius bits apart."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def tile_links(fps: np.ndarray, nodes: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest that spans the linked fingerprints of a tile pair: (node, smaller node it hangs on)."""
    left = np.flatnonzero(sides != 1)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    near = _near(fps[left], fps[right], radius)
    label = nodes.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(near, label[right][None, :], top).min(axis=1, initial=top))
        np.minimum.at(new, right, np.where(near, new[left][:, None], top).min(axis=0, initial=top))
        if (new == label).all():
            return [(int(n), int(m)) for n, m in zip(nodes, label) if n != m]
        label = new


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """src > dst links that connect all fingerprints (fp, node; each fp once) within radius bits of each other.

    Fingerprints that share a key are compared. A key's fingerprints are one tile if they fit; else they are tiled by
    population count and hash, every tile pair whose counts differ by at most the radius is compared, and the others are
    skipped. Each comparison emits a spanning forest, not all pairs, so a link may stand for others, but none is lost.
    """
    rows = nodes.withColumn("key", F.explode(_keys(F.col("fp"), radius, blocks))).withColumn("bits", F.bit_count("fp"))
    sizes = rows.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bits", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))).alias("counts")).filter("all > 1")
    rows = rows.join(plan, "key")
    mine = F.get(F.filter("counts", lambda c: c["bits"] == F.col("bits")), F.lit(0))["tiles"]
    own = F.struct(F.col("bits").alias("bits"), F.pmod(F.xxhash64("fp"), mine).cast("int").alias("t"))
    others = F.flatten(F.transform(
        F.filter("counts", lambda c: F.abs(c["bits"] - F.col("bits")) <= radius),
        lambda c: F.transform(F.sequence(F.lit(0), c["tiles"] - 1), lambda t: F.struct(c["bits"].alias("bits"), t.alias("t"))),
    ))
    one = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("t"))
    rows = rows.select("fp", "node", "key", F.when(F.col("all") <= tile, one).otherwise(own).alias("own"), F.when(F.col("all") <= tile, F.array(one)).otherwise(others).alias("others"))
    rows = rows.select("fp", "node", "key", "own", F.explode("others").alias("other"))
    pair = rows.groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    pairs = pair.agg(F.collect_list(F.struct("fp", "node", side.alias("side"))).alias("cells")).filter(F.size("cells") > 1)
    pairs = pairs.select(F.col("cells.fp").alias("fp"), F.col("cells.node").alias("node"), F.col("cells.side").alias("side"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links = [x for f, n, s in zip(frame["fp"], frame["node"], frame["side"]) for x in tile_links(np.asarray(f, np.int64).view(np.uint64), np.asarray(n, np.int64), np.asarray(s), radius)]
            yield pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    return pairs.mapInPandas(compare, "src long, dst long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for each node with a smaller one in reach.

    Large-star and small-star steps alternate until the links stand still; each step needs the smallest neighbour of a node only, a sum
    that is combined before the shuffle, and the join that hands it out can be split for a node with many links.
    """
    links = cut(links.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x"))
    before = links.agg(mark.alias("m")).first()["m"]
    while True:
        both = links.union(links.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.filter("src != dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("e"))
        links = cut(small.select("e.src", "e.dst").filter("src != dst").distinct())
        after = links.agg(mark.alias("m")).first()["m"]
        if after == before:
            return links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = after


def near_dedup(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id, fp_size for each row of docs.

    Texts are lower-cased (A-Z) and cut into shingles of three words; shorter texts are one shingle, and texts without
    words (null ones too) have fingerprint zero and link like any other. Documents with equal fingerprints are collapsed to
    the smallest doc_id before any comparison, so that copies cost nothing; repeated rows are copies, and a row with a null doc_id has a
    component only through its copies. Other columns are not read.
    """
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(nodes.filter("node is not null").select("fp", "node"), radius, blocks, tile))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), F.col("n").alias("fp_size"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_size")
