"""Source divergence audit: how far the vocabularies of a language's sources lie apart, and by which terms.

Two passes over the texts, neither of which moves them. The first finds each language's vocabulary by exact document frequencies. The second
counts occurrences: a task takes a few megabytes of texts at a time and runs over them an Aho-Corasick automaton of the kept terms that
they hold, padded with delimiters. Which terms are kept tasks learn from a bit map of bounded size, so the vocabulary as a whole is never in
one place; the few others that it lets through are dropped by an exact join. The counts are sparse postings of (source, term); sums
over terms that a source lacks come from histograms, since all of them have the source's least share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: UTF-8 bytes: A term is a run of ASCII letters, lower-cased, and bytes beyond ASCII; all else becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS, TOP_TERMS, SHARE = 3, 200, 1_000_000_000
#: Bytes of text that share an automaton; counts that a task holds before it sends them on; bits of the map of kept terms, at most.
BLOCK_BYTES, HELD, MOST_BITS = 1 << 22, 4_000_000, 1 << 28
#: Parts into which the sources of a language are dealt when pairs of them are made, and the terms of a source before they are ranked.
SPREAD = 16


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total), exact for counts of any size; by longs where these hold the product."""
    big = lambda c: c.cast("decimal(20,0)")
    exact = F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * big(count + 1), big(total))
    return F.lit(1) + F.when(count < 1 << 33, F.call_function("div", F.lit(SHARE).cast("long") * (count + 1), total)).otherwise(exact)


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def spaced(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS)


def _texts(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term: the terms that so many documents of the language have. Tasks send sums over the documents that they read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in docs.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), _texts(list(n)), pa.array(n.values(), pa.int64())], ["lang", "term", "docs"])
            docs.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                docs.setdefault(lang, Counter()).update(set(spaced(text).split()))
            if sum(map(len, docs.values())) > HELD // 4:
                yield from flush()
        yield from flush()

    seen = rows.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    dealt = seen.repartition("lang", "term")  # summed by task already: summing again before the shuffle would find nothing to sum
    return dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")


def bit_map(kept: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Bits at the hashes of the kept terms, sixteen for each term up to the most there may be."""
    size = min(most, max(64, 1 << (16 * kept.count()).bit_length()))
    at = F.xxhash64("lang", "term").bitwiseAND(F.lit(size - 1))
    words = kept.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def occurrences(rows: DataFrame, kept: DataFrame, block_bytes: int = BLOCK_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, source, term, count > 0: how often each source has each kept term of its language."""
    sent = rows.sparkSession.sparkContext.broadcast(bit_map(kept, most_bits))  # most_bits at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from xxhash import xxh64_intdigest

        bits, size = sent.value, 64 * len(sent.value)
        block: dict[str, dict[str, list[bytes]]] = {}
        numbers: dict[str, dict[bytes, int]] = {}  # of the terms found so far
        found: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = held = 0

        def scan() -> int:
            more = 0
            for lang, sources in block.items():
                together = {source: b" ".join(parts) for source, parts in sources.items()}
                terms = list(set().union(*(t.split() for t in together.values())))
                seed = xxh64_intdigest(lang.encode(), 42)
                at = np.array([xxh64_intdigest(t, seed) & (size - 1) for t in terms], np.int64)
                known = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                terms = [t for t, k in zip(terms, known.tolist()) if k]
                if not terms:
                    continue
                words, own = ahocorasick.Automaton(ahocorasick.STORE_INTS), numbers.setdefault(lang, {})
                for k, t in enumerate(terms):
                    words.add_word(f" {t.decode()} ", k)
                words.make_automaton()
                number = np.array([own.setdefault(t, len(own)) for t in terms])
                for source, text in together.items():
                    n = np.bincount(np.fromiter(map(itemgetter(1), words.iter(f" {text.decode()} ")), np.int64), minlength=len(terms))
                    hit = np.flatnonzero(n)
                    found.setdefault((lang, source), []).append((number[hit], n[hit]))
                    more += len(hit)
            block.clear()
            return more

        def flush() -> Iterator[pa.RecordBatch]:
            names = {lang: _texts(list(own)) for lang, own in numbers.items()}
            for (lang, source), parts in found.items():
                which, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
                n = np.zeros(len(which), np.int64)
                np.add.at(n, at, np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), names[lang].take(pa.array(which)), pa.array(n)], ["lang", "source", "term", "count"])
            numbers.clear()
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                block.setdefault(lang, {}).setdefault(source, []).append(spaced(text))
                waiting += len(text)
                if waiting > block_bytes:
                    held, waiting = held + scan(), 0
                    if held > HELD:
                        yield from flush()
                        held = 0
        scan()
        yield from flush()

    counted = rows.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, count long")
    dealt = counted.repartition("lang", "source", "term")  # as in vocabulary
    return dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")).join(kept, ["lang", "term"])


def common_values(lists: DataFrame, step: int = 1 << 19) -> DataFrame:
    """lang, source, item, value: what the terms of both add to a pair's sum beyond what each alone does, a row for each pair and task batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = lambda p, q: (p - q) ** 2 // q
        for batch in batches:
            have = batch.column("have")
            lengths, flat = np.diff(have.offsets.to_numpy()), have.flatten()
            langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), lengths)
            groups, code = {}, np.zeros(len(langs), np.int64)
            for k, key in enumerate(zip(langs.tolist(), flat.field("source").to_pylist())):
                code[k] = groups.setdefault(key, len(groups))
            p, z = (flat.field(c).to_numpy() for c in ("p", "z"))
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)  # where the row's own list begins
            each = np.repeat(lengths, lengths)
            ends, done, total = np.cumsum(each), 0, {}
            while done < len(each):
                to = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, side="right")), done + 1)
                i = np.repeat(np.arange(done, to), each[done:to])
                j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(each[done:to]) - each[done:to], each[done:to])
                i, j = i[i != j], j[i != j]
                value = far(p[i], p[j]) - far(p[i], z[j]) - far(z[i], p[j]) + far(z[i], z[j])
                pairs, at = np.unique(code[i] * len(groups) + code[j], return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, at, value)
                for key, v in zip(pairs.tolist(), sums.tolist()):
                    total[key] = total.get(key, 0) + v
                done = to
            names = list(groups)
            out = [(*names[k // len(groups)], names[k % len(groups)][1], v) for k, v in total.items()]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])

    return lists.filter(F.size("have") > 1).select("lang", "have").mapInArrow(add, "lang string, source string, item string, value long")


def pair_values(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of f over all kept terms for each ordered pair of a language's sources.

    lists has for each term the sources that have it, with their p there and their z, the p of a term that they lack; groups has z and v,
    the number of kept terms. The sum over all terms is v * f(z, z') and what the terms of one, the other and both add to it.
    """
    slot = F.pmod(F.xxhash64("source"), F.lit(SPREAD))
    left = groups.withColumn("slot", slot)
    right = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("slot"))
    pairs = cut(left.join(right, ["lang", "slot"]).filter("source != item").select("lang", "source", "item", "z", "y", "v"))
    z, y = F.col("z"), F.col("y")
    levels = lists.select("lang", F.explode("have").alias("a")).groupBy("lang", F.col("a.source").alias("source"), F.col("a.p").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    levels = cut(levels)
    own = pairs.join(levels, ["lang", "source"]).select("lang", "source", "item", (F.col("n") * (_far(F.col("p"), y) - _far(z, y))).alias("value"))
    theirs = pairs.join(levels.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("n") * (_far(z, F.col("p")) - _far(z, y))).alias("value"))
    flat = pairs.select("lang", "source", "item", (F.col("v") * _far(z, y)).alias("value"))
    return flat.unionByName(own).unionByName(theirs).unionByName(common_values(lists)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank for documents (text, lang, source), nulls read as ''.

    A term is kept if min_docs documents (rows; repeated ones count) of its language have it. Part pair has every other source of the
    language, 0 where no term is kept; part term the top terms that the source has more often than its language, none for sources
    without terms. Ties go by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not read. A term's sources are
    one list, as long as the result's list of partners of a source.
    """
    rows = texts(docs)
    kept = written(vocabulary(rows, min_docs))
    postings = written(occurrences(rows, kept, block_bytes, most_bits))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").fillna(0, ["n", "v"])
    groups = cut(groups.withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n") + F.col("v"))).otherwise(1)))
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("all"))
    shares = postings.join(groups, ["lang", "source"]).select("lang", "term", "count", F.struct("source", _share(F.col("count"), F.col("n") + F.col("v")).alias("p"), "z").alias("have"))
    lists = written(shares.groupBy("lang", "term").agg(F.collect_list("have").alias("have"), F.sum("count").alias("in_lang")))
    beside = lists.join(langs, "lang").select("lang", "term", _share(F.col("in_lang"), F.col("all")).alias("q"), F.explode("have").alias("a")).filter("a.p > q")
    terms = beside.select("lang", F.col("a.source").alias("source"), F.col("term").alias("item"), _far(F.col("a.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    # The best of each part of a source's terms first, so that no task ranks more than SPREAD parts' best.
    lane = F.pmod(F.xxhash64("item"), F.lit(SPREAD))
    best = terms.withColumn("lane", lane).withColumn("at", F.row_number().over(Window.partitionBy("lang", "source", "lane").orderBy(F.desc("value"), "item")))
    best = best.filter(F.col("at") <= top).drop("lane", "at")
    return ranked(pair_values(lists, groups), "pair").unionByName(ranked(best, "term").filter(F.col("rank") <= top))
