"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word's bytes become token ids, and merges are folded over them by rank. The rank map is an array of small maps from a pair to the id
that it merges to, for Spark looks through a map from its start. Every constant is bound once a row.

Digests fold the table's words so, each once; tasks look up a batch's distinct words there with Arrow's kernels, merge those that it lacks
by the same ranks, each once a batch, and join what the words became.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, json_literal

#: White space as Unicode defines it; Java's class is another.
_SPACE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words of the table of encoded words, the most frequent of a sample. It saves time only: other words are folded in place.
TABLE_WORDS = 262144
TABLE_SAMPLE = 32000
LONGEST_TABLE_WORD = 64
#: Words of a batch of texts that are joined at once, which bounds the memory of long texts.
RUN = 1 << 20
ENV = "__bpe"


def java_pattern(pattern: str) -> str:
    """A splitting pattern with \\s and \\S spelled out."""
    inside, out, i = False, "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in ("\\s", "\\S"):
            out += (_SPACE if two == "\\s" else "") if inside else f"[{'^' * (two == '\\S')}{_SPACE}]"
            i += 2
        elif two[0] == "\\":
            out, i = out + two, i + 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out, i = out + two[0], i + 1
    return out


@dataclass
class Vocabulary:
    """ranks: token bytes to rank, which is the id; merges: a pair of ids to the id that it merges to."""

    ranks: dict[bytes, int]
    merges: dict[tuple[int, int], int]

    @classmethod
    def load(cls, rank_file: str) -> Vocabulary:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        merges = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                continue
            # The last merge of a token is the only pair that can ever make it: merges inside it run as they do alone.
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                found = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
                low = min(found)
                if low >= rank:
                    break
                k = found.index(low)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) != 2:
                continue  # no merges lead to it
            if any(len(p) > 1 and ranks[p] >= rank for p in parts):
                raise ValueError(f"rank {rank} comes before that of its part, so equal pairs can't be merged at once")
            merges[ranks[parts[0]], ranks[parts[1]]] = rank
        return cls(ranks, merges)


    @property
    def pieces(self) -> list[bytes]:
        """The bytes of each id; ids that no token has are empty."""
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


#: Buckets of the rank map, multipliers of a pair's bucket and key.
BUCKETS, SPREAD, PAIR = 32768, 40503, 1 << 20
#: Words of more bytes are merged at all places of a pair at once.
SHORT = 64
#: Bits of an id and of its place in a cell of a short word, and the cell of an id that merges with nothing.
ID_BITS, PLACE_BITS = 20, 8
MERGE_AT = ID_BITS + PLACE_BITS
NO_MERGE = ((1 << ID_BITS) - 1) << MERGE_AT


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(merges: dict[tuple[int, int], int]) -> list[dict[int, int] | None]:
    buckets: list[dict[int, int] | None] = [None] * BUCKETS
    for (a, b), to in merges.items():
        k = (a * SPREAD + b) % BUCKETS
        buckets[k] = (buckets[k] or {}) | {a * PAIR + b: to}
    return buckets


def _merge_of(ranks: Column, a: Column, b: Column) -> Column:
    """What two ids merge to, null if they don't."""
    return F.try_element_at(F.get(ranks, F.pmod(a * SPREAD + b, F.lit(BUCKETS)).cast("int")), a * PAIR + b)


def _merges_of(ranks: Column, ids: Column) -> Column:
    """What each id and the next merge to."""
    return F.transform(ids, lambda a, i: _merge_of(ranks, a, F.get(ids, i + 1)))


def _fold_short(ids: Column, ranks: Column) -> Column:
    """Merge the leftmost pair of the lowest rank until no pair merges.

    A cell is one number: what the id and the next merge to, the id's first place, the id. So the least cell is the pair to merge, and a
    step looks up only the two pairs that it changes. Arrays are rewritten in place of joined: concat and slice cost more here.
    """
    low = lambda cell, bits: cell.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    merge = lambda a, b: F.coalesce(F.shiftleft(_merge_of(ranks, a, b), MERGE_AT), F.lit(NO_MERGE))

    def step(cells: Column, _: Column) -> Column:
        def swap(least: Column, k: Column) -> Column:
            to = F.shiftright(least, MERGE_AT)

            def cell(x: Column, i: Column) -> Column:
                merged = merge(to, low(F.get(cells, k + 1), ID_BITS)) + low(least, MERGE_AT) - low(least, ID_BITS) + to
                return F.when(i > k, x).when(i < k - 2, x).when(i == k - 1, merged).when(i == k - 2, merge(low(x, ID_BITS), to) + low(x, MERGE_AT))

            return F.array_compact(F.transform(cells, cell))

        next_cells = lambda least: F.when(least >= NO_MERGE, cells).otherwise(_let(F.array_position(cells, least).cast("int"), lambda k: swap(least, k)))
        return _let(F.array_min(cells), next_cells)

    cells = F.transform(ids, lambda a, i: merge(a, F.get(ids, i + 1)) + F.shiftleft(i.cast("bigint"), ID_BITS) + a)
    return _let(cells, lambda cells: F.aggregate(F.slice(cells, 2, F.size(cells)), cells, step, lambda cells: F.transform(cells, lambda x: low(x, ID_BITS))))


def _fold_long(ids: Column, ranks: Column) -> Column:
    """Merge all places of the pair of the lowest rank at once, from the left; ids are kept in a text such as <5><17>."""

    def step(text: Column, _: Column) -> Column:
        now = F.transform(F.split(F.substring(text, F.lit(2), F.length(text) - 2), "><"), lambda x: x.cast("bigint"))
        pair = lambda now, to, at: F.concat(F.lit("<"), F.get(now, at - 1), F.lit("><"), F.get(now, at), F.lit(">"))
        swap = lambda now, all_to, to: F.replace(text, pair(now, to, F.array_position(all_to, to).cast("int")), F.concat(F.lit("<"), to, F.lit(">")))
        done = lambda now, all_to: _let(F.array_min(all_to), lambda to: F.when(to.isNull(), F.concat(text, F.lit("!"))).otherwise(swap(now, all_to, to)))
        return F.when(text.endswith("!"), text).otherwise(_let(now, lambda now: _let(_merges_of(ranks, now), lambda all_to: done(now, all_to))))

    start = F.concat(F.lit("<"), F.array_join(ids.cast("array<string>"), "><"), F.lit(">"))
    back = lambda text: F.transform(F.split(F.translate(text, "<!", ""), ">"), lambda x: x.try_cast("bigint"))
    return F.filter(F.aggregate(ids, start, step, back), lambda x: x.isNotNull())


def fold_word(word: Column, byte_ids: Column, ranks: Column) -> Column:
    """The ids of a word, an array of bigint."""
    raw = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    ids = F.transform(raw, lambda c: F.get(byte_ids, F.ascii(c)))
    return _let(ids, lambda ids: F.when(F.size(ids) <= SHORT, _fold_short(ids, ranks)).otherwise(_fold_long(ids, ranks)))


def _joined(ids: Column, strings: Column) -> Column:
    """The bytes that the ids stand for, joined as they are: casts between strings and binary keep bytes."""
    return F.array_join(F.transform(ids, lambda i: F.get(strings, i)), "").cast("binary")


def _base64(items: list[bytes]) -> list[str]:
    return [base64.b64encode(x).decode() for x in items]


#: How the constants are read from JSON, and what they are: base64 becomes strings that hold the bytes as they are.
_TYPES = {
    "bytes": ("array<bigint>", "array<bigint>"), "ranks": ("array<map<string,bigint>>", "array<map<bigint,bigint>>"),
    "pieces": ("array<binary>", "array<string>"), "four": ("array<binary>", "array<string>"),
}
_TABLE = "array<map<string,array<bigint>>>"


class ByteBpe:
    """An encoder and decoder for one rank file and splitting pattern; its methods take and give columns.

    What they read is env, a struct of constants: bytes (the id of each byte), ranks, table, pieces and four (each id's bytes as it is decoded
    and packed). These are literals; after prepared, env is one checkpointed row instead, made of a small frame, so that no plan and no
    plan's text holds them.
    """

    def __init__(self, rank_file: str, pattern: str):
        self.vocabulary = Vocabulary.load(rank_file)
        self.pattern = java_pattern(pattern)
        self.one_row, self.table_size, self.entries = None, 1, None

    def _constants(self) -> dict[str, object]:
        v = self.vocabulary
        return {"bytes": [v.ranks[bytes([b])] for b in range(256)], "ranks": rank_map(v.merges), "pieces": _base64(v.pieces), "four": _base64([i.to_bytes(4, "little") for i in range(len(v.pieces))])}

    @property
    def env(self) -> Column:
        if self.one_row is not None:
            return F.col(ENV)
        return F.struct(json_literal([None], _TABLE).alias("table"), *(json_literal(c, _TYPES[name][0]).cast(_TYPES[name][1]).alias(name) for name, c in self._constants().items()))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def prepared(self, docs: DataFrame, words: int = TABLE_WORDS, sample: int = TABLE_SAMPLE, digests: bool = False) -> ByteBpe:
        """This encoder with a table of the most frequent words of a sample of docs, as a scalar subquery; it changes the time only.

        The table is bounded by words of at most LONGEST_TABLE_WORD characters; any other word is folded where it stands. With digests it
        is a frame of each word's packed ids and their bytes in place of the ids, which bpe_digests reads.
        """
        spark = docs.sparkSession
        texts = {name: json.dumps(c, separators=(",", ":")) for name, c in self._constants().items()}
        read = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{name} string" for name in texts))
        constants = cut(read.select(*(F.from_json(name, _TYPES[name][0]).cast(_TYPES[name][1]).alias(name) for name in texts)))
        no_table = F.lit(None).cast(_TABLE)
        self.one_row, self.table_size, self.entries = constants.select(F.struct(no_table.alias("table"), *texts).alias(ENV)), 1, None
        n = docs.count()
        picked = docs.select("text").sample(min(1.0, sample / max(n, 1)), seed=5).select(F.explode(self.words(F.col("text"))).alias("word"))
        counts = picked.filter(F.length("word").between(1, LONGEST_TABLE_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), "word").limit(words).select("word").repartition(2 * spark.sparkContext.defaultParallelism)
        if digests:
            self.entries = cut(self.over(cut(top)).select("word", self.digest_words(F.array("word"))[0].alias("entry")).select("word", "entry.*"))
            return self
        entries = cut(self.over(cut(top)).select("word", self.encode_words(F.array("word"))[0].alias("entry")))
        self.table_size = 1 << max(words - 1, 1).bit_length()  # about one word a bucket: Spark looks through a map from its start
        filled = entries.select(self._bucket(F.col("word")).alias("at"), F.struct("word", "entry").alias("entry")).groupBy("at").agg(F.collect_list("entry").alias("words"))
        buckets = spark.range(self.table_size).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
        ordered = F.sort_array(F.collect_list(F.struct("at", "words")))
        table = cut(buckets.agg(F.transform(ordered, lambda b: F.map_from_entries(b["words"])).alias("table")))
        # Two frames of one row each become one row.
        both = table.unionByName(constants, allowMissingColumns=True).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("table", *texts)))
        self.one_row = cut(both.select(F.struct("table", *texts).alias(ENV)))  # bounded by words
        return self

    def _bucket(self, word: Column) -> Column:
        return F.hash(word).bitwiseAND(F.lit(self.table_size - 1))

    def over(self, docs: DataFrame) -> DataFrame:
        """docs with env as a column, from which the methods read it.

        It is a scalar subquery, which the optimizer puts in place of the column: it comes once to each task as one block of bytes. That
        holds where a select reads env once; a column that is read twice would be copied into each row.
        """
        return docs if self.one_row is None else docs.withColumn(ENV, self.one_row.scalar())

    def _each(self, words: Column, entry: Callable[[Column, Column, Column], Column]) -> Column:
        """entry(what the table has for a word, the word, env) of each of an array of words."""
        known = lambda table, word: F.try_element_at(F.get(table, self._bucket(word)), word)
        return _let(self.env, lambda env: _let(env["table"], lambda table: F.transform(words, lambda w: entry(known(table, w), w, env))))

    def encode_words(self, words: Column) -> Column:
        """The ids of each of an array of words."""
        return self._each(words, lambda known, word, env: F.coalesce(known, fold_word(word, env["bytes"], env["ranks"])))

    def digest_words(self, words: Column) -> Column:
        """Of each of an array of words its ids packed as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        pair = lambda ids, env: F.struct(_joined(ids, env["four"]).alias("packed"), _joined(ids, env["pieces"]).alias("decoded"))
        return self._each(words, lambda known, word, env: _let(F.coalesce(known, fold_word(word, env["bytes"], env["ranks"])), lambda ids: pair(ids, env)))

    def encode(self, text: Column) -> Column:
        """The ids of a text, as the tiktoken library's encode_ordinary gives them; null and empty texts have none."""
        return F.flatten(self.encode_words(self.words(text)))

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids."""
        return _let(self.env, lambda env: _joined(ids, env["pieces"]))

    def packed(self, ids: Column) -> Column:
        """The ids as little-endian unsigned 32-bit integers."""
        return _let(self.env, lambda env: _joined(ids, env["four"]))


def encode_documents(docs: DataFrame, bpe: ByteBpe, text: str = "text") -> DataFrame:
    """docs with a column ids; rows and columns stay (a column ids is replaced), and nothing is shuffled.

    A null or empty text has no ids; texts of any length are encoded whole; repeated rows are encoded alike; an empty table stays empty.
    """
    env = free_name(docs, ENV)
    if env != ENV:
        return encode_documents(docs.withColumnRenamed(ENV, env), bpe, text).withColumnRenamed(env, ENV)
    return bpe.over(docs).select(*(F.col(c) for c in docs.columns if c != "ids"), bpe.encode(F.col(text)).alias("ids"))


def _row_runs(words: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Bounds of each row's words among those of all rows, for runs of rows of about RUN words, and where the run starts."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, side="right")) - 1)
        yield ends[at : to + 1] - ends[at], int(ends[at])
        at = to


def merged(word: bytes, byte_ids: list[int], merges: dict[int, int]) -> list[int]:
    """The ids of a word: the leftmost pair of the lowest rank merges until none does, in a word of more than SHORT bytes all its places at once."""
    ids = [byte_ids[b] for b in word]
    to = [merges.get(a * PAIR + b, PAIR) for a, b in zip(ids, ids[1:])]
    while to and (low := min(to)) < PAIR:
        if len(word) > SHORT:
            out, k = [], 0
            while k < len(ids):
                here = k < len(to) and to[k] == low
                out.append(low if here else ids[k])
                k += 1 + here
            ids = out
            to = [merges.get(a * PAIR + b, PAIR) for a, b in zip(ids, ids[1:])]
            continue
        k = to.index(low)
        ids[k : k + 2] = [low]
        del to[k]
        if k:
            to[k - 1] = merges.get(ids[k - 1] * PAIR + low, PAIR)
        if k < len(to):
            to[k] = merges.get(low * PAIR + ids[k + 1], PAIR)
    return ids


def join_words(words: pa.Array, known: list[pa.Array], fold: Callable[[str], tuple[bytes, bytes]]) -> pa.Array:
    """n_tokens, ids_sha256 and decoded_sha256 of each row's words; known are words, packed ids and decoded bytes, fold makes these of others."""
    codes = words.flatten().dictionary_encode()
    names, packed, decoded = known
    at = pc.index_in(codes.dictionary, value_set=names)
    lacking = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
    made = [fold(x) for x in codes.dictionary.take(pa.array(lacking)).to_pylist()]
    place = at.fill_null(0).to_numpy().astype(np.int64)
    place[lacking] = len(names) + np.arange(len(lacking))
    rows = []
    for k, some in enumerate((packed, decoded)):
        of_code = pa.concat_arrays([some.cast(pa.large_binary()), pa.array([m[k] for m in made], pa.large_binary())]).take(pa.array(place))
        lengths, sha = [], []
        for bounds, first in _row_runs(words):
            joined = of_code.take(codes.indices.slice(first, int(bounds[-1])))
            _, places, data = joined.buffers()
            at = np.frombuffer(places, np.int64)[bounds] if bounds[-1] else bounds
            view = memoryview(data) if data is not None else memoryview(b"")
            lengths += np.diff(at).tolist()
            sha += [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]
        rows.append((lengths, sha))
    (lengths, ids), (_, text) = rows
    return pa.StructArray.from_arrays([pa.array([n // 4 for n in lengths], pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])


def _table_digests(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """bpe_digests with a table; words that it lacks are merged in the tasks."""
    table = bpe.entries.select("word", "packed", "decoded").toArrow()  # bounded by the words of the table
    known = [pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in table.columns]
    v = bpe.vocabulary
    sent = docs.sparkSession.sparkContext.broadcast((known, [v.ranks[bytes([b])] for b in range(256)], {a * PAIR + b: to for (a, b), to in v.merges.items()}, v.pieces))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, byte_ids, merges, pieces = sent.value

        def fold(word: str) -> tuple[bytes, bytes]:
            ids = merged(word.encode(), byte_ids, merges)
            return np.array(ids, "<u4").tobytes(), b"".join([pieces[i] for i in ids])

        for batch in batches:
            found = join_words(batch.column(1), known, fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], names=["doc_id", *found.type.names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", bpe.words(F.col("text")).alias("words")).mapInArrow(joined, schema)


def bpe_digests(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; ids are packed and decoded word by word.

    Null texts are empty; whole texts of any length are read; repeated rows are encoded alike; an empty table gives no rows; other columns
    aren't read.
    """
    if bpe.entries is not None:
        return _table_digests(docs.select("doc_id", "text"), bpe)
    join = lambda words, name: F.array_join(F.transform(words[name], lambda x: x.cast("string")), "").cast("binary")
    row = lambda packed, decoded: F.struct(F.shiftright(F.octet_length(packed), 2).cast("long").alias("n_tokens"), F.sha2(packed, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
    made = _let(bpe.digest_words(bpe.words(F.col("text"))), lambda words: _let(join(words, "packed"), lambda packed: row(packed, join(words, "decoded"))))
    return bpe.over(docs.select("doc_id", "text")).select("doc_id", made.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
