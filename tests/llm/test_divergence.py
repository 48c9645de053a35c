"""The divergence audit against dense counts in Python, and against its SQL."""

import collections
import random
import re

import duckdb
import pytest

from harvestline.llm import divergence
from harvestline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, min_docs=3, top=200):
    """All counts of all terms of all groups."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", source or "") for t, lang, source in rows]
    out = collections.Counter()
    for lang in {lang for _, lang, _ in rows}:
        df = collections.Counter(t for words, at, _ in rows if at == lang for t in set(words))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: collections.Counter() for _, at, s in rows if at == lang}
        for words, at, s in rows:
            if at == lang:
                counts[s].update(w for w in words if df[w] >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            found = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]}
            found["term"] = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                for rank, (value, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= top:
                        out[lang, s, part, item.decode(), -value, rank] += 1
    return out


def outcome(spark, rows, **how):
    data = [(i, *r, "clash", 1, 2) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, term string, chunk int, value int").repartition(3)
    got = divergence.source_divergence(df, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return collections.Counter(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mé", "文", "z𝒳") for b in ("", "ra", "TO", "ß", "Éa")]
    out = []
    for _ in range(160):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["web", "web", "web", "web", "books", "ünï", "", None])
        weights = [1 + (len(source or "") * k) % 7 for k in range(len(words))]
        out.append(("".join(w + r.choice([" ", " ", ", ", "-", "1", "\n\x00", "_"]) for w in r.choices(words, weights, k=r.randint(0, 25))), lang, source))
    out += [(None, "en", "blank"), ("", "xx", "one"), ("12 34 !?", "xx", "two"), ("rare words only", "yy", "one"), ("a a a A", "en", "web"), ("a", "en", "new"), ("a", "en", "new"), (None, None, None)]
    return out + out[:9]


def test_equals_dense_counts(spark, rows):
    want = brute(rows)
    assert any(part == "term" for _, _, part, *_ in want) and ("xx", "one", "pair", "two", 0, 1) in want
    assert outcome(spark, rows) == want
    assert outcome(spark, rows, block_bytes=300, most_bits=64) == want  # many automata, and a map that lets most terms through


def test_few_terms_and_other_thresholds(spark, rows):
    assert outcome(spark, rows, min_docs=1, top=2) == brute(rows, 1, 2)
    assert outcome(spark, rows, min_docs=500) == brute(rows, 500)


def test_long_text_and_one_source(spark):
    text = "alpha beta, " * 40_000 + "é" * 50_000
    rows = [(text, "en", "web"), ("alpha", "en", "web"), ("Alpha beta", "en", "web"), ("é" * 50_000, "en", "web")]
    assert outcome(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert outcome(spark, []) == collections.Counter()


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op13_source_divergence"](spark, SF)
    want = duck.sql(ORACLES["op13_source_divergence"])
    assert want.columns == got.columns
    assert collections.Counter(want.fetchall()) == collections.Counter(tuple(r) for r in got.collect())
