"""The pipeline's near-dedup against brute force: five-word shingles, similarity 0.8, any ids."""

import random

import pytest

from harvestline.llm import near_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    """Random texts, chains of edits around the similarity of 0.8, a passage that many share, short and empty ones."""
    r = random.Random(11)
    word = lambda: f"w{r.randint(0, 3000)}"
    out = [None, "", "one", "ONE", "a b c d", "a b c d e", "A B c d e"]
    passage = " ".join(word() for _ in range(40))
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 160))]
        out.append(" ".join(base))
        for _ in range(6):
            base = list(base) if r.random() < 0.5 else out[-1].split()
            for _ in range(r.randint(1, 4)):
                base[r.randrange(len(base))] = word()
            out.append(" ".join(base))
    out += [passage + " " + " ".join(word() for _ in range(n)) for n in (5, 6, 8, 9, 10, 12, 60, 60, 90)]
    return out


def test_near_dedup_is_that_of_brute_force(spark, texts):
    root = groups(texts)
    assert len(set(root)) < len(texts) - 20
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = near_text.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted({x for x in root})


def test_the_pipelines_stage_drops_what_is_similar(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    other = [*words[:50], "changed", *words[51:]]
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(other), "en", "s", 0), (3, " ".join(words[:70]), "en", "s", 0)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()) == [1, 3]


def edited(n, changes, seed):
    """A text and n - 1 of it with some of its words replaced: five-word shingles make them less similar than 0.8 to each other, mostly."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    out = [base]
    for _ in range(n - 1):
        out.append(list(base))
        for _ in range(changes):
            out[-1][r.randrange(len(base))] = f"x{r.randint(0, 10**9)}"
    return [" ".join(x) for x in out]


def test_a_group_short_of_the_similarity_emits_no_row_for_each_pair(spark, monkeypatch):
    texts = edited(150, 4, 3)
    made, cut = [], near_text.cut
    monkeypatch.setattr(near_text, "cut", lambda df: made.append(out := cut(df)) or out)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = near_text.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(groups(texts)))
    assert max(x.count() for x in made) <= near_text.BANDS * len(texts)  # there are 11,175 pairs


def test_small_tiles_and_parts_give_the_same_components(spark):
    texts = edited(60, 3, 5) + edited(40, 2, 6)
    rows = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "row string, doc_id long, text string")
    nodes = near_text.cut(near_text.sketches(rows).withColumn("node", near_text.F.col("doc_id")))
    want = groups(texts)
    for tile, part in ((1024, 1 << 20), (16, 500)):
        found = dict(map(tuple, near_text.components(near_text.similar_links(nodes, rows, tile, part)).collect()))
        assert [found.get(i, i) for i in range(len(texts))] == want


def test_tiles_take_several_population_counts_and_lose_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    flips = rng.random((600, 64)) < 0.12
    fps = [int(x) for x in np.packbits(flips, axis=1).view(np.uint64).ravel().view(np.int64)]
    roots = [0 if k < 300 else k for k in range(600)]
    rows = spark.createDataFrame([(k, fps[k], 100, [7], roots[k], 7) for k in range(600)], "node long, fp long, n long, keys array<long>, root long, key long")
    met, cells = {}, 0
    for r in near_text._root_tiles(rows, 128).collect():
        cells += len(r["cells"])
        for i, a in enumerate(r["cells"]):
            for b in r["cells"][:i]:
                if a["root"] != b["root"] and (a["side"] != b["side"] or a["side"] == 2):
                    pair = min(a["node"], b["node"]), max(a["node"], b["node"])
                    met[pair] = met.get(pair, 0) + 1
    near = {(i, j) for j in range(600) for i in range(j) if roots[i] != roots[j] and (fps[i] ^ fps[j]).bit_count() <= near_text.RADIUS}
    assert near <= set(met) and set(met.values()) == {1}
    assert cells <= 300 * 6 + 300 * 3  # three tiles of each side; one for each population count made over 8,000 cells
