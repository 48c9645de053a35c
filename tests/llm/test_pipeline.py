"""run() against a brute-force version: rules, copies, near copies and ids exactly; the mix by its targets, whole documents and bounds."""

import base64
import collections
import random

import public_tokenizers as P

from harvestline.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    """Good texts of two sources, copies in other case, near copies, short ones, null and repeated ids, repeated rows, one id with two texts."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(800)]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 90)))
    rows = [(k, text(), "en", f"s{k % 2}", 0) for k in range(40)]
    rows += [(100 + k, rows[k][1].upper()[:50].lower() + rows[k][1][50:].capitalize(), "en", "s0", 0) for k in range(5)]
    rows += [(200 + k, " ".join([*rows[k + 10][1].split()[:-1], "changed"]), "en", "s1", 0) for k in range(5)]
    rows += [(300, "too short", "en", "s0", 0), (301, None, "en", "s1", 0), (None, text(), "en", "s0", 0), (7, text(), "en", None, 0), rows[3], rows[3]]
    return rows


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected(rows):
    """Texts that are left before the mix."""
    rules = (quality.BASE_RULES | quality.MORE_RULES).values()
    rows = [r for r in rows if not any(rule(quality.Text(r[1])) for rule in rules)]
    last = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        last[r[1].lower()] = r
    rows, root = list(last.values()), {}
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_run_is_that_of_brute_force(spark, tmp_path):
    import tiktoken

    import corpus_pipeline

    rows = make()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = expected(rows)
    assert len(left) == 42 and {r[0] for r in left} >= {None, 7, 103}
    known = {(r[0], tuple(own.encode_ordinary(r[1]))): r for r in left}
    copies = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out)
    assert set(copies) <= set(known) and all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert max(copies.values()) <= 3
    size, taken = collections.Counter(), collections.Counter()
    for key, r in known.items():
        size[r[3]] += len(r[1].split())
        taken[r[3]] += copies[key] * len(r[1].split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, free, want = float(sum(size.values())), set(order), {}
    while full := {s for s in free if whole / sum(weight[x] for x in free) * weight[s] > 3 * size[s]}:
        want |= {s: 3 * size[s] for s in full}
        whole, free = whole - sum(3 * size[s] for s in full), free - full
    want |= {s: whole / sum(weight[x] for x in free) * weight[s] for s in free}
    assert all(abs(taken[s] - want[s]) <= 90 for s in order)
