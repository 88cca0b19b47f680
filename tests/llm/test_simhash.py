import random

import xxhash
from pyspark.sql import functions as F

from provenir.llm import simhash


def plain(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    for text in (None, "", " ", "One", "a b", "a b c", "A b C a b c", "é ü x y", "w " * 500, "x\x0by\x1cz"):
        for words in (1, 3, 5):
            assert simhash.fingerprint_of(text, words) == plain(text, words)


def test_links_are_whole(spark):
    """Dense clusters, chains and pairs at each distance, against all pairs."""
    rng, values = random.Random(11), set()
    for _ in range(25):
        v = rng.getrandbits(64)
        values.add(v)
        for d in (1, 2, 3, 3, 3, 4):
            x = v
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            values.add(x)
        for _ in range(6):
            for b in rng.sample(range(64), 3):
                v ^= 1 << b
            values.add(v)
    base = rng.getrandbits(64)
    values |= {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(i)} | {0, (1 << 64) - 1}
    want = components(values)
    fps = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(sorted(values))], "doc_id long, fp long")
    got = {r.fp: r.root for r in simhash.fingerprint_classes(fps).collect()}
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(got[signed(v)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_nasty(nasty):
    got = simhash.simhash_components(nasty).collect()
    assert len(got) == nasty.count()
    texts = nasty.select("doc_id", "text").collect()
    prints = {plain(r.text) for r in texts}
    want = components(prints)
    least = {}
    for r in texts:
        if r.doc_id is not None:
            k = want[plain(r.text)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(r.doc_id), format(plain(r.text), "016x"), least.get(want[plain(r.text)])) for r in texts)


def test_dedup_keeps_one_of_each(nasty):
    got = simhash.simhash_dedup(nasty, 3)
    assert got.columns == nasty.columns
    kept = [plain(r.text) for r in got.collect()]
    want = components({plain(r.text) for r in nasty.collect()})
    assert sorted(want[v] for v in kept) == sorted(set(want.values()))
    assert {r.doc_id for r in got.collect()} >= {1, 7, 8}


def test_large_group_of_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text again and again for all").alias("text"))
    assert simhash.simhash_components(docs).select("component_id").distinct().count() == 1
    assert [r.doc_id for r in simhash.simhash_dedup(docs).collect()] == [0]


def test_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.connected(links).collect()} == {0}


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def test_edited_copies_are_found(spark):
    """Copies with 1 to 4 words in a hundred replaced; those of a similarity of 0.8 or more go, and others don't."""
    rng, rows, similar = random.Random(21), [], {}
    for k in range(300):
        words = [f"k{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 500))]
        rows.append((k, " ".join(words)))
        for at in rng.sample(range(len(words)), max(1, len(words) * (1 + k % 4) // 100)):
            words[at] = f"new{k}x{at}"
        rows.append((1000 + k, " ".join(words).upper() if k % 2 else " ".join(words)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        similar[k] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(300)) and sum(s >= 0.8 for s in similar.values()) > 150
    missed = [k for k, s in similar.items() if s >= 0.8 and 1000 + k in kept]
    assert len(missed) <= 2 and all(1000 + k in kept for k, s in similar.items() if s < 0.7)


def test_a_pair_is_found_whose_hub_is_like_neither(spark):
    """Every text shares nine parts of ten with the others of a chain; each link counts, also within one band."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 10 : k * 10 + 200])) for k in range(20)] + [(50, " ".join(words[390:] + words[:100])), (51, None), (52, ""), (53, " x ")]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 50, 51, 53} or kept == {0, 50, 52, 53}


def test_near_dedup_of_nasty(nasty, empty):
    got = simhash.near_dedup(nasty)
    assert got.columns == nasty.columns and {1, 7, 8} <= {r.doc_id for r in got.collect()}
    assert not any((r.text or "").startswith("no id") for r in got.collect()) and simhash.near_dedup(empty).count() == 0


def test_across_leaves_out_no_pair(spark):
    """Random sets: every pair of different components that is similar enough is among the pairs, by brute force."""
    rng = random.Random(12)
    sets = {}
    for i in range(60):
        base = set(rng.sample(range(300), rng.randrange(1, 60)))
        for k in range(3):
            drop = {x for x in base if rng.random() < 0.1}
            sets[3 * i + k] = sorted((base - drop) | set(rng.sample(range(300), rng.randrange(0, 4))) or {0})
    roots = {i: i if rng.random() < 0.8 else i - i % 3 for i in sets}
    table = spark.createDataFrame(list(sets.items()), "shingled long, s array<bigint>")
    members = spark.createDataFrame(list(roots.items()), "shingled long, root long")
    got = {(r.a, r.b) for r in simhash._across(members, table, 4).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b) for a in sets for b in sets if a > b and roots[a] != roots[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert len(want) > 30 and want <= got and all(roots[a] != roots[b] and a > b for a, b in got)


def test_a_template_makes_no_pairs(spark):
    """Sets that share half of their shingles with all others, and none of the rest with any."""
    rows = [(i, list(range(50)) + list(range(1000 * (i + 1), 1000 * (i + 1) + 50))) for i in range(300)]
    table = spark.createDataFrame(rows, "shingled long, s array<bigint>")
    assert simhash._across(table.selectExpr("shingled", "shingled as root"), table, 4).count() == 0
