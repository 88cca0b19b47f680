"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 3 bits apart meet in the middle: every fingerprint emits variants of itself, rows are shuffled
on the variant, and those that collide are verified. The radius 3 is odd, so its halves are 1 and 2, and parity says who
emits which: fingerprints 1 or 3 bits apart differ in parity, so the odd ones emit all variants 1 bit away and the even
ones those 2 bits away. Of three differing bits two lie in the same half of the word, so an even one needs only the
2 * C(32, 2) = 992 variants with both bits in one half. Fingerprints 2 bits apart have equal parity and meet at distance
1 from each. A variant is shared by at most 64 + 992 fingerprints whatever the corpus, so no group grows with the data
and no cap is needed; each is joined to one hub (a star), never to all others.

Radius 3 finds what is all but equal. near_dedup finds every similarity (Jaccard of distinct word shingles) of 0.8 or more
besides: BANDS hashes of ROWS MinHashes each bring texts of that similarity together with a probability of
1 - (1 - 0.8**6)**20 = 0.998 or more (SimHashes of such texts are some 10 of 64 bits apart, a ball of thousands of rows a
text even for shorter fingerprints), and each pair is verified by its shingles. Of those that share a band each is first
held against one hub; then, where a band has texts of several components, those of different components that share one of
their rarest shingles, as any two of that similarity do.

Defined results: null and empty texts have fingerprint 0 and are linked to each other and to what is near 0; fewer
words than a shingle count as one; repeated rows are linked; a component without any doc_id has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import carried, dealt_join, prefixed, prepare, salted_join, written

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: MinHashes of near_dedup.
BANDS, ROWS = 20, 6
_XOR, _MUL = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.array([[0], [1]], np.uint32)
_LANE = (np.arange(8) * 256).astype(np.uint16)


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over the XXH64 of word shingles, repeats included: a bit is set if it is in over half of them."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingles_of(text, words):
        counts += _bit_counts(h)
        n += len(h)
    return _majority(counts, n)


def shingles_of(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles in blocks, which bound the memory for very long texts."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    line, size = b" ".join(found), len(found)
    digest = xxhash.xxh64_intdigest
    if size <= words:
        yield np.array([digest(line, SEED)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[: size - words] + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    for at in range(0, size - words + 1, 1 << 16):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")


def _bit_counts(h: np.ndarray) -> np.ndarray:
    lanes = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    return (lanes @ _BITS).ravel()


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def sketch_of(text: str | None, words: int) -> tuple[int, int, list[int]]:
    """(fingerprint, hash of the set of shingles, band hashes); without a word there are no bands."""
    blocks = list(shingles_of(text, words))
    if not blocks:
        return 0, 0, []
    h = np.concatenate(blocks)
    fp = _majority(sum(map(_bit_counts, blocks)), len(h))
    h = np.unique(h)
    high = (h >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.min([((high[at : at + 512] ^ _XOR) * _MUL).min(0) for at in range(0, len(h), 512)], 0).tobytes()
    size = 4 * ROWS
    return fp, xxhash.xxh64_intdigest(h.tobytes(), SEED), [xxhash.xxh64_intdigest(least[k * size : (k + 1) * size], k) for k in range(BANDS)]


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text as a signed long."""

    @F.arrow_udf("long")
    def simhash64(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = np.array([fingerprint_of(x.as_py(), words) for x in batch], dtype=np.uint64)
            yield pa.array(out.view(np.int64))

    return simhash64(text)


_SKETCH = "struct<fp:bigint,shingled:bigint,bands:array<bigint>>"


def _sketch(text: Column, words: int) -> Column:
    @F.arrow_udf(_SKETCH)
    def sketches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            each = [sketch_of(x.as_py(), words) for x in batch]
            fp, key = (pa.array(np.array([x[k] for x in each], np.uint64).view(np.int64)) for k in (0, 1))
            ends = pa.array(np.cumsum([0, *(len(x[2]) for x in each)]), pa.int32())
            bands = pa.ListArray.from_arrays(ends, pa.array(np.array([y for x in each for y in x[2]], np.uint64).view(np.int64)))
            yield pa.StructArray.from_arrays([fp, key, bands], ["fp", "shingled", "bands"])

    return sketches(text)


def _shingle_set(text: Column, words: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def shingle_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([np.unique(np.concatenate([*shingles_of(x.as_py(), words), np.empty(0, "<u8")])).view(np.int64) for x in batch], pa.list_(pa.int64()))

    return shingle_sets(text)


def _variants(fps: DataFrame, flips: list[tuple[int, ...]]) -> DataFrame:
    """(variant, fp): each fp with the bits of each flip turned over, dealt out by variant. What is shuffled is the fp
    and the number of the flip, which compress far better than variants; the variant is made again where it arrives."""
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(1 << i for i in p) for p in flips)]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])
    variant = F.col("fp").bitwiseXOR(F.get(masks, F.col("flip")))
    dealt = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(flips) - 1))).alias("flip")).repartition(variant)
    return dealt.select(variant.alias("variant"), "fp")


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) at most 3 bits apart, each link verified."""
    # An even one's own value is what an odd neighbour 1 bit away emits.
    two = [()] + [(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    near = _variants(fps, [(i,) for i in range(64)])
    far = _variants(fps.where(F.bit_count("fp") % 2 == 0), two)
    hubs = near.groupBy("variant").agg(F.min("fp").alias("hub"), F.count("*").alias("n"))
    crossed = far.join(hubs.where(F.bit_count("variant") % 2 == 0).select("variant", "hub").hint("shuffle_hash"), "variant")
    level = near.join(hubs.where("n > 1").select("variant", "hub").hint("shuffle_hash"), "variant").where("fp <> hub")
    met = crossed.select("fp", "hub").unionByName(level.select("fp", "hub"))
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= 3).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b longs); the root is its component's least node.

    Alternates large and small stars, which needs about log2(diameter) rounds; lineage is cut after each."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub may have a third of all nodes around it, so a node's edges are dealt to several tasks.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", F.col("v"), 16).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", F.col("v"), 16).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        seen = now


def fingerprint_classes(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(fp, root, class_id, n) for each fp of rows (doc_id, fp): its component of near fingerprints, that one's least doc_id,
    and the rows of the fp. Stored.

    more: links (a, b) of fingerprints besides."""
    # Dealt out anew: a node is a few bytes here and a thousand rows in the next step.
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).repartition(wide, "fp").checkpoint()
    links = near_fingerprints(nodes.select("fp"))
    roots = connected(links if more is None else links.unionByName(more)).withColumnRenamed("node", "fp")
    placed = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n")).checkpoint()
    return written(dealt_join(placed, ids, ["root"], F.col("fp"), "inner").select("fp", "root", "class_id", F.col("rows").alias("n")))


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex), component_id for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    fps = docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")).checkpoint()
    out = dealt_join(fps, fingerprint_classes(fps), ["fp"], F.col("doc_id"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def _similar(pairs: DataFrame, sets: DataFrame, fifths: int) -> DataFrame:
    """Those of the pairs (a, b) of shingle sets (shingled, s) whose Jaccard similarity is so many fifths or more. A set with
    many partners is dealt to many tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(64)))
    left = salted.join(sets.select(F.col("shingled").alias("a"), F.col("s").alias("s_a")), "a")
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("shingled").alias("b"), F.col("s").alias("s_b")), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return left.join(right, ["b", "salt"]).where(5 * both >= fifths * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, fifths: int) -> DataFrame:
    """Pairs (a, b) of sets of different components (members: shingled, root) that may have that similarity, none left out.

    Two such sets share a shingle among each one's rarest: of n shingles, in order of the number of members that hold them,
    the first n * (5 - fifths) // 5 + 1 (whatever partner has so many in common with a set, they can't all come after
    these). Only sets that meet there, and whose sizes are near enough, make a pair: members that have much in common that is
    common to very many, as pages of one template have, make none."""
    held = written(sets.join(members, "shingled").select("shingled", "root", F.size("s").alias("size"), F.explode("s").alias("t")))
    known = written(held.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").withColumn("holders", F.col("n")))
    ranked = dealt_join(held, known, ["t"], F.col("shingled")).groupBy("shingled", "root", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("holders", F.lit(1)).alias("holders"), "t"))).alias("r"))
    rarest = F.slice("r", F.lit(1), F.floor(F.col("size") * (5 - fifths) / 5).cast("int") + 1)
    meet = written(ranked.select("shingled", "root", "size", F.explode(F.filter(rarest, lambda x: x["holders"] > 1)).alias("r")).select("shingled", "root", "size", F.col("r.t").alias("t")))
    left, right = (meet.select("t", F.col("shingled").alias(k), F.col("root").alias(f"root_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    sized = 5 * F.least("size_a", "size_b") >= fifths * F.greatest("size_a", "size_b")
    return left.join(right, "t").where(sized & (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b"))).select("a", "b").distinct()


def similar_sets(sketches: DataFrame, texts: DataFrame, words: int, fifths: int = 4) -> DataFrame:
    """Links (a, b) that connect the shingle sets of sketches (shingled, bands, id, key) of 0.8 similarity or more; texts: id,
    key, text."""
    rows = sketches.select("id", "shingled", F.explode("bands").alias("band"))
    # Summed before they are dealt out, a band of a third of all documents is a few rows; its holders are dealt to many tasks.
    ends = written(rows.groupBy("band").agg(F.min("shingled").alias("hub"), F.max("shingled").alias("last"), F.count("*").alias("n")).where("hub < last").select("band", "hub", "n"))
    shared = written(dealt_join(rows, ends, ["band"], F.col("id"), "inner").select("band", "shingled", "hub").distinct())
    # One row of texts for each set that shares a band. Written first, so that its size is known when the texts, which are far
    # larger, are planned.
    at = sketches.groupBy("shingled").agg(F.min(F.struct("id", "key")).alias("at")).join(shared.select("shingled").distinct(), "shingled")
    wanted = written(at.select("shingled", "at.id", "at.key"))
    sets = written(texts.join(wanted, ["id", "key"]).dropDuplicates(["shingled"]).select("shingled", _shingle_set(F.col("text"), words).alias("s")))
    stars = written(shared.where("shingled <> hub").select(F.col("shingled").alias("a"), F.col("hub").alias("b")).distinct())
    links = written(_similar(stars, sets, fifths))
    found = connected(links).withColumnRenamed("node", "shingled")
    placed = written(shared.select("band", "shingled").join(found, "shingled", "left").select("band", "shingled", F.coalesce("root", "shingled").alias("root")))
    several = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y and n > 2").select("band", "n")
    several = written(several)
    open_ = written(dealt_join(placed, several, ["band"], F.col("shingled"), "inner").select("shingled", "root").distinct())
    across = _across(open_, sets, fifths).join(stars, ["a", "b"], "left_anti")
    return links.unionByName(written(_similar(written(across), sets, fifths)))


def simhash_dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of docs for each component: that with the least doc_id, ties by text (null first), as it came.

    Of repeated rows of that doc_id and text one stays. Rows without doc_id come after all others."""
    prepare(docs.sparkSession)
    own = _identified(docs)
    narrow = own.select(F.col("in_doc_id").alias("doc_id"), fingerprint(F.col("in_text"), words).alias("fp"), "id", "key").checkpoint()
    return _firsts(docs, own, narrow, fingerprint_classes(narrow.select("doc_id", "fp")))


def near_dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """As simhash_dedup, but similarities of 0.8 or more (Jaccard of the distinct shingles) are linked as well."""
    prepare(docs.sparkSession)
    own = _identified(docs)
    narrow = written(own.select(F.col("in_doc_id").alias("doc_id"), "id", "key", _sketch(F.col("in_text"), words).alias("f")).select("doc_id", "id", "key", "f.*"))
    links = similar_sets(narrow.select("shingled", "bands", "id", "key"), own.select("id", "key", F.col("in_text").alias("text")), words)
    fps = narrow.where(F.size("bands") > 0).select("shingled", "fp").distinct()
    one = fps.groupBy("shingled").agg(F.min("fp").alias("b"))
    a, b = (one.select(F.col("shingled").alias(k), F.col("b").alias(f"fp_{k}")) for k in "ab")
    # Equal sets may differ in repeats, and so in fingerprint.
    more = fps.join(one, "shingled").select(F.col("fp").alias("a"), "b").unionByName(links.join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    return _firsts(docs, own, narrow, fingerprint_classes(narrow.select("doc_id", "fp"), more.where("a <> b")))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*prefixed(docs)).withColumns({"id": F.coalesce(F.col("in_doc_id").cast("string"), F.lit("-")), "key": F.xxhash64("in_text")})


def _firsts(docs: DataFrame, own: DataFrame, narrow: DataFrame, classes: DataFrame) -> DataFrame:
    classes = dealt_join(narrow.select("doc_id", "fp", "id", "key"), classes, ["fp"], F.struct("id", "key"), "inner")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "id")).alias("at"))
    # Repeated rows meet in the tasks that read them before they are dealt out.
    kept = own.dropDuplicates(["id", "key"]).join(first.select("at.id", "at.key").hint("merge"), ["id", "key"], "left_semi")
    return kept.select(*carried(docs, ()))
