"""Line dedup by overlapping three-line windows.

A line ends at every newline, and lines without a word don't count. A line of over MOST words is cut into pieces, each a
line of its own, so that a passage is found amid text as well: each word has a rank (its hash), and a piece ends after the
word of least rank among the NEAR words on either side. Of the words farther than NEAR from such an end, those least among
the FEW of them on either side end pieces too, and then those that are still near none. No piece has over MOST words.
Pieces depend on their own line alone, so equal lines have equal pieces wherever they stand; and whether a word ends one
depends on no word over NEAR + NEAR + FEW + FEW = 10 away: of a run of 50 words that two texts share, 10 at either end may be
cut differently, the first common end is one of the next 7 words, and three whole lines of at most 21 words follow it.

Each three consecutive lines are hashed (ASCII letters as lower case, white space as one space). A window that is found
again, in a document with a greater doc_id or further down in the same one, is a later occurrence; the lines that later
occurrences cover are merged and removed. What is removed is kept where it stands first: each removed line has an equal
one before it, and the first of these is not removed.

A window's holders are reduced where they are read, CHUNK windows at a time: all but the first holder of a chunk are later
ones already, and only the first is dealt out by window. So a window of a third of all documents arrives as one row a chunk,
windows are shuffled once, and a text meets its own later windows alone.

Defined results: null and empty texts, and those of fewer than three lines, come out as they went in; rows without
doc_id are ordered after all others, by a hash of their text; ids that are no whole numbers are ordered by a hash; rows
with the same doc_id, and rows without one that have the same text, count as one document, so repeated rows keep or lose
the same lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import carried, prefixed, prepare

NEAR, FEW = 3, 2
MOST = 2 * NEAR + 1
#: Windows that are reduced at a time, some 50 MB; bytes of texts that are read together.
CHUNK, TOGETHER = 1 << 20, 1 << 19
_SPLIT = re.compile(r"([\x20\x09-\x0D]+)").split
_NONE = np.int64(1 << 62)
#: Bytes of a text that are hashed at a time, about.
BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]").search
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(10).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_kept: dict[int, np.ndarray] = {}
_MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A word's weight in its line's hash, by place: odd numbers.
_PLACE = np.array([pow(0x2545F4914F6CDD1D, 2 * k + 1, 1 << 64) for k in range(MOST)], np.uint64)


def _powers(n: int, sign: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _kept.get(sign)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factor = pow(_BASE, sign, 1 << 64)
        have = np.full(size, factor, np.uint64)
        have[0] = 1
        _kept[sign] = have = np.multiply.accumulate(have)
    return have[:n]


def least(rank: np.ndarray, reach: int) -> np.ndarray:
    """Where a rank is less than all up to so many places before it and no greater than those after it."""
    n = len(rank)
    wide = np.full(n + 2 * reach, _NONE)
    wide[reach : reach + n] = rank
    found = rank < _NONE
    for k in range(1, reach + 1):
        found &= (rank < wide[reach - k : reach - k + n]) & (rank <= wide[reach + k : reach + k + n])
    return found


def near(ends: np.ndarray, reach: int) -> np.ndarray:
    """Places at most so far from an end."""
    found = ends.copy()
    for k in range(1, reach + 1):
        found[k:] |= ends[:-k]
        found[:-k] |= ends[k:]
    return found


def ends_of(rank: np.ndarray) -> np.ndarray:
    """Which words end a piece."""
    ends = least(rank, NEAR)
    taken = near(ends, NEAR)
    more = least(np.where(taken, _NONE, rank), FEW)
    return ends | more | ~(taken | near(more, FEW))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of newlines before it). A word's hash is a sum over its bytes, each with a weight of its
    own by value and by place: differences of running sums, so that a text is hashed without a step for each word."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[values], prepend=True, append=True))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE[values] * _powers(len(values), 1), out=sums[1:])
    h = (sums[stops] - sums[starts]) * _powers(len(values), -1)[starts]
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29)), np.searchsorted(np.flatnonzero(values == 10), starts)


def pieces_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index after each line's last word, number of newlines before each line) of lower-case bytes."""
    found, at, before = [], 0, 0
    while at < len(data):  # a block at a time, up to the next white space
        space = _SPACE(data, at + BLOCK)
        end = space.start() if space else len(data)
        hashes, line = words_of(data[at:end])
        found.append((hashes, line + before))
        before += data.count(b"\n", at, end)
        at = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, line = found[0] if len(found) == 1 else (np.concatenate([x[k] for x in found]) for k in (0, 1))
    if not len(hashes):
        return hashes, np.empty(0, np.int64), line
    cuts = np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, len(hashes))
    size = np.diff(cuts, prepend=0)
    long = size > MOST
    if long.any():
        # Long lines are laid out NEAR places apart, so that no word of one is near a word of another.
        inside = np.flatnonzero(np.repeat(long, size))
        at = np.arange(len(inside)) + NEAR * np.repeat(np.arange(int(long.sum())), size[long])
        rank = np.full(int(at[-1]) + NEAR, _NONE)
        rank[at] = (hashes[inside] >> np.uint64(2)).view(np.int64)
        ends = np.zeros(len(hashes), bool)
        ends[inside] = ends_of(rank)[at]
        ends[cuts - 1] = True
        cuts = np.flatnonzero(ends) + 1
    return hashes, cuts, line[cuts - 1]


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, ASCII letters as lower case; index after each line's last word)."""
    return pieces_of(text.encode().lower())[:2]


def windows_of(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hashes of each three consecutive lines, as signed longs."""
    if len(cuts) < 3:
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], cuts[:-1]))
    place = np.arange(len(hashes)) - np.repeat(starts, cuts - starts)
    h = np.add.reduceat((hashes ^ (hashes >> np.uint64(31))) * _PLACE[place], starts)
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    w = (h[:-2] * _MIX[0]) ^ (h[1:-1] * _MIX[1]) ^ (h[2:] * _MIX[2])
    w = (w ^ (w >> np.uint64(29))) * _MIX[0]
    return (w ^ (w >> np.uint64(32))).view(np.int64)


def without(text: str, windows: np.ndarray, cuts: np.ndarray, later: np.ndarray) -> tuple[str, int, int]:
    """(text without later occurrences, lines removed, words removed) of a text of these windows and line ends."""
    hit = np.ones(len(windows), bool)
    hit[np.unique(windows, return_index=True)[1]] = False
    hit |= np.isin(windows, later)
    covered = np.zeros(len(cuts), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    if not covered.any():
        return text, 0, 0
    if covered.all():
        return "", len(cuts), int(cuts[-1])
    gone = set(np.flatnonzero(covered).tolist())
    parts = _SPLIT(text)  # words and the white space between them, alternating
    out, removed, a, at, first = [], 0, 0, 0, 0 if parts[0] else 2
    for i, b in enumerate(cuts.tolist()):
        stop = first + 2 * b if i < len(cuts) - 1 else len(parts)
        if i not in gone:
            out.append("".join(parts[at:stop]))
        else:
            removed += b - a
            if out and i - 1 not in gone:
                out[-1] = out[-1].rstrip(" \t\n\x0b\x0c\r") + "\n"
        a, at = b, stop
    return "".join(out), len(gone), removed


_LEFT = "struct<text:string,removed_lines:bigint,removed_words:bigint>"


def together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, index after each line's last word, number of the text that holds each line) of lower-case texts, which are read
    as one; windows also where their lines are of two texts."""
    hashes, cuts, line = pieces_of(b"\n".join(texts))
    own = np.searchsorted(np.cumsum([t.count(b"\n") + 1 for t in texts]), line, side="right")
    return windows_of(hashes, cuts), cuts, own


def windows_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, number of the text that holds each) of lower-case texts."""
    w, _, own = together(texts)
    inside = own[:-2] == own[2:] if len(own) > 2 else np.empty(0, bool)
    return w[inside], own[: len(w)][inside]


def readings(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, index after each line's last word) of each of lower-case texts."""
    w, cuts, own = together(texts)
    bounds = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield w[a : max(a, b - 2)], cuts[a:b] - (cuts[a - 1] if a else 0)


def _reduced(w: np.ndarray, holder: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """A chunk's rows (w, p, q, known) of windows and their documents, which stand at (p, q): the first holder of each window;
    those that are known to be later; and a row without window for each document that repeats one."""
    rank = np.empty(len(p), np.int64)
    rank[np.lexsort((q, p))] = np.arange(len(p))
    by = np.argsort(rank[holder], kind="stable")
    by = by[np.argsort(w[by], kind="stable")]
    w, holder = w[by], holder[by]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    repeated = np.zeros(len(w), bool)
    repeated[1:] = ~new[1:] & (holder[1:] == holder[:-1])
    first = holder[np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))]
    stays = new | (~repeated & ((p[holder] != p[first]) | (q[holder] != q[first])))
    again = np.unique(holder[repeated])
    at = np.concatenate([holder[stays], again])
    seen = pa.array(np.concatenate([w[stays], np.zeros(len(again), np.int64)]), pa.int64(), mask=np.arange(len(at)) >= len(at) - len(again))
    known = np.concatenate([~new[stays], np.ones(len(again), bool)])
    whole = pa.record_batch({"w": seen, "p": pa.array(p[at]), "q": pa.array(q[at]), "known": pa.array(known)})
    return whole.take(pa.array(np.argsort(at, kind="stable")))  # by document, as places then compress


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, p, q, known) of rows (p, q, text), reduced a chunk at a time."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    ps: list[int] = []
    qs: list[int] = []
    texts: list[bytes] = []
    bytes_, size = 0, 0

    def read() -> int:
        nonlocal bytes_
        w, own = windows_in(texts)
        parts.append((w, own + len(ps) - len(texts)))
        texts.clear()
        bytes_ = 0
        return len(w)

    def flush() -> pa.RecordBatch:
        w, own = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        out = _reduced(w, own, np.array(ps, np.int64), np.array(qs, np.int64))
        for x in (parts, ps, qs):
            x.clear()
        return out

    for batch in batches:
        for p, q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ps.append(p)
            qs.append(q)
            texts.append((text.as_py() or "").encode().lower())
            bytes_ += len(texts[-1])
            if bytes_ >= TOGETHER:
                size += read()
                if size >= CHUNK:
                    yield flush()
                    size = 0
    if texts:
        read()
    if parts:
        yield flush()


def _rebuilt(text: Column, later: Column) -> Column:
    """What is left of a text; null for a null one."""

    kind = pa.struct([("text", pa.string()), ("removed_lines", pa.int64()), ("removed_words", pa.int64())])

    def rebuilt(texts: pa.Array, lists: pa.Array) -> Iterator[dict | None]:
        held: list[tuple[str, np.ndarray] | None] = []
        size = 0
        for i, (x, y) in enumerate(zip(texts, lists)):
            t = x.as_py()
            held.append(None if t is None else (t, np.array(y.as_py() or (), np.int64)))
            size += len(t or "")
            if size >= TOGETHER or i == len(texts) - 1:
                read = readings([h[0].encode().lower() for h in held if h])
                for h in held:
                    yield dict(zip(kind.names, without(h[0], *next(read), h[1]))) if h else None
                held, size = [], 0

    @F.arrow_udf(_LEFT)
    def without_later(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            yield pa.array(list(rebuilt(texts, lists)), kind)

    return without_later(text, later)


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row stands among all: by doc_id, and without one at the far end by a hash of its text."""
    i, last = F.col("in_doc_id"), F.lit((1 << 63) - 1)
    whole = docs.schema[[c.lower() for c in docs.columns].index("doc_id")].dataType.typeName() in ("byte", "short", "integer", "long")
    number = i.cast("long") if whole else F.when(i.isNotNull(), F.xxhash64(i.cast("string")))
    return F.coalesce(number, last), F.when(i.isNull(), F.xxhash64("in_text")).otherwise(0).cast("long")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with text as it remains, and removed_lines and removed_words."""
    prepare(docs.sparkSession)
    made = ("removed_lines", "removed_words")
    p, q = _place(docs)
    own = docs.select(*prefixed(docs)).withColumns({"p": p, "q": q})
    rows = own.select("p", "q", "in_text").mapInArrow(_holders, "w long, p long, q long, known boolean")
    # A row that is known to be later needs no other: it is dealt out by itself, however many hold its window.
    alone = [F.when(F.col("known"), F.col(c)) for c in ("p", "q")]
    first = F.min(F.struct("p", "q")).over(Window.partitionBy("w", *alone))
    later = rows.withColumn("first", first).where(F.col("known") | (F.struct("p", "q") > F.col("first")))
    touched = later.groupBy("p", "q").agg(F.collect_set("w").alias("later"))
    # Merged at every size. Python sees only the texts of which something goes.
    joined = own.join(touched.hint("merge"), ["p", "q"], "left")
    out = joined.withColumn("made", _rebuilt(F.when(F.col("later").isNotNull(), F.col("in_text")), F.col("later")))
    out = out.withColumn("in_text", F.when(F.col("later").isNotNull(), F.col("made.text")).otherwise(F.col("in_text")))
    return out.select(*carried(docs, made), *[F.coalesce(f"made.{c}", F.lit(0)).cast("long").alias(c) for c in made])
