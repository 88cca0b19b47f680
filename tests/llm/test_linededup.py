import random
import re

from provenir.llm import linededup as ld


def lines(text):
    """Each line's words as they stand in the text."""
    _, cuts = ld.lines_of(text or "")
    words, out, a = iter(re.findall(r"[^\x20\x09-\x0D]+", text or "")), [], 0
    for b in cuts.tolist():
        out.append([next(words) for _ in range(b - a)])
        a = b
    assert next(words, None) is None
    return out


def split(text):
    """The lines of a text that hold a word, by their newlines alone."""
    return [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]


def plain(rows):
    """Rows (doc_id, text) in order; equal doc_ids are one document."""
    first, out = {}, {}
    for i, t in rows:
        u = [tuple(w.encode().lower() for w in x) for x in lines(t)]
        for k in range(len(u) - 2):
            first.setdefault(tuple(u[k : k + 3]), i)
    for n, (i, t) in enumerate(rows):
        own, seen, gone = lines(t), set(), set()
        u = [tuple(w.encode().lower() for w in x) for x in own]
        for k in range(len(u) - 2):
            w = tuple(u[k : k + 3])
            if w in seen or first[w] != i:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[n] = [w for k, x in enumerate(own) if k not in gone for w in x]
    return out


def text(rng, n):
    return "".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" + rng.choice([" ", " ", " ", "\n", ". "]) for _ in range(n))


def test_lines_keep_all_words():
    rng = random.Random(1)
    for t in ["", " ", "a", "a b c d e f\n\ng", "\n\n a\n\0 b c\n", "a b c d e\n\n\nf g", *(text(rng, 80) for _ in range(20))]:
        assert [w for x in lines(t) for w in x] == t.split() and all(len(x) <= ld.MOST for x in lines(t))


def test_against_brute_force(spark):
    rng, rows = random.Random(2), []
    passages = [text(rng, 70) for _ in range(6)]
    for i in range(120):
        rows.append((i, text(rng, rng.randrange(5, 120)) + (" " + rng.choice(passages).swapcase() if i % 3 else rng.choice(passages) * 2) + " " + text(rng, rng.randrange(60))))
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: t.split() for i, t in got.items()} == plain(rows)


def test_passages_go_and_the_first_stays(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{text(rng, 40)} {passage} {text(rng, 40)}") for i in range(30)]
    got = {r.doc_id: r for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].removed_lines == 0
    assert all(sum(w in passage.split() for w in got[i].text.split()) < 25 for i in range(1, 30))
    clean = [(i, text(rng, 90)) for i in range(20)]
    assert all(r.removed_lines == 0 for r in ld.line_dedup(spark.createDataFrame(clean, "doc_id long, text string")).collect())


def test_nasty(nasty, empty):
    got = ld.line_dedup(nasty)
    assert set(nasty.columns) <= set(got.columns) and got.count() == nasty.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[4] == [None] and by[5] == [""] and by[8] == ["x"] and len(by[1]) == 2 and by[1][0] == by[1][1] and by[2] == [""]
    assert ld.line_dedup(empty).count() == 0


def test_any_shared_run_of_over_50_words_has_a_common_window():
    """Planted at random places, amid text and as a paragraph of its own, also where words are few and ranks tie."""
    rng = random.Random(5)
    for k in range(1500):
        words = [f"w{rng.randrange((4000, 60, 6)[k % 3])}" for _ in range(900)]
        run, sep = " ".join(words[: 51 + k % 10]), (" ", "\n")[k // 3 % 2]
        found = []
        for at in (300, 600):
            before, after = words[at : at + rng.randrange(120)], words[at + 150 : at + 150 + rng.randrange(120)]
            t = " ".join(before) + sep + run + sep + " ".join(after)
            assert all(len(x) <= ld.MOST for x in lines(t))
            own, cuts = ld.windows_of(*ld.lines_of(t)).tolist(), ld.lines_of(t)[1].tolist()
            start, inside, spans = len(before), set(), list(zip([0, *cuts], cuts))
            for i, w in enumerate(own):
                if spans[i][0] >= start and spans[i + 2][1] <= start + 51 + k % 10:
                    inside.add(w)
            found.append(inside)
        assert found[0] & found[1]


def test_a_planted_run_goes_from_the_later_document(spark):
    rng, rows = random.Random(6), []
    for k in range(60):
        run = " ".join(f"run{k}x{rng.randrange(10**6)}" for _ in range(51))
        rows += [(2 * k + j, f"{text(rng, rng.randrange(20, 90))} {run} {text(rng, rng.randrange(20, 90))}") for j in (0, 1)]
    got = {r.doc_id: r.removed_lines for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] >= 3 for k in range(60))


def test_lines_are_lines():
    """Lines of few words are those between newlines; longer ones are cut within, and the same wherever they stand."""
    rng = random.Random(7)
    for _ in range(200):
        short = "\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 8))) for _ in range(rng.randrange(1, 30)))
        assert lines(short) == split(short)
        whole = ["".join(f"w{rng.randrange(50)} " for _ in range(rng.randrange(1, 40))) for _ in range(6)]
        for t in ("\n".join(whole), "before \n\n" + "\n".join(whole) + "\n \t\nafter it"):
            cut = lines(t)
            assert all(len(x) <= ld.MOST for x in cut) and [w for x in cut for w in x] == t.split()
            inside = cut if t.startswith(whole[0]) else cut[1:-1]
            assert inside == [piece for line in whole for piece in lines(line)]


def test_a_menu_of_four_short_lines_goes(spark):
    menu = "Home\nAbout us\nContact\nImprint"
    rng = random.Random(8)
    rows = [(i, f"{text(rng, 30)}\n{menu if i % 2 else menu.upper()}\n{text(rng, 30)}") for i in range(12)]
    rows += [(50, f"Home\nAbout us\nsomething else {text(rng, 9)}")]
    got = {r.doc_id: r for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[0].removed_lines == 0 and got[50].removed_lines == 0
    assert all(got[i].removed_lines == 4 and got[i].removed_words == 5 and "about" not in got[i].text.lower() for i in range(1, 12))


def test_windows_of_real_lines_against_brute_force(spark):
    """Lines by split alone, of few words, drawn from few, so that windows repeat within and across documents."""
    rng, rows = random.Random(9), []
    for i in range(150):
        rows.append((i, "\n".join(rng.choice(["", " "]) + " ".join(f"{rng.choice('abAB')}" for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(0, 14)))))
    first, want = {}, {}
    for i, t in rows:
        u = [tuple(w.lower() for w in x) for x in split(t)]
        own, gone = set(), set()
        for k in range(len(u) - 2):
            w = tuple(u[k : k + 3])
            if w in own or first.setdefault(w, i) != i:
                gone |= {k, k + 1, k + 2}
            own.add(w)
        want[i] = [w for k, x in enumerate(split(t)) if k not in gone for w in x]
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.text.split() for r in got} == want
    assert all(len(r.text.split()) + r.removed_words == len(dict(rows)[r.doc_id].split()) for r in got)


def test_chunks_reduce_a_window_to_its_first_holder():
    import numpy as np
    import pyarrow as pa

    t = "a b\nc d\ne f"
    batch = pa.record_batch({"p": [5, 3, 9, 3], "q": [0, 0, 0, 0], "text": [t, t, t + "\n" + t, t]})
    rows = [tuple(x.values()) for out in ld._holders(iter([batch])) for x in out.to_pylist()]
    w = int(ld.windows_of(*ld.lines_of(t))[0])
    assert sorted((p, known) for x, p, q, known in rows if x == w) == [(3, False), (5, True), (9, True)]
    assert [(p, known) for x, p, q, known in rows if x is None] == [(9, True)] and not np.any([q for _, _, q, _ in rows])


def test_small_chunks_and_blocks_say_the_same(monkeypatch):
    """What is known of each window's holders, whatever the sizes: windows by a plain loop over single texts."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    texts = ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(rng.randrange(0, 8))) for _ in range(60)] + ["", "x" * 300, "\n\n"]
    batch = pa.record_batch({"p": [i // 2 for i in range(63)], "q": [0] * 63, "text": texts})
    want = {}
    for i, t in enumerate(texts):
        for w in ld.windows_of(*ld.lines_of(t)).tolist():
            want.setdefault(w, set()).add(i // 2)
    for chunk, together, block in ((1 << 20, 1 << 19, 1 << 22), (1, 1, 1 << 22), (50, 100, 16), (7, 1 << 19, 64)):
        for name, value in (("CHUNK", chunk), ("TOGETHER", together), ("BLOCK", block)):
            monkeypatch.setattr(ld, name, value)
        rows = [tuple(x.values()) for out in ld._holders(iter([batch, batch.slice(0, 0)])) for x in out.to_pylist()]
        got, first = {}, {}
        for w, p, _, known in rows:
            if w is not None:
                got.setdefault(w, set()).add(p)
                if not known:
                    first.setdefault(w, set()).add(p)
        assert got == want and all(min(want[w]) in first[w] for w in want)
        twice = {i // 2 for i, t in enumerate(texts) if len(set(x := ld.windows_of(*ld.lines_of(t)).tolist())) < len(x)}
        assert {p for w, p, _, _ in rows if w is None} == twice and np.all([known for w, _, _, known in rows if w is None])


def test_rows_without_ids_are_told_apart_by_their_text(spark):
    rng = random.Random(10)
    passage = text(rng, 70)
    rows = [(None, f"{passage}\n{i} {text(rng, 9)}") for i in range(20)] + [(None, f"{passage}\n{0}")] * 2
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.removed_lines == 0 for r in got) == 1 + (rows[-1][1] in [r.text for r in got])
    named = ld.line_dedup(spark.createDataFrame([(f"id{i}", t) for i, (_, t) in enumerate(rows[:20])], "doc_id string, text string")).collect()
    assert sum(r.removed_lines == 0 for r in named) == 1
