import re

from pyspark.sql import functions as F

from provenir.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_measures_against_brute_force(spark, nasty):
    texts = ["a b c d e f g h " * 3, "a " * 9, "a " * 8, "x\ny\nx\n\n \nx ", "# é* <漢> |%&$", "one two three four five six seven eight nine " * 2 + "z " + "one two three four five six seven eight", "\x0b\x0ca\rb\x1cc"]
    docs = nasty.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(50 + i, t, "s1") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    for r in quality.quality_rules(docs).collect():
        want = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_frequent_lines_and_depleted_documents(spark):
    letters = "abcdefghijklmnopqrst"
    word = lambda i, j: "".join(letters[int(c)] for c in f"{i:03d}{j:02d}")
    own = lambda i, n=30: " ".join(word(i, j) for j in range(n))
    menus = [f"{k} Home  About\tContact us 2024 and more {k}" for k in ("news", "shop", "help")]
    menu = "\n".join(menus)
    rows = [(i, f"{own(i)}\n{menu.upper() if i % 2 else menu.replace('2024', '1999')}", "big.example") for i in range(40)]
    rows += [(100 + i, f"{menu}\n{own(100 + i, 5)}", "big.example") for i in range(5)]
    rows += [(200 + i, f"{own(200 + i)}\n{menu}", "small.example") for i in range(5)] + [(300 + i, own(777), "copies.example") for i in range(60)] + [(400, f"{own(400)}\n{menu}", None)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 27 and got[i].kept for i in range(40))
    assert all(got[100 + i].removed_words == 27 and not got[100 + i].base_failed and not got[100 + i].kept for i in range(5))
    assert all(got[200 + i].removed_words == 0 and got[200 + i].kept for i in range(5))
    assert all(got[300 + i].kept for i in range(60)) and got[400].kept


def test_columns_stay(nasty, empty):
    got = quality.quality_rules(nasty)
    assert set(nasty.columns) <= set(got.columns) and got.count() == nasty.count() and got.select("host").distinct().count() == 1
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_rules(nasty.withColumn("host", F.col("source")), host="host").count() == nasty.count()


def test_lines_over_the_limit_leave_the_text(spark):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(26))
    rows = [(i, f"{own(i)}\n\nHOME  page {i % 3}\n{own(i)} \n home page 7 \n", "big") for i in range(30)] * 2
    rows += [(100, f"{own(100)}\nhome page 1", "small"), (101, None, "big"), (102, "", "big")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 100:
            assert r.text_left == f"{own(r.doc_id)}\n\n{own(r.doc_id)} \n" and r.removed_words == 6
            assert len(r.text_left.split()) == r.n_words - r.removed_words
        else:
            assert r.text_left == r.text and r.removed_words == 0
