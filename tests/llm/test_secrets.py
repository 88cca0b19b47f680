import re

from provenir.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, k, b) for a, _, k, b in sorted(found)]


TEXTS = [None, "", "nothing", "password=abcdef", "é漢😀 Token: 'abc123def' x", "secret=token: abcdefgh", "secret=tok", "api_key=\"A1b2c3\" APIKEY : zzzzzz", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 14 + "!", "f" * 24 + " " + "0" * 23, "token=" + "ab12" * 10, "password==secret=abcdef token=abc\npasswd:\t'x'", "TOKEN='" + "9" * 30 + "'" * 3 + "a" * 40]


def test_spans_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string")
    got, new = secrets.secret_scan(docs)
    assert all([(x.start, x.kind, x.end) for x in r.findings] == plain(r.text) for r in got.collect())
    assert new.count() == len({t or "" for t in TEXTS})


def test_only_unseen_pairs_are_scanned(spark):
    old = spark.createDataFrame([("p", 1, "token=abcdef"), ("q", 1, "plain")], "path string, commit int, text string")
    _, ledger = secrets.secret_scan(old)
    ledger = ledger.checkpoint()
    both = old.unionByName(spark.createDataFrame([("p", 2, "token=ghijkl"), ("r", 2, "token=abcdef")], old.schema))
    found, new = secrets.secret_scan(both, ledger)
    assert new.count() == 1 and sorted((r.path, r.commit) for r in found.where("size(findings) > 0").collect()) == [("p", 1), ("p", 2), ("r", 2)]
    assert secrets.secret_scan(both, ledger, rule_version="2")[1].count() == 3


def test_nasty(nasty, empty):
    found, _ = secrets.secret_scan(nasty)
    assert found.count() == nasty.count() and found.where("findings is null").count() == 0
    assert secrets.secret_scan(empty)[0].count() == 0
