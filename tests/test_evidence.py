"""Operators on small inputs whose results are known, with the cases that are easy to get wrong."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from provenir.functions import canon, refs
from provenir.operators import campaign, chain, compare, conversations, delivery, failures, ledger, manifests, markdown


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_quote_json_is_canonical(spark):
    texts = ['a"b\\c', "tab\tnl\ncr\r", "\x01\x1f\x0b\x7f", "é漢😀", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canon.quote_json(F.col("t")).alias("q")).collect()
    assert all(r.q == json.dumps(r.t, ensure_ascii=False) for r in got)


def test_canonical_json():
    assert canon.canonical_text('{"b":1.0,"a":[1e16,"é"]}') == '{"a":[1e+16,"é"],"b":1.0}'
    assert canon.canonical_text("{") is None and canon.canonical_text("NaN") is None and canon.canonical_text(None) is None


def test_digest_predicate(spark):
    d = "a" * 64
    got = spark.createDataFrame([(d,), (d + "\n",), (d.upper(),), (d[1:],), (None,)], "t string").select(canon.is_digest(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False]


def test_is_close(spark):
    pairs = [(1.0, 1.05, True), (1.0, 1.2, False), (float("inf"), float("inf"), True), (float("inf"), 1.0, False), (float("nan"), float("nan"), False)]
    got = spark.createDataFrame(pairs, "a double, b double, w boolean").select(canon.is_close(F.col("a"), F.col("b"), 0.0, 0.1).alias("x"), "w").collect()
    assert all(r.x == r.w for r in got)


def test_tree_problems(spark):
    d = "0" * 64
    text = lambda *e: "".join(f"{p}\0{x}\0" for p, x in e)
    cases = {
        "": None, text(("a", d), ("b/c", d)): None, text(("a", d))[:-1]: "truncated", "a\0": "odd", text(("../a", d)): "path", text(("a", "x")): "digest",
        text(("b", d), ("a", d)): "order", text(("a", d), ("a", d)): "order", text(("a", d), ("a/b", d)): "clash", text(("/a", d)): "path",
    }
    got = spark.createDataFrame(list(cases.items()), "t string, w string").select("w", manifests.tree_problem(F.col("t")).alias("p")).collect()
    assert all(r.w == r.p for r in got)


def test_tree_digest(spark):
    df = spark.createDataFrame([("r", "b", "2"), ("r", "a", "1")], "record_id string, path string, digest string")
    assert rows(manifests.tree_digest(df, "record_id")) == [("r", 2, hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest())]


def _chain_rows(n):
    out, prev = [], "0" * 64
    for i in range(1, n + 1):
        body = json.dumps({"i": i})
        digest = hashlib.sha256(json.dumps({"at": "t", "body": body, "kind": "k", "prev": prev, "seq": i, "subject": "s"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        out.append(["c", i, "k", "s", body, "t", prev, digest])
        prev = digest
    return out


CHAIN = "chain string, seq long, kind string, subject string, body string, `at` string, prev_hash string, hash string"


def test_chain_built_and_verified(spark):
    want = _chain_rows(6)
    events = spark.createDataFrame([("c", r[1], "k", "s", r[4], "t") for r in want], "chain string, ord long, kind string, subject string, body string, `at` string")
    made = chain.build_chain(events)
    assert rows(made, "seq", "hash") == [(r[1], r[7]) for r in want]
    assert chain.verify_chain(spark.createDataFrame(want, CHAIN)).count() == 0


@pytest.mark.parametrize(
    "change,want",
    [
        (lambda r: r[2].__setitem__(4, "{}"), [(3, "altered")]),
        (lambda r: r.pop(2), [(4, "broken"), (4, "gap")]),
        (lambda r: r.pop(0), [(2, "broken"), (2, "gap")]),
        (lambda r: r[3].__setitem__(7, "f" * 64), [(4, "altered"), (5, "broken")]),
        (lambda r: (r.pop(1), r.pop(1)), [(4, "broken"), (4, "gap")]),
    ],
)
def test_chain_tampering(spark, change, want):
    rows_ = _chain_rows(6)
    change(rows_)
    assert rows(chain.verify_chain(spark.createDataFrame(rows_, CHAIN)), "seq", "problem") == want


def test_anchor_verdicts(spark):
    rows_ = _chain_rows(5)
    anchors = [("c", 5, rows_[4][7]), ("c", 7, "x"), ("c", 3, "x")]
    got = [rows(chain.check_anchor(spark.createDataFrame(rows_, CHAIN), spark.createDataFrame([a], "chain string, anchor_seq long, anchor_hash string")))[0][1] for a in anchors]
    assert got == ["ok", "truncated", "differs"]
    cut = [r for r in rows_ if r[1] != 3]
    assert rows(chain.check_anchor(spark.createDataFrame(cut, CHAIN), spark.createDataFrame([anchors[2]], "chain string, anchor_seq long, anchor_hash string")))[0][1] == "gap"


def _fold(log):
    """The sequential reading of a delivery log: attempts that are open, and whether something was written since removal."""
    open_, written, outstanding, loose = set(), False, False, False
    for event, attempt, done in log:
        if event == "intent":
            if attempt is None:
                if loose:
                    written = True
                loose = True
            else:
                open_.add(attempt)
        elif event in ("receipt", "failure"):
            if event == "receipt" or done is None or done != 0:
                written = True
            if attempt is None:
                loose = False
            else:
                open_.discard(attempt)
        elif event == "removal_receipt":
            written = False
    return written or bool(open_) or loose


def test_possibly_written_equals_the_fold(spark):
    rng, logs, data = random.Random(5), {}, []
    for k in range(400):
        log = [(rng.choice(["intent", "receipt", "failure", "removal_intent", "removal_receipt", "removal_failure"]), rng.choice([None, "a", "b"]), rng.choice([None, 0, 2])) for _ in range(rng.randrange(1, 9))]
        logs[f"d{k}"] = _fold(log)
        data += [(f"d{k}", i, *e) for i, e in enumerate(log)]
    got = delivery.possibly_written(spark.createDataFrame(data, "dispatch_id string, event_id long, event string, attempt_id string, done int"))
    assert dict(rows(got)) == logs


def test_branching_conversation(spark):
    nodes = [("c", "r", None, 0, ""), ("c", "u", "r", 1, "hi"), ("c", "a1", "u", 2, "one"), ("c", "a2", "u", 3, "two"), ("c", "x", "a2", 4, "deep"), ("c", "o", "gone", 5, "orphan")]
    current = spark.createDataFrame([("c", "x")], "conv_id string, current_node string")
    got = conversations.flatten(spark.createDataFrame(nodes, "conv_id string, node_id string, parent string, ord long, text string"), current)
    by = {r.node_id: r for r in got.collect()}
    assert [r.node_id for r in sorted(by.values(), key=lambda r: r.ord)] == ["r", "u", "a1", "a2", "x", "o"]
    assert (by["a2"].depth, by["a2"].sibling_index, by["a2"].sibling_count, by["a2"].child_count) == (2, 1, 2, 1)
    assert by["u"].parent_node_id is None and by["x"].parent_node_id == "a2"
    assert {n for n, r in by.items() if r.on_current_branch} == {"r", "u", "a2", "x"}
    assert by["o"].sibling_index == 1 and by["o"].sibling_count == 1 and by["r"].branch_count == 3


def test_deep_conversation(spark):
    n = 5000
    nodes = [("c", f"n{i}", f"n{i - 1}" if i else None, i, "x") for i in range(n)]
    got = conversations.flatten(spark.createDataFrame(nodes, "conv_id string, node_id string, parent string, ord long, text string"))
    assert got.agg(F.max("depth")).first()[0] == n - 1


def test_render(spark):
    cases = {
        '{"content_type":"text","parts":["a","","b"]}': "a\n\nb", '{"content_type":"code","text":"x = 1\\n"}': "x = 1",
        '{"content_type":"multimodal_text","parts":[{"content_type":"image_asset_pointer","asset_pointer":"file-1"},"see"]}': "[image_asset_pointer: file-1]\n\nsee",
        '{"content_type":"thoughts","thoughts":[{"summary":"s","content":"c"},{"content":"d"}]}': "s\nc\n\nd",
        '{"content_type":"user_editable_context","user_profile":"p","user_instructions":"i"}': "p\n\ni", '{"content_type":"execution_output","text":"out"}': "out", '{"content_type":"odd"}': "", "null": "",
    }
    got = spark.createDataFrame(list(cases.items()), "c string, w string").select("w", conversations.render(F.col("c")).alias("t")).collect()
    assert all(r.w == r.t for r in got)


def test_split_export():
    data = '[ {"a": "x]}\\"é"} ,\n{"b":[{}]}]\n'.encode()
    assert [data[a : a + n].decode() for _, a, n in conversations.split_export(data)] == ['{"a": "x]}\\"é"}', '{"b":[{}]}']
    assert conversations.split_export(b" [] ") == []
    for bad in (b"", b"{}", b"[1]", b"[{}", b'[{"a":1]', b"[{}{}]", b"[{},]", b"[{}] x", b"[{]}]"):
        with pytest.raises(ValueError):
            conversations.split_export(bad)


MD = b"""# Title

Para one
line two

Sub
---

- item
- more

```py
x

y
```
| a | b |
text
~~~
open

$$ e $$
"""


def test_markdown_blocks():
    got = [MD[a:b].split(b"\n")[0] for a, b in markdown.blocks_of(MD)]
    assert got == [b"# Title", b"Para one", b"Sub", b"- item", b"```py", b"| a | b |", b"~~~"]
    assert markdown.blocks_of(b"a\r\n\r\nb\rc") == [(0, 1), (5, 8)]
    assert markdown.blocks_of(b"- x\n---") == [(0, 7)] and markdown.blocks_of(b"") == [] and markdown.blocks_of(b"x\n\n===") == [(0, 1), (3, 6)]


def test_markdown_units(spark):
    got = markdown.normalise(spark.createDataFrame([(1, bytearray(MD))], "key long, content binary")).orderBy("ord").collect()
    assert [(r.kind, r.level, r.parent) for r in got] == [("heading", 1, None), ("paragraph", None, "u000001"), ("heading", 2, "u000001"), ("list", None, "u000003"), ("code", None, "u000003"), ("table", None, "u000003"), ("code", None, "u000003")]


def test_section_parent_equals_a_stack(spark):
    rng, data, want = random.Random(3), [], {}
    for key in range(60):
        stack = []
        for i in range(12):
            level = rng.choice([None, 1, 2, 3, 4, 5, 6])
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            want[key, i] = stack[-1][1] if stack else None
            if level:
                stack.append((level, f"u{i + 1:06d}"))
            data.append((key, i, "heading" if level else "paragraph", level))
    got = markdown.with_sections(spark.createDataFrame(data, "key long, ord int, kind string, level int")).collect()
    assert {(r.key, r.ord): r.parent for r in got} == want


def test_references_round_trip(spark):
    d = "0123456789abcdef" * 4
    good = [f"provenir:source:{d}", f"provenir:snapshot:tree:{d}", f"provenir:record:r.1-x@{d}", f"provenir:observation:r@{d}", f"provenir:event:7@{d}", f"provenir:anchor:r@{d}/a%20b/c.md@{d}#bytes=0-9", f"provenir:anchor:r@{d}/c@{d}#pointer=/a~1b/0&render=json-string"]
    bad = [f"provenir:source:{d.upper()}", f"provenir:source:{d}\n", f"provenir:snapshot:dir:{d}", f"provenir:event:0@{d}", f"provenir:event:07@{d}", f"provenir:record:-x@{d}", f"provenir:anchor:r@{d}/a b@{d}#bytes=0-9", f"provenir:anchor:r@{d}/a@{d}#bytes=9-0", f"provenir:anchor:r@{d}/a@{d}#bytes=00-9", f"provenir:anchor:r@{d}/%61@{d}#bytes=0-9", "other:source:x", f"provenir:what:{d}"]
    got = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", refs.parse_ref(F.col("t")).alias("p")).collect()
    assert [r.t for r in got if r.p] == good
    assert [r.p for r in got if r.t == good[-1]][0].pointer == "/a~1b/0"


def test_json_policy():
    policy = compare.JsonPolicy(compare.Tolerance(), frozenset({"t"}), {"bbox": compare.Tolerance(abs=1.0)})
    find = lambda a, b: [p for p, _ in policy.findings(a, b)]
    assert find({"bbox": [1.0, 2.0], "t": 1}, {"bbox": [1.5, 2.9], "t": 2}) == []
    assert find({"bbox": {"l": [0.0]}}, {"bbox": {"l": [2.0]}}) == ["/bbox/l[0]"]
    assert find({"n": 1}, {"n": 2}) == ["/n"] and find({"n": True}, {"n": 1}) == ["/n"] and find({"n": 1}, {"n": 1.0}) == [] and find([1], [1, 2]) == [""]
    assert find({"a": 1, "b": 1.0}, {"c": 1, "b": 1.1}) == ["/a", "/c", "/b"] and find(None, 0) == [""]
    with pytest.raises(ValueError):
        compare.Tolerance(-1.0)


def test_lane_outcomes(spark):
    base = {"d1": ("sealed", None, "h"), "d2": ("sealed", None, "h"), "d3": ("failed", "timeout", None), "d4": ("not_applicable", None, None), "d5": ("sealed", None, "h"), "d6": ("failed", None, None), "d7": ("failed", "timeout", None), "d8": ("error", None, None), "d9": ("not_applicable", None, None), "e1": ("sealed", None, "h")}
    cand = {"d1": ("sealed", None, "h"), "d2": ("sealed", None, "x"), "d3": ("failed", "timeout", None), "d4": ("not_applicable", None, None), "d5": ("failed", "x", None), "d6": ("failed", None, None), "d7": ("sealed", None, "h"), "d8": ("sealed", None, "h"), "d9": ("sealed", None, "h"), "e1": ("sealed", None, "y")}
    obs = [(p, lane, *v, 1.0) for lane, all_ in (("b", base), ("c", cand)) for p, v in all_.items()]
    corpus = spark.createDataFrame([(p,) for p in [*base, "zz"]], "path string")
    accepted = spark.createDataFrame([("e1", "c")], "path string, lane string")
    got = campaign.compare_lanes(corpus, spark.createDataFrame(obs, "path string, lane string, status string, reason string, artifact_hash string, wall_time_seconds double"), "b", ["c"], accepted)
    assert dict(rows(got, "path", "outcome")) == {"d1": "identical", "d2": "diverged", "d3": "consistent_failure", "d4": "not_applicable", "d5": "regression", "d6": "consistent_failure", "d7": "recovered", "d8": "error", "d9": "failure_mismatch", "e1": "equivalent", "zz": "incomplete"}


def test_failures(spark):
    base = dict(timed_out=False, seconds=1.0, timeout_seconds=10.0, syscall_filter=True, trap=None, memory=0, memory_cap=1)
    cases = [("bubblewrap", 159, {}, "syscall_blocked"), ("bubblewrap", 159, {"syscall_filter": False}, "crashed"), ("bubblewrap", -9, {}, "crashed"), ("bubblewrap", 0, {}, None), ("oci-runc", 137, {}, "out_of_memory"), ("oci-runc", 137, {"seconds": 9.6}, "timeout"), ("oci-runc", 126, {}, "engine_error"), ("wasmtime", 1, {"trap": "fuel"}, "cpu_limit"), ("wasmtime", 1, {"trap": "unreachable", "memory": 1}, "out_of_memory"), ("wasmtime", 1, {"trap": "unreachable"}, "crashed"), ("x", 3, {}, "exit_status")]
    data = [{"backend": b, "exit_code": c, "want": w, **base, **more} for b, c, more, w in cases]
    got = failures.classify(spark.createDataFrame(data, "backend string, exit_code int, want string, timed_out boolean, seconds double, timeout_seconds double, syscall_filter boolean, trap string, memory long, memory_cap long"))
    assert all(r.failure == r.want for r in got.collect())


def test_state_fold_and_illegal_transitions(spark):
    data = [(1, "a", "record.created"), (2, "a", "record.sealed"), (3, "a", "record.failed"), (4, "b", "record.sealed"), (5, "c", "record.created"), (6, "c", "record.failed"), (7, "c", "record.failed"), (8, "c", "record.invalidated")]
    events = spark.createDataFrame([(*x, "{}") for x in data], "seq long, subject string, kind string, body string")
    assert rows(ledger.illegal_transitions(events), "record_id", "seq") == [("a", 3), ("b", 4), ("c", 8)]
    assert dict(rows(ledger.fold_states(events))) == {"a": "failed", "c": "invalidated"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "record_id string, path string, digest string")
    assert manifests.manifest_diff(none, none, "record_id").count() == 0 and manifests.tree_digest(none, "record_id").count() == 0
    assert chain.verify_chain(spark.createDataFrame([], CHAIN)).count() == 0
    assert conversations.flatten(spark.createDataFrame([], "conv_id string, node_id string, parent string, ord long, text string")).count() == 0


def test_pending_takes_all_lanes(spark):
    corpus, seen = spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("p", "l3")], "path string, lane string")
    lanes = spark.range(1500).select(F.concat(F.lit("l"), "id").alias("lane"), F.col("id").cast("int").alias("lane_order"))
    assert campaign.pending(corpus, lanes, seen).count() == 2999
    assert rows(campaign.pending(corpus, lanes, seen, at_most=4)) == [("p", "l0"), ("p", "l1"), ("p", "l2"), ("p", "l4")]


LISTED = "conv_id string, node_id string, parent string, children array<string>, ord long, text string, children_ok boolean"


def test_children_lists(spark):
    """Order of lists, ids that name no node, a root whose parent is not there."""
    nodes = [("c", "r", "out", ["b", "lost", "a"], 0, "", True), ("c", "a", "r", None, 1, "first by ord", True), ("c", "b", "r", ["x"], 2, "second", True), ("c", "x", "b", [], 3, "deep", True)]
    got = {r.node_id: r for r in conversations.flatten(spark.createDataFrame(nodes, LISTED)).collect()}
    assert [got[n].ord for n in ("r", "b", "x", "a")] == [0, 1, 2, 3]
    assert (got["a"].sibling_index, got["a"].sibling_count, got["r"].child_count, got["x"].parent_node_id, got["r"].branch_count) == (1, 2, 2, "b", 2)


@pytest.mark.parametrize(("change", "problem"), [({"r": ["a", "a"]}, "reached twice"), ({"a": ["r"]}, "reached twice"), ({"r": ["a"]}, "cycle"), ({"r": ["b", "a"]}, None)])
def test_lists_that_are_no_trees(spark, change, problem):
    lists = {"r": ["a", "b"], "a": None, "b": None, **change}
    nodes = [("c", n, None if n == "r" else "r", lists[n], i, "t", True) for i, n in enumerate(lists)]
    assert {r.problem for r in conversations.flatten(spark.createDataFrame(nodes, LISTED)).collect()} == {problem}
    broken = [(*x[:6], x[1] != "a") for x in nodes]
    assert [(r.problem, r.node_id) for r in conversations.flatten(spark.createDataFrame(broken, LISTED)).collect()] == [("children are no list", None)]


def test_placing_against_recursion():
    """Random trees, by a plain recursive walk."""
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 40)
        ids = [f"n{i}" for i in range(n)]
        parents = [None if i == 0 or rng.random() < 0.1 else f"n{rng.randrange(i)}" for i in range(n)]
        shown = [rng.random() < 0.6 for _ in ids]
        below = {x: [c for c, p in zip(ids, parents) if p == x] for x in ids}
        for c in below.values():
            rng.shuffle(c)
        want = []

        def walk(node, depth, place, above):
            want.append((node, depth, place, above))
            for k, c in enumerate(below[node]):
                walk(c, depth + 1, k, node if shown[ids.index(node)] else above)

        for k, root in enumerate(x for x, p in zip(ids, parents) if p is None):
            walk(root, 0, k, None)
        got = sorted(conversations._placed(ids, parents, [below[x] for x in ids], shown, None, True)["nodes"], key=lambda x: x["ord"])
        assert [(ids[x["node"]], x["depth"], x["sibling_index"], None if x["above"] is None else ids[x["above"]]) for x in got] == want


def test_parse_conversation():
    text = json.dumps({"mapping": {"r": {"children": ["a", 3], "message": {"content": {"parts": ["x"]}}}, "a": {"parent": "r", "children": "b"}, "s": "no object", "t": {"parent": 7, "children": None}}})
    got = conversations.parse_conversation(text)
    assert [(x["node_id"], x["parent"], x["children"], x["children_ok"]) for x in got] == [("r", None, ["a"], True), ("a", "r", None, False), ("s", None, None, True), ("t", None, None, True)]
    assert got[0]["content"] == '{"parts": ["x"]}' and conversations.parse_conversation("{}") == []
    with pytest.raises(ValueError, match="mapping"):
        conversations.parse_conversation('{"mapping":[]}')


def test_roots_and_duplicate_nodes(spark):
    nodes = spark.createDataFrame([("c", "a", None), ("c", "b", "a"), ("c", "b", "a"), ("c", "d", "gone"), ("e", "a", "a")], "conv_id string, node_id string, parent string")
    assert rows(conversations.roots(nodes), "conv_id", "node_id") == [("c", "a"), ("c", "d")]
    assert rows(conversations.duplicate_nodes(nodes)) == [("c", "b", 2)]


def test_chains_go_on_from_a_head_and_in_order(spark):
    events = [(c, i, "k", f"s{i}", '{"q":"\\u0001\\""}', "t") for c in ("x", "y", None) for i in (3, 1, 2)]
    made = chain.build_chain(spark.createDataFrame(events, "chain string, ord long, kind string, subject string, body string, `at` string").repartition(4), first=7, prev="f" * 64)
    got = {}
    for r in made.collect():
        got.setdefault(r.chain, []).append(r)
    for log in got.values():
        last = "f" * 64
        for n, r in enumerate(sorted(log, key=lambda r: r.seq)):
            body = {"at": r.at, "body": r.body, "kind": r.kind, "prev": last, "seq": 8 + n, "subject": f"s{n + 1}"}
            last = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            assert (r.seq, r.subject, r.hash) == (8 + n, f"s{n + 1}", last)
    assert len(got) == 3


def test_clash_looks_folders_up(spark):
    d = "0" * 64
    many = "".join(f"f{i:05d}/x\0{d}\0" for i in range(20_000))
    got = spark.createDataFrame([(many,), (many + f"f19999/x/y\0{d}\0",), (f"a\0{d}\0a.b/c\0{d}\0",)], "t string").select(manifests.tree_problem(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [None, "clash", None]


def test_file_sets_under_a_policy(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = {"1": '{"v":1.0}', "2": '{"v": 1.05}', "3": "b", "4": "c", "5": deep, "6": deep + " "}
    side = lambda *x: spark.createDataFrame([("k", p, d) for p, d in x], "key string, path string, digest string")
    blobs = spark.createDataFrame([(d, bytearray(t.encode())) for d, t in texts.items()], "digest string, content binary")
    policy = compare.JsonPolicy(compare.Tolerance(abs=0.1))
    got = compare.output_findings(side(("a.json", "1"), ("gone", "3"), ("t", "3"), ("same", "3"), ("deep.json", "5")), side(("a.json", "2"), ("new", "3"), ("t", "4"), ("same", "3"), ("deep.json", "6")), blobs, policy)
    assert rows(got, "path", "finding") == [("deep.json", "not comparable as JSON"), ("gone", "only recorded"), ("new", "only replayed"), ("t", "other bytes")]
    assert rows(compare.output_findings(side(("a.json", "1")), side(("a.json", "2")), blobs, compare.JsonPolicy()), "path") == [("a.json/v",)]


def test_catalogue_lists_each_once(spark):
    specs = spark.createDataFrame([("p", "1"), ("p", "2")], "name string, version string")
    assert compare.catalogue(specs).count() == 2
    with pytest.raises(ValueError, match="p 1"):
        compare.catalogue(specs.unionByName(specs))


def test_verifying_extractions(spark):
    text = "# Title\n\nBody é"
    docs = spark.createDataFrame([("r", bytearray(text.encode()))], "key string, content binary")
    digest = hashlib.sha256(text.encode()).hexdigest()
    units = markdown.normalise(docs).select(F.col("key").alias("record_id"), "unit_id", F.lit("document.md").alias("artifact"), F.lit(digest).alias("digest"), "start", "end", F.when(F.col("unit_id") == "u000002", "other").otherwise(F.col("text")).alias("text"))
    manifest = spark.createDataFrame([("r", "document.md", digest)], "record_id string, path string, digest string")
    blobs = docs.select(F.lit(digest).alias("digest"), "content")
    records = spark.createDataFrame([("r", "a", "s", "mineru", "1")], "record_id string, artifact_hash string, source_hash string, parser_name string, parser_version string")
    head = lambda *x: spark.createDataFrame([("r", *x)], "record_id string, of_record string, artifact_hash string, source_hash string, parser string, normaliser string")
    assert rows(markdown.verify_extractions(head("r", "a", "s", "mineru@1", "markdown"), records, units, manifest, blobs)) == [("r", "u000002", "text differs")]
    bad = markdown.verify_extractions(head("q", "b", "t", "mineru@2", "conversation"), records, units, manifest, blobs)
    assert sorted(r.problem for r in bad.collect()) == ["another normaliser", "another output", "another parser", "another record", "another source"]


def test_blocks_that_are_no_utf8_fail_their_document(spark):
    docs = spark.createDataFrame([("a", bytearray(b"ok\n\n\xff\xfe\n\nok")), ("b", bytearray(b"ok\r\n\r\nHead\r\n====\r\n"))], "key string, content binary")
    got = {(r.key, r.unit_id): r for r in markdown.normalise(docs).collect()}
    assert set(got) == {("a", None), ("b", "u000001"), ("b", "u000002")} and got["a", None].error == "not UTF-8"
    assert got["b", "u000002"].kind == "heading" and got["b", "u000002"].error is None


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(canon.config_digest(F.lit('{"b": 1, "a": 2}'))) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    assert [one(markdown.normaliser(F.lit(p))) for p in ("mineru", "export-split", "other")] == ["markdown", "conversation", None]
    assert [compare.input_name("file", n) for n in ("a b/é.txt", "...", ".hidden", "")] == ["a_b__.txt", "input", "hidden", "input"] and compare.input_name("tree", "..") == "tree"
    said = lambda f, code, err: one(failures.describe_failure(F.lit(f), F.lit(code), F.lit(err)))
    assert said("exit_status", 3, "one\ntwo\n \n") == "ended with status 3: two" and said("syscall_blocked", 0, None) == "syscall blocked" and said("timeout", 0, "") == "took too long"
    runs = spark.createDataFrame([(1, False, None, None, None), (2, True, "h", "r", "f"), (3, True, None, "r", "f"), (4, True, None, "r", None), (5, True, None, None, None)], "n int, applicable boolean, host_error string, refusal string, failure string")
    assert rows(campaign.observe(runs), "n", "status") == [(1, "not_applicable"), (2, "error"), (3, "failed"), (4, "containment_error"), (5, "sealed")]
