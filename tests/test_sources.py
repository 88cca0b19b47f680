"""Files, journals, blob tables and the streaming tail."""

import hashlib
import os

from provenir.operators import chain
from provenir.sources import files
from provenir.streaming import tail
from tests.test_evidence import CHAIN, _chain_rows


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "a" / "_b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / "empty").mkdir()
    contents = {"a/x.txt": b"one", "y.txt": b"two!", ".hidden": b"", "_under": b"u", "a/_b/.deep": b"d" * 3_000_000, ".git/config": b"c", "sp ace %41.txt": b"s"}
    for path, content in contents.items():
        (tmp_path / path).write_bytes(content)
    (tmp_path / "link").symlink_to(tmp_path / "y.txt")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    os.mkfifo(tmp_path / "pipe")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.path: (r.sha256, r.size, r.reason) for r in files.scan_corpus(spark, root).collect()}
        want = {p: (hashlib.sha256(c).hexdigest(), len(c), None) for p, c in contents.items()}
        assert got == want | {"link": (None, None, "symlink"), "a/loop": (None, None, "symlink"), "pipe": (None, None, "not a regular file")}
    assert {r.path for r in files.scan_corpus(spark, str(tmp_path), "*.txt").collect()} == {"a/x.txt", "y.txt", "sp ace %41.txt"}


def test_export_is_verified_and_never_overwrites(spark, tmp_path):
    import pytest

    digest = hashlib.sha256(b"x").hexdigest()
    blobs = spark.createDataFrame([(digest, bytearray(b"x")), ("0" * 64, bytearray(b"y"))], "digest string, content binary")
    assert files.export_blob(blobs, digest, str(tmp_path / "out")) == 1 and (tmp_path / "out").read_bytes() == b"x"
    for key, path, error in ((digest, "out", FileExistsError), ("0" * 64, "new", ValueError), ("1" * 64, "new", KeyError)):
        with pytest.raises(error):
            files.export_blob(blobs, key, str(tmp_path / path))
    assert not (tmp_path / "new").exists()


def test_snapshots_are_materialised(spark, tmp_path):
    import pytest

    texts = {"a/b.txt": b"one", "c": b"", "a/d/e": b"three"}
    digest = {p: hashlib.sha256(c).hexdigest() for p, c in texts.items()}
    manifest = spark.createDataFrame(list(digest.items()), "path string, digest string")
    blobs = spark.createDataFrame([(digest[p], bytearray(c)) for p, c in texts.items()], "digest string, content binary")
    assert files.materialise(manifest, blobs, str(tmp_path / "out")) == 3
    assert {r.path: r.sha256 for r in files.scan_corpus(spark, str(tmp_path / "out")).collect()} == digest
    with pytest.raises(FileExistsError):
        files.materialise(manifest, blobs, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="missing"):
        files.materialise(manifest, blobs.limit(1), str(tmp_path / "new"))
    with pytest.raises(ValueError, match="safe"):
        files.materialise(manifest.unionByName(spark.createDataFrame([("../x", digest["c"])], manifest.schema)), blobs, str(tmp_path / "new"))
    with pytest.raises(Exception, match="altered"):
        files.materialise(manifest, blobs.selectExpr("digest", "cast('other' as binary) as content"), str(tmp_path / "new"))


def test_replays_are_logged_once(spark, tmp_path):
    from provenir.operators import commits, compare

    table = str(tmp_path / "replays")
    rows = lambda *ids: spark.createDataFrame([(i, "rec", "t", "equivalent") for i in ids], "replay_id string, record_id string, replayed_at string, outcome string")
    for batch in (("b", "a", "a"), ("a", "c")):
        commits.append_replays(spark, table, rows(*batch))
    assert [r.replay_id for r in compare.replays_of(spark.read.parquet(table), record_id="rec").collect()] == ["a", "b", "c"]


def test_waivers_are_read(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"path":"p","lane":"l","outcome":"diverged","reason":"known"},\n{"path":"q","lane":"l","outcome":"regression"}]')
    assert sorted((r.path, r.reason) for r in files.read_waivers(spark, str(tmp_path / "w.json")).collect()) == [("p", "known"), ("q", None)]


def test_journal_without_its_torn_line(spark, tmp_path):
    path = tmp_path / "journal"
    path.write_text('{"campaign":1}\n{"path":"p","lane":"b","status":"sealed","telemetry":{"wall_time_seconds":1.5}}\n{"path":"q"')
    head, rows = files.read_journal(spark, str(path))
    assert [r.value for r in head.collect()] == ['{"campaign":1}']
    assert [(r.line, r.path, r.telemetry.wall_time_seconds) for r in rows.collect()] == [(1, "p", 1.5)]


def test_journal_lines_are_numbered_across_splits(spark, tmp_path):
    path, old = tmp_path / "journal", spark.conf.get("spark.sql.files.maxPartitionBytes")
    path.write_text('{"campaign":1}\n' + "".join(f'{{"path":"p{i}","detail":"{"x" * (i % 90)}"}}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        head, rows = files.read_journal(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5 and head.count() == 1
        assert sorted((r.line, r.path) for r in rows.collect()) == [(i + 1, f"p{i}") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    path.write_text("")
    assert files.read_journal(spark, str(path))[1].count() == 0


def test_blobs_are_stored_once(spark, tmp_path):
    table = str(tmp_path / "blobs")
    for texts in (["a", "a", "b"], ["b", "c"]):
        files.append_blobs(spark.createDataFrame([(hashlib.sha256(x.encode()).hexdigest(), bytearray(x.encode())) for x in texts], "digest string, content binary"), table)
    assert sorted(bytes(r.content) for r in spark.read.parquet(table).collect()) == [b"a", b"b", b"c"]


def test_tail_follows_a_chain(spark, tmp_path):
    rows = _chain_rows(9)
    del rows[3]
    rows[6] = (*rows[6][:4], '{"other":1}', *rows[6][5:])
    log, found = str(tmp_path / "log"), []

    def step(batch):
        spark.createDataFrame(batch, CHAIN).coalesce(1).write.mode("append").parquet(log)
        q = tail.follow(tail.read_chain(spark, log)).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: found.extend(tuple(r)[1:] for r in df.collect())).start().awaitTermination()

    step(rows[:5])
    assert found == [(5, "gap")]
    step(rows[5:])
    step(rows[2:3])
    assert sorted(found[1:]) == [(3, "late"), (8, "altered")]
    assert chain.tail(spark.createDataFrame(rows, CHAIN), 4).count() == 5


def test_appends_follow_the_head_and_refuse_violations(spark, tmp_path):
    import pytest

    from provenir.operators import campaign, commits

    log = str(tmp_path / "chain")
    batch = lambda *ids: commits.transition_events(spark.createDataFrame([(i, "t") for i in ids], "record_id string, `at` string"), "record.sealed")
    with pytest.raises(FileNotFoundError):
        commits.append(spark, log, batch("a"))
    first = commits.append(spark, log, batch("a", "b"), create=True)
    second = commits.append(spark, log, batch("c"), spark.range(0))
    assert (first[0], second[0]) == (2, 3)
    with pytest.raises(commits.Refused):
        commits.append(spark, log, batch("d"), spark.range(1))
    rows = spark.read.parquet(log)
    assert rows.count() == 3 and chain.verify_chain(rows.selectExpr("'c' as chain", "*")).count() == 0

    signed = spark.createDataFrame([(1, "report", '{"report":"d","by":"me"}', "t")], "ord long, subject string, body string, `at` string")
    records = spark.createDataFrame([("a", "sealed", "h")], "record_id string, state string, artifact_hash string")
    stale = campaign.stale_signoffs(spark.createDataFrame([("s", "a", "h")], "signoff_id string, record_id string, artifact_hash string"), records)
    assert commits.sign_off(spark, log, second, signed, stale)[0] == 4
    assert [(r.seq, r.report, r.by) for r in commits.signoffs(spark.read.parquet(log)).collect()] == [(4, "d", "me")]
    for head, bad in (((3, "x"), stale), ((9, "x"), stale), (second, stale.sparkSession.range(1).selectExpr("'gone' as problem"))):
        with pytest.raises(commits.Refused):
            commits.sign_off(spark, log, head, signed, bad)


def test_a_record_is_stated_and_targets_are_fed_in_batches(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from provenir.operators import commits

    record = spark.createDataFrame([("run", "a" * 64, "b" * 64, "file", "mineru", "1", "oci", '{"cpus": 2.0}', "sealed", '{"z":1, "a":2}')], "run_id string, artifact_hash string, source_hash string, source_kind string, parser_name string, parser_version string, backend string, run_conditions string, state string, parser_config string")
    body = json.loads(commits.record_body(record, with_state=True).first().body)
    assert body["parser"] == {"name": "mineru", "version": "1"} and body["state"] == "sealed" and body["parser_config"] == {"a": 2, "z": 1}

    out = str(tmp_path)

    def write(rows):
        with open(f"{out}/{rows[0].dispatch_id}", "w") as f:
            f.write(str(len(rows)))

    commits.foreach_target(spark.range(25).select(F.col("id").alias("dispatch_id")).coalesce(1), write, size=10)
    assert sorted(int((tmp_path / f).read_text()) for f in ("0", "10", "20")) == [5, 10, 10]


def test_strict_records(spark):
    from pyspark.sql import functions as F

    from provenir.functions import canon

    d = "a" * 64
    good = f'{{"digest":"{d}","file_count":1,"kind":"file","schema":"provenir.snapshot","schema_version":1,"size":3}}'
    cases = {good: None, good.replace(":3", ": 3"): "form", good.replace("kind", "sort"): "fields", good.replace("_version\":1", "_version\":2"): "version", good.replace(".snapshot", ".x"): "schema", "[]": "not an object", "{": "not an object", good[:-1] + ',"x":1}': "fields"}
    got = spark.createDataFrame(list(cases.items()), "t string, w string").select("w", canon.strict_problem(F.col("t"), "provenir.snapshot", ("kind", "digest", "size", "file_count")).alias("p")).collect()
    assert all(r.w == r.p for r in got)


def test_report_and_rebuild(spark):
    import json

    import pytest

    from provenir.operators import campaign

    gates = spark.createDataFrame([("coverage", True, 0.0), ("no_errors", False, 2.0)], "gate string, passed boolean, value double")
    statuses = spark.createDataFrame([("b", "sealed", 2)], "lane string, status string, n long")
    outcomes = spark.createDataFrame([("p", "c", "identical"), ("q", "c", "diverged")], "path string, lane string, outcome string")
    one = campaign.report(gates, statuses, outcomes, corpus="d" * 64, documents=2, lanes=["b", "c"], ledger_head=[3, "h"], generated_at="t")
    assert campaign.rebuild_problems(one, campaign.report(gates, statuses, outcomes, corpus="d" * 64, documents=2, lanes=["b", "c"])) == []
    assert campaign.rebuild_problems(one, campaign.report(gates, statuses, outcomes.limit(1), corpus="d" * 64, documents=3, lanes=["b", "c"])) == ["documents", "outcomes"]
    assert campaign.parse_report(one)["documents"] == 2 and campaign.failed_gates(one) == ["no_errors"]
    body = json.loads(one)
    form = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    for bad in (one + " ", form(body | {"passed": True}), form(body | {"schema_version": 2}), form(body | {"more": 1}), form({k: v for k, v in body.items() if k != "lanes"}), "[]"):
        with pytest.raises(ValueError):
            campaign.parse_report(bad)
    with pytest.raises(ValueError):
        campaign.report(gates, statuses, outcomes, author="x")


def test_split_index(spark):
    from provenir.operators import conversations

    lines = spark.createDataFrame([("r", '{"path":"a","index":"0","offset":1,"length":2}'), ("r", '{"path":"b","index":1,"offset":1,"length":2}'), ("r", '{"path":"a","index":1}'), ("r", "nonsense")], "record_id string, line string")
    entries, problems = conversations.split_index(lines, spark.createDataFrame([("r", "a")], "record_id string, path string"))
    assert [tuple(r)[1:] for r in entries.collect()] == [("a", 0, 1, 2)]
    assert sorted(r.problem for r in problems.collect()) == ["malformed", "malformed", "not in the bundle"]
