from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import consolidate
from factloom.store import Store


def values(df):
    return sorted((tuple(r) if len(r) > 1 else r[0] for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), F.timestamp_micros(F.lit(1767225600000000)))


def test_commands(spark, store, tmp_path):
    store.init()
    assert store.recall("cache").count() == 0
    assert store.add("n", "lesson", "Clear the cache first", "b,a", signal="test").first()["added"] == 1
    again = store.add("n", "fact", "clear  the CACHE first", "c", signal="user", confidence=0.95).first()
    assert (again["added"], again["deduped"]) == (0, 1)
    store.add("user:global", "fact", "Queues are cached", signal="user")
    assert store.add("User.Global", "fact", "x").first()["malformed"] == 1
    row = store.list().filter("namespace = 'n'").first()
    kept = store.get(row["id"]).first()
    assert (kept["confidence"], kept["signal"], kept["tags"], kept["retrieval_count"]) == (0.95, "test", "a,b,c", 1)
    assert values(store.recall("cache", "n", include_global=True).select("namespace", "tier")) == [("n", 1), ("user:global", 2)]
    assert values(store.stats()["overview"]) == [(2, 2, 0)]
    assert store.export_pack("n").filter("kept = 1").count() == 2
    assert store.session_context("n").count() == 2

    out = str(tmp_path / "out")
    store.export_jsonl(out, include_superseded=True)
    other = Store(spark, str(tmp_path / "other"), store.now)
    assert other.ingest_jsonl(out).first()["added"] == 2
    assert other.ingest_jsonl(out).first()["skipped"] == 2
    assert values(other.memory().select("id", "content", "tags", "confidence")) == values(store.memory().select("id", "content", "tags", "confidence"))

    store.supersede(row["id"], "old")
    assert values(store.stats()["overview"]) == [(2, 1, 1)]
    store.export_jsonl(str(tmp_path / "two"), include_superseded=True)
    assert other.ingest_jsonl(str(tmp_path / "two")).first()["tombstones_refused"] == 1
    assert other.ingest_jsonl(str(tmp_path / "two"), allow_tombstones=True).first()["tombstoned"] == 1
    assert values(other.memory().select("id", "supersede_reason")) == values(store.memory().select("id", "supersede_reason"))

    assert store.backup("s1").count() == 0
    store.add("n", "fact", "Something new")
    store.restore("s1")
    assert store.memory().count() == 2 and store.memory(1).count() == 1
    assert store.rekey_namespace("n", confirm=True).count() == 0


def test_consolidate(spark, store):
    w = "alpha beta gamma delta epsilon zeta"
    for i, (text, tags, signal) in enumerate([(f"{w} eta", "x", "test"), (f"{w} theta", "y", "compile"), (f"never {w}", "", "none"), ("quite another thing", "", "user")]):
        store.add("n" if i != 2 else "m", "lesson", text, tags, signal=signal)
    r = store.consolidate(dry_run=True).first()
    assert (r["merged"], r["clusters"], r["contested"], r["truncated"], r["absorbed"], r["contested_clusters"]) == (1, 1, 0, 0, 1, []) and store.stats()["overview"].first()["live"] == 4
    store.consolidate()
    keeper = store.memory().filter("merged_from is not null").first()
    assert (keeper["tags"], keeper["signal"], keeper["retrieval_count"]) == ("x,y", "test", 1) and "--- merged from" in keeper["content"]
    dead = store.memory().filter("superseded_at is not null").first()
    assert dead["supersede_reason"] == f"merged into {keeper['id']}" and keeper["merged_from"] == dead["id"]
    assert store.consolidate().first()["skipped"] and store.consolidate(dry_run=True).first()["skipped"]
    assert store.consolidate(force=True).first()["merged"] == 0
    assert consolidate.threshold_for(None, True) == 0.8 and consolidate.threshold_for(0.9, False) == 0.9


def test_recall_counts_and_limits(spark, store):
    for i in range(3):
        store.add("n", "fact", f"cache number {i}", signal="test")
    store.add("user:global", "fact", "a cached thing", signal="user")
    assert store.recall("cache", "n", include_global=True, min_confidence=0.7).count() == 3
    assert store.memory().filter("namespace = 'n'").agg({"retrieval_count": "sum"}).first()[0] == 3
    assert store.recall("cache", "n", no_bump=True).count() == 3
    assert store.recent("n", include_global=True, min_confidence=0.7).count() == 3
    m = store.memory().filter("namespace = 'n'").agg({"retrieval_count": "sum", "surfaced_count": "sum"}).first().asDict()
    assert m == {"sum(retrieval_count)": 3, "sum(surfaced_count)": 3}
    before = values(store.search("cache", no_bump=True).select("id", "score"))
    store.rebuild_fts()
    assert values(store.search("cache", no_bump=True).select("id", "score")) == before != []
    store.supersede(store.list().first()["id"])  # the next version takes the counts in
    assert store.memory().agg({"retrieval_count": "sum"}).first()[0] == 3
    for call in (lambda: store.recall("x", "n", -1), lambda: store.recent("n", -1), lambda: store.recall("x", "n", 1, True, -1), lambda: store.export_pack("n", -1)):
        with pytest.raises(ValueError):
            call()
    vectors = store.reembed(lambda rows: rows.select("id", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding")))
    assert vectors.count() == store.stats()["overview"].first()["live"] == store.reembed(lambda rows: rows.withColumn("embedding", F.lit(None).cast("array<float>"))).count()
    assert store.recall("absent", "n", hybrid=[1.0, 0.0], no_bump=True).count() > 0


def test_aliases(spark, store):
    store.add("old", "fact", "the cache", signal="test")
    assert store.recall("cache", "new").count() == 0
    assert store.recall("cache", "new", aliases={"old": "new"}).count() == store.recent("new", aliases={"old": "new"}).count() == 1


def test_cosine_clusters(spark, store):
    for i in range(4):
        store.add("n", "fact", f"text {i}", signal="test")
    ids = sorted(r["id"] for r in store.list().collect())
    v = spark.createDataFrame([(ids[0], [1.0, 0.0]), (ids[1], [0.99, 0.14]), (ids[2], [0.0, 1.0])], "id string, embedding array<float>")
    found = consolidate.clusters(store.memory(), vectors=v)
    assert [{r["keeper"], r["member"]} for r in found.collect()] == [{ids[0], ids[1]}]
    assert store.consolidate(vectors=v).first()["mode"] == "cosine"


def test_queue_and_mining(spark, store, tmp_path):
    cols = "session_id string, project_folder string, message_id long, seq int, type string, role string, content string, tool_use_id string, is_error boolean, is_meta boolean, sent_ts timestamp, stored_ts timestamp"
    at = datetime(2025, 12, 31)
    said = ["no, that is wrong", "remember: token = abcdefgh1234", "hello there friend"]
    m = spark.createDataFrame([("s", "p", i, i, "user", "user", t, None, None, None, at, at) for i, t in enumerate(said)] + [("s", "p", 9, 9, "user", "user", '[{"type":"tool_result","content":"Error: x","is_error":true}]', "t1", None, None, at, at)], cols)
    assert {r["secret_warning"] for r in store.corrections(m).collect()} == {True, False} and "abcdefgh" not in str(store.corrections(m).collect())
    out = store.mine_history(m, queue=True)
    assert out["corrections"].count() == 2 and store.queue_list("p").count() == 2
    store.mine_history(m, queue=True)
    assert store.queue_list().count() == 2 and store.mine_history(m, days=0.5)["corrections"].count() == 0 and store.mine_history(m, limit=1)["corrections"].count() == 1
    with pytest.raises(ValueError):
        store.queue_clear("p")
    assert store.queue_clear("p", id=store.queue_list().first()["item_id"]) == 1 and store.queue_clear("p", all=True) == 1
    assert [r["error"] for r in store.failures("s", m).collect()] == ["Error: x"]
    log = spark.createDataFrame([("s", "Bash", "error", 1, 0)], "session_id string, tool_name string, status string, exit_code int, read_only int")
    assert [(r["tool"], r["error"]) for r in store.failures("s", tool_usage=log).collect()] == [("Bash", "")]
    with pytest.raises(ValueError):
        store.failures("s")


def test_cadence_and_sweep(spark, store, tmp_path):
    import os

    store.init()
    store.add("n", "fact", "one", signal="test")
    marks = tmp_path / "marks"
    marks.mkdir()
    for name, age in ((".session-old", 9), (".session-new", 0), ("other", 9)):
        (marks / name).write_text("")
        when = 1767225600 - age * 86400
        os.utime(marks / name, (when, when))
    assert store.sweep(str(marks), dry_run=True) == 1
    assert store.session_cadence(str(marks)) == {"sweep": "ok", "consolidate": "ok", "backup": "ok"}
    assert sorted(p.name for p in marks.iterdir()) == [".session-new", "other"] and store.sweep(str(tmp_path / "none")) == 0
    n = len(store._list(f"{store.path}/snapshots"))
    assert n == 1 and store.session_cadence()["backup"] == "ok" and len(store._list(f"{store.path}/snapshots")) == 1
    assert {r["status"] for r in store.diagnostics(["n"]).collect()} == {"pass", "warn"}
    with pytest.raises(ValueError):
        store.sweep(str(marks), float("nan"))


def test_import_and_install(spark, store, tmp_path):
    from factloom.sources import sync

    store.add("n", "lesson", "Clear the cache. Always.", "b,a", signal="test", confidence=0.9)
    row = store.list().first()["id"]
    for _ in range(4):
        store.recall("cache", "n")
    source, target = f"{store.path}/versions/{store._newest()}", str(tmp_path / "copy")
    proof = sync.import_legacy(spark, source, target, 4, keys={"n": "git.example.org/a/n"}).first()
    assert proof["before"] == proof["after"] and (proof["total"], proof["live"]) == (1, 1) and spark.read.parquet(target).first()["namespace"] == "git.example.org/a/n"
    with pytest.raises(FileExistsError):
        sync.import_legacy(spark, source, target)
    out = str(tmp_path / "skills")
    assert store.promote(id=row, description="About caches", install=out).count() == 1
    assert not (tmp_path / "skills").exists()
    store.promote(id=row, description="About caches", install=out, confirm=True)
    assert "About caches" in spark.read.text(out, wholetext=True).filter("slug = 'a-b'").first()["value"]
    pack = str(tmp_path / "pack")
    store.export_pack("n", out=pack)
    assert "Clear the cache" in spark.read.text(pack, wholetext=True).first()["value"]


def test_facade(spark, store):
    from factloom.api import Facade, clamped

    assert [clamped(x) for x in (None, "x", -3, 7, 10**9)] == [5, 5, 1, 7, 50]
    api = Facade(store)
    assert api.add("n", "the cache is warm", signal="test")["added"] == 1
    assert len(api.recall("cache", "n")) == len(api.search("cache" * 1000 + " cache", "n", 3)) + 1 == len(api.recent("n")) == len(api.prefetch("cache please", "n")) == 1
    assert api.prefetch("hi", "n") == []
    assert api.supersede(api.recent("n")[0]["id"]) and not api.supersede("none")


def test_text_helpers(spark):
    one = lambda x, fn: spark.createDataFrame([(x,)], "x string").select(fn(F.col("x"))).first()[0]
    assert one("no /usr/lib/x.so at https://a.b/c?d", T.scrubbed) == "no <path> at <uri>"
    assert one("https://me:pw@a.b/c?token=1#f", T.public_url) == "https://a.b/c"
    assert one("a, prompt-injection-risk", T.is_risky) and not one(None, T.is_risky)
    due = spark.range(1).select(Store.backup_due(F.lit(None).cast("timestamp"), F.lit(datetime(2026, 1, 1))), Store.backup_due(F.lit(datetime(2026, 1, 1)), F.lit(datetime(2026, 1, 1)))).first()
    assert tuple(due) == (True, False)


def test_diagnostics(spark, tmp_path):
    from factloom.operators import diagnostics as D

    now = F.timestamp_micros(F.lit(1767225600000000))
    meta = spark.createDataFrame([("last_backup", "2025-12-31T00:00:00Z"), ("last_consolidation", "nonsense")], "key string, value string")
    assert values(D.operational_health(meta, now).select("status", "days_ago")) == [("pass", 1.0), ("warn", None)]
    assert values(D.operational_health(meta.limit(0), now).select("status")) == ["warn", "warn"]
    (tmp_path / "core.md").write_text("line\n" * 201)
    assert values(D.tier0_size(spark, [str(tmp_path / "core.md"), str(tmp_path / "none")]).select("n_lines", "status")) == [(201, "warn")]
    assert values(D.tier0_size(spark, [str(tmp_path / "none")]).select("status")) == ["skip"]
    cases = [([("a", '{"cleanupPeriodDays": 60}'), ("b", '{"cleanupPeriodDays": "x"}')], (60, True)), ([("a", '{"cleanupPeriodDays": -1}'), ("b", "not json")], (30, False)), ([("a", '{"cleanupPeriodDays": 60}'), ("b", '{"cleanupPeriodDays": 90}')], (90, True)), ([("a", '{"cleanupPeriodDays": true}')], (30, False))]
    for rows, want in cases:
        assert values(D.retention_setting(spark.createDataFrame(rows, "place string, value string")).select("days", "configured")) == [want]
    assert values(D.status_counts(spark.createDataFrame([("pass",), ("warn",), ("pass",)], "status string"))) == [(2, 1, 0, 0)]
