"""A record store in a folder of versions, with the commands of the engine as methods.

Every change writes a new version beside the old ones, in one job, and readers take the newest complete one; nothing is changed
in place. Methods that read return DataFrames. What recalls count is appended to an event log beside the version, which the next
version takes in, and times of maintenance to a log of settings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed, policy
from factloom.functions import text as T
from factloom.operators import consolidate, diagnostics, mining, records, render, search
from factloom.sources import sync

QUEUE = "item_id string, dedup_key string, namespace string, message string, confidence double, decay_days int, captured_ts timestamp"


class Store:
    def __init__(self, spark: SparkSession, path: str, now: Column | None = None) -> None:
        self.spark, self.path, self.now = spark, path.rstrip("/"), F.current_timestamp() if now is None else now

    def _list(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(p) else []

    def _exists(self, folder: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _newest(self) -> str | None:
        found = self._list(f"{self.path}/versions")
        return found[-1] if found else None

    def memory(self, version: int | None = None) -> DataFrame:
        name = self._newest() if version is None else f"v{version:09d}"
        if name not in self._list(f"{self.path}/versions"):
            return self.spark.createDataFrame([], sync.MEMORY)
        rows = sync.read_memory(self.spark, f"{self.path}/versions/{name}")
        if version is None and self._exists(f"{self.path}/telemetry/{name}"):
            rows = records.bump(rows, self.spark.read.schema("id string, kind string, ts timestamp").parquet(f"{self.path}/telemetry/{name}"))
        return rows

    def _write(self, df: DataFrame) -> None:
        name = self._newest()
        df.select(*sync.MEMORY.fieldNames()).write.parquet(f"{self.path}/versions/v{int(name[1:]) + 1 if name else 0:09d}")

    def meta(self) -> DataFrame:
        """key and value of the settings, the latest value of each key."""
        if not self._exists(f"{self.path}/meta"):
            return self.spark.createDataFrame([], "key string, value string")
        rows = self.spark.read.schema("key string, value string, at timestamp").parquet(f"{self.path}/meta")
        return rows.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))

    def _note(self, **values: str) -> None:
        now = self.spark.range(1).select(self.now.alias("at")).first()["at"]
        rows = [(k, now.strftime("%Y-%m-%dT%H:%M:%SZ") if v is None else v, now) for k, v in values.items()]
        self.spark.createDataFrame(rows, "key string, value string, at timestamp").coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def _noted(self, key: str) -> str | None:
        row = self.meta().filter(F.col("key") == key).first()
        return row["value"] if row else None

    def init(self) -> None:
        if not self._list(f"{self.path}/versions"):
            self._write(self.spark.createDataFrame([], sync.MEMORY))

    # Writing

    def add(self, namespace: str, type: str, content: str, tags: str = "", source_ref: str = "", confidence: float | None = None, signal: str = "none", capture_mode: str = "manual") -> DataFrame:  # noqa: A002
        row = self.spark.createDataFrame([(0, 0, 0, str(uuid.uuid4()), namespace, type, content, tags, source_ref, confidence, signal)], "row_id long, batch_no int, line_no int, id string, namespace string, type string, content string, tags string, source_ref string, confidence double, signal string").withColumn("ingestion_ts", self.now)
        return self._take(row, capture_mode=capture_mode)

    def _take(self, rows: DataFrame, allow_tombstones: bool = False, capture_mode: str = "manual", source_ref: str | None = None) -> DataFrame:
        memory = self.memory()
        rows = rows.persist()
        counts = self.spark.createDataFrame(sync.summary(sync.outcomes(rows, memory, self.now, allow_tombstones, capture_mode)).collect())
        self._write(sync.applied(rows, memory, self.now, allow_tombstones, capture_mode, source_ref))
        return counts

    def ingest_jsonl(self, path: str, source_ref: str | None = None, allow_tombstones: bool = False, capture_mode: str = "manual") -> DataFrame:
        rows = sync.parse_lines(sync.read_lines(self.spark, path)).withColumn("row_id", F.col("line_no").cast("long")).withColumn("batch_no", F.lit(0))
        return self._take(rows.withColumns({c: F.try_to_timestamp(c) for c in ("ingestion_ts", "valid_from", "superseded_at")}).withColumn("confidence", F.col("confidence").try_cast("double")), allow_tombstones, capture_mode, source_ref)

    def supersede(self, id: str, reason: str = "") -> None:  # noqa: A002
        self._write(records.supersede(self.memory(), self.spark.createDataFrame([(id, reason)], "id string, reason string"), self.now))

    def rekey_namespace(self, source: str | None = None, to: str = fixed.GLOBAL_NAMESPACE, confirm: bool = False) -> DataFrame:
        moves = records.rekey(self.memory(), to, source).select("id", "namespace", "new_namespace")
        if confirm:
            memory = self.memory()
            moved = moves.select("id", F.col("new_namespace").alias("to_ns"))
            self._write(memory.join(moved, "id", "left").withColumn("namespace", F.coalesce("to_ns", "namespace")).select(*memory.columns))
        return moves

    def consolidate(self, threshold: float | None = None, prune: bool = False, dry_run: bool = False, namespace: str | None = None, force: bool = False, merge_contested: bool = False, vectors: DataFrame | None = None) -> DataFrame:
        """The report of the run, with `skipped` for one that isn't due: less than a week after the last and grown by less than a fifth,
        in the whole store whatever the namespace. Only force passes the gate, in a dry run too."""
        memory = self.memory()
        live_rows = records.live(memory).count()
        last, before = self._noted("last_consolidation"), self._noted("live_at_consolidation")
        if last is not None and not force:
            gate = records.cadence(memory, F.try_to_timestamp(F.lit(last)), self.now, F.lit(int(before or 0))).first()
            if gate["due"] is False:
                return self.spark.createDataFrame([(True, 0)], "skipped boolean, merged int")
        if not dry_run:
            self._note(last_consolidation=None, live_at_consolidation=str(live_rows))
        scope = memory if namespace is None else memory.filter(F.col("namespace") == namespace)
        found = consolidate.clusters(scope, threshold, merge_contested=merge_contested, vectors=vectors).persist()
        out = consolidate.consolidated(memory, found, self.now)
        gone = records.prune_candidates(out if namespace is None else out.filter(F.col("namespace") == namespace), self.now).select("id", F.lit("pruned").alias("reason"))
        report = consolidate.report(scope, found, pruned=F.lit(gone.count() if prune else 0), vectors=vectors is not None).withColumn("skipped", F.lit(False))
        done = self.spark.createDataFrame(report.collect(), report.schema)
        if not dry_run:
            self._write(records.supersede(out, gone, self.now) if prune else out)
        return done

    def reembed(self, embed: Callable[[DataFrame], DataFrame], have: DataFrame | None = None) -> DataFrame:
        """The vectors of all live rows: those in `have` (id, embedding), and for rows without one what embed makes of (id, content).
        Written beside the versions; a row for which embed has no vector is tried again next time."""
        rows = records.live(self.memory()).select("id", "content")
        old = self.vectors() if have is None else have
        made = embed(rows.join(old.select("id"), "id", "left_anti")).filter("embedding is not null").select("id", "embedding")
        n = len(self._list(f"{self.path}/vectors"))
        old.join(rows.select("id"), "id", "left_semi").select("id", "embedding").unionByName(made).write.parquet(f"{self.path}/vectors/v{n:09d}")
        return self.vectors()

    def vectors(self) -> DataFrame:
        found = self._list(f"{self.path}/vectors")
        return self.spark.read.parquet(f"{self.path}/vectors/{found[-1]}") if found else self.spark.createDataFrame([], "id string, embedding array<float>")

    def rebuild_fts(self) -> None:
        """Writes the inverted index of the current version anew; recalls use it as long as the version stays."""
        name = self._newest()
        if name is not None:
            search.write_index(self.memory(), f"{self.path}/index/{name}")

    def _index(self) -> str | None:
        path = f"{self.path}/index/{self._newest()}"
        return path if self._exists(f"{path}/sums/_SUCCESS") else None

    def _shown(self, found: DataFrame, bump: bool, explicit: bool = True) -> DataFrame:
        """Counts rows that are shown, unless told not to."""
        name = self._newest()
        if not bump or name is None:
            return found
        found = found.persist()
        search.telemetry(found, self.now, explicit).coalesce(1).write.mode("append").parquet(f"{self.path}/telemetry/{name}")
        return found

    def bump(self, events: DataFrame) -> None:
        self._write(records.bump(self.memory(), events))

    # Reading

    def recall(
        self, query: str, namespace: str | None = None, limit: int = 5, include_global: bool = False, global_limit: int = 3, min_confidence: float = fixed.RECALL_FLOOR, hybrid: list[float] | None = None,
        no_bump: bool = False, aliases: dict[str, str] | None = None, current: DataFrame | None = None,
    ) -> DataFrame:
        """Rows by relevance, confidence, recency and use. hybrid is the query's vector, which the stored vectors are ranked by too."""
        vectors = self.vectors() if hybrid is not None else None
        found = search.recall_all(self.memory(), query, self.now, namespace, limit, min_confidence, current, include_global, global_limit, aliases, vectors, hybrid, self._index())
        return self._shown(found.drop("rrf"), not no_bump)

    def search(self, text: str, namespace: str | None = None, limit: int = 10, include_global: bool = False, global_limit: int = 3, no_bump: bool = False) -> DataFrame:
        """recall without a floor, by text alone."""
        return self.recall(text, namespace, limit, include_global, global_limit, 0.0, no_bump=no_bump)

    def recent(self, namespace: str, limit: int = 5, min_confidence: float = fixed.RECENT_FLOOR, include_global: bool = False, global_limit: int = 3, no_bump: bool = False, aliases: dict[str, str] | None = None) -> DataFrame:
        m = self.memory()
        found = search.recent_tiers(m, namespace, limit, global_limit, min_confidence, aliases) if include_global else search.recent(m, namespace, limit, min_confidence, aliases)
        return self._shown(found, not no_bump, explicit=False)

    def get(self, id: str) -> DataFrame:  # noqa: A002
        return records.get(self.memory(), id)

    def list(self, namespace: str | None = None, limit: int = 50, include_superseded: bool = False) -> DataFrame:
        return records.listing(self.memory(), namespace, limit, include_superseded)

    def stats(self) -> dict[str, DataFrame]:
        m = self.memory()
        return {"overview": records.stats(m), "namespaces": records.live_counts(m, "namespace"), "signals": records.live_counts(m, "signal")}

    def promote(self, namespace: str | None = None, id: str | None = None, description: str | None = None, install: str | None = None, confirm: bool = False) -> DataFrame:  # noqa: A002
        """Rows that qualify with the text of their skill. With install, a folder, and confirm each is written to a file there, named by its slug."""
        m = self.memory() if namespace is None else self.memory().filter(F.col("namespace") == namespace)
        if id is not None:
            m = m.filter(F.col("id") == id)
        about = F.col("trigger_line") if description is None else F.lit(description)
        body = F.concat(F.lit("---\nname: "), "slug", F.lit("\ndescription: "), about, F.lit("\n---\n\n"), "content", F.lit("\n"))
        out = records.promote_candidates(m).join(m.select("id", "content"), "id").select("id", "namespace", "slug", "trigger_line", body.alias("skill"))
        if install is not None and confirm:
            out.select("slug", F.col("skill").alias("value")).repartition("slug").write.mode("overwrite").partitionBy("slug").text(install)
        return out

    def failures(self, session: str, message: DataFrame | None = None, tool_usage: DataFrame | None = None) -> DataFrame:
        return mining.session_failures(session, message, tool_usage)

    def corrections(self, message: DataFrame) -> DataFrame:
        """The user's messages that correct something, with their class; secrets are redacted."""
        said = mining.user_messages(message).withColumn("c", mining.classify_correction(F.col("text"))).filter("c.kind is not null")
        return said.select("session_id", "message_id", "sent_ts", policy.redacted(F.col("text"))[0].alias("message"), "c.*", policy.has_secret(F.col("text")).alias("secret_warning"))

    def queue(self) -> DataFrame:
        found = self._list(f"{self.path}/queue")
        return self.spark.read.schema(QUEUE).parquet(f"{self.path}/queue/{found[-1]}") if found else self.spark.createDataFrame([], QUEUE)

    def _put_queue(self, rows: DataFrame) -> None:
        rows.select(*(x.split()[0] for x in QUEUE.split(", "))).write.parquet(f"{self.path}/queue/v{len(self._list(f'{self.path}/queue')):09d}")

    def queue_list(self, namespace: str | None = None) -> DataFrame:
        """Items of the queue, the newest first, with whether they are stale."""
        rows = self.queue() if namespace is None else self.queue().filter(F.col("namespace") == namespace)
        return rows.withColumn("stale", mining.is_stale(F.col("captured_ts"), F.col("decay_days"), self.now)).orderBy(F.col("captured_ts").desc_nulls_last(), "item_id")

    def queue_clear(self, namespace: str, id: str | None = None, all: bool = False, drop_stale: bool = False) -> int:  # noqa: A002
        """Clears items of a namespace by exactly one of id, all, or drop_stale; returns how many went."""
        if (id is not None) + all + drop_stale != 1:
            raise ValueError("exactly one of id, all and drop_stale")
        rows = self.queue().persist()
        mine = rows.filter(F.col("namespace") == namespace)
        left = mining.queue_clear(mine, self.now, None if id is None else [id], all)
        gone = mine.count() - left.count()
        self._put_queue(rows.filter(~F.col("namespace").eqNullSafe(namespace)).unionByName(left))
        return gone

    def mine_history(self, message: DataFrame, days: float | None = None, min_count: int = 2, limit: int | None = None, project: str | None = None, queue: bool = False) -> dict[str, DataFrame]:
        """Corrections, error patterns and rejections of transcripts, of the last days and of one project folder if given; with queue
        those that the queue lacks are added to it, each project folder as a namespace, the newest of each kept."""
        rows = message if project is None else message.filter(F.col("project_folder") == project)
        if days:
            rows = rows.filter(F.unix_micros("stored_ts") >= F.unix_micros(self.now) - int(days * 86_400_000_000))
        corrections, errors, rejections = mining.mined(rows, min_count, limit)
        if queue:
            old = self.queue().persist()
            items = mining.queue_new(mining.queue_items(corrections, errors), old)
            new = items.select(F.col("dedup_key").alias("item_id"), "dedup_key", F.col("project_folder").alias("namespace"), "message", "confidence", "decay_days", self.now.alias("captured_ts"))
            self._put_queue(mining.queue_capped(old.unionByName(new)).drop("place"))
        return {"corrections": corrections, "error_patterns": errors, "rejections": rejections}

    def sweep(self, folder: str, max_age_days: float = 7, dry_run: bool = False, prefixes: tuple[str, ...] = (".session-",)) -> int:
        """Deletes files of a folder that begin with a marker's prefix and are older than that; returns how many there were."""
        if not 0 <= max_age_days < float("inf"):
            raise ValueError("max_age_days must be finite and not negative")
        if not self._exists(folder):
            return 0
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        before = (self.spark.range(1).select(F.unix_micros(self.now)).first()[0] - max_age_days * 86_400_000_000) / 1000
        old = [s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().startswith(prefixes) and s.getModificationTime() < before]
        for x in [] if dry_run else old:
            fs.delete(x, False)
        return len(old)

    def session_cadence(self, markers: str | None = None, backup_retention: int = 7) -> dict[str, str]:
        """Consolidation if due, a backup if due and the sweep of old markers; a step that fails is reported and doesn't stop the others."""
        steps: dict[str, Callable[[], object]] = {"sweep": lambda: 0 if markers is None else self.sweep(markers), "consolidate": self.consolidate, "backup": lambda: self.backup(retention=backup_retention, if_due=True)}
        out = {}
        for name, step in steps.items():
            try:
                step()
                out[name] = "ok"
            except Exception as e:  # noqa: BLE001
                out[name] = f"error - {type(e).__name__}"
        return out

    def diagnostics(self, keys_present: list[str] | None = None) -> DataFrame:
        """check and status of the store's maintenance and of pending re-keys."""
        health = diagnostics.operational_health(self.meta(), self.now).select("check", "status")
        return health.unionAll(diagnostics.pending_migration(self.memory(), keys_present or []).select("check", "status"))

    def postings(self) -> DataFrame:
        return search.postings(self.memory())

    def export_pack(self, namespace: str, project_limit: int = fixed.PACK_PROJECT, global_limit: int = fixed.PACK_GLOBAL, min_confidence: float = fixed.PACK_CONFIDENCE, max_bytes: int = fixed.PACK_BYTES, out: str | None = None) -> DataFrame:
        """The project's section and the global one, under one budget; with out they are written there as one text."""
        one = render.render_pack(self.memory(), namespace, project_limit, max_bytes, "## Project\n\n", min_confidence).withColumn("section", F.lit("project"))
        used = one.first()["bytes"]
        two = render.render_pack(self.memory(), fixed.GLOBAL_NAMESPACE, global_limit, max(0, max_bytes - used), "\n## Global\n\n", min_confidence).withColumn("section", F.lit("global"))
        both = one.unionByName(two)
        if out is not None:
            text = F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("section") == "project", 1).otherwise(2).alias("n"), "pack"))), lambda x: x["pack"])
            both.agg(F.array_join(text, "").alias("value")).coalesce(1).write.mode("overwrite").text(out)
        return both

    def export_jsonl(self, out: str, namespace: str | None = None, include_superseded: bool = False) -> None:
        sync.write_export(self.memory(), out, namespace=namespace, include_superseded=include_superseded)

    def session_context(self, namespace: str, limit: int = 3, global_limit: int = 2, budget: int = 9000, queue: DataFrame | None = None) -> DataFrame:
        """The recent rows a session starts with, in order, with the counts of promotable rows and pending queue items."""
        m = self.memory()
        rows = search.recent_tiers(m, namespace, limit, global_limit).select("id", "tier").join(m.select("id", "content", "ingestion_ts"), "id").withColumn("one", F.lit(1))
        shown = render.context_rows(rows, [F.col("tier"), F.col("ingestion_ts").desc_nulls_last(), F.col("id")], "one", budget).select("tier", "id", "shown", T.age_text(F.col("ingestion_ts"), self.now).alias("age"))
        pending = 0 if queue is None else queue.filter(~mining.is_stale(F.col("captured_ts"), F.col("decay_days"), self.now)).count()
        return shown.withColumn("promotable", F.lit(records.promote_candidates(m).count())).withColumn("pending", F.lit(pending))

    # Snapshots

    def backup(self, name: str | None = None, retention: int = 7, if_due: bool = False) -> DataFrame:
        """Copies the current version and returns the snapshots beyond the newest `retention`, which may be deleted. With if_due nothing
        is copied, and no snapshot returned, while the last backup is younger than a day."""
        if if_due and not self.spark.range(1).select(self.backup_due(F.try_to_timestamp(F.lit(self._noted("last_backup"))), self.now)).first()[0]:
            return self.spark.createDataFrame([], "name string, mtime int")
        sync.snapshot(self.memory(), f"{self.path}/snapshots/{name or self.spark.range(1).select(F.date_format(self.now, 'yyyyMMdd-HHmmss')).first()[0]}")
        self._note(last_backup=None)
        names = self._list(f"{self.path}/snapshots")
        order = self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, mtime int")
        return records.retention(order, retention)

    @staticmethod
    def backup_due(last: Column, now: Column, days: int = 1) -> Column:
        """A missing time means due."""
        return F.coalesce(F.date_diff(F.to_date(now), F.to_date(last)) >= days, F.lit(True))

    def restore(self, name: str, force: bool = False) -> None:
        """Makes a snapshot the current version, after a safety copy; the versions before it stay.

        The snapshot is verified first (no row without an id; none but with force), and the version that was made of it after.
        """
        copy = sync.read_memory(self.spark, f"{self.path}/snapshots/{name}")
        if not force and copy.filter("id is null").count():
            raise ValueError("the snapshot has rows without an id")
        sync.snapshot(self.memory(), f"{self.path}/snapshots/prerestore-{uuid.uuid4().hex[:12]}")
        self._write(copy)
        if sync.fingerprint(copy).first() != sync.fingerprint(sync.read_memory(self.spark, f"{self.path}/versions/{self._newest()}")).first():
            raise RuntimeError("the restored version differs from its snapshot")

    def captured(self, rows: DataFrame, mode: str = "manual") -> DataFrame:
        return policy.capture(rows, mode)
