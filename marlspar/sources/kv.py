"""A versioned key-value log: rows (key, value, ts, deleted), one Parquet folder a commit.

A snapshot at a timestamp is one aggregate over the log: the latest row of each key not after it.  Commits append and
never rewrite; compaction writes the latest rows, without deleted keys, as the only folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

#: States before the newest that stay for readers.
KEPT = 50
SCHEMA = "key string, value string, ts long, deleted boolean"


def snapshot(log: DataFrame, ts: int | None = None) -> DataFrame:
    """(key, value) as of a timestamp."""
    seen = log if ts is None else log.where(F.col("ts") <= ts)
    last = seen.groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max_by("deleted", "ts").alias("deleted"))
    return last.where("NOT deleted").select("key", "value")


class KvStore:
    def __init__(self, spark: SparkSession, root: str, isolation: str = "REPEATABLE READ"):
        self.spark, self.root, self.files, self.isolation = spark, root.rstrip("/"), Files(spark), isolation
        self.number, self.state = 0, {"ts": 0, "folders": []}
        self.refresh()

    def refresh(self) -> None:
        """The newest state that any writer has committed."""
        newest = self.files.newest(f"{self.root}/kv-state")
        if newest > self.number:
            self.number, self.state = newest, json.loads(self.files.read(f"{self.root}/kv-state/{newest}.json"))

    def _advance(self, change) -> dict:
        """Commits ``change(state)``, a new state or None, on top of the newest one; of two writers the second begins anew."""
        while True:
            self.refresh()
            state = change(self.state)
            if self.files.create(f"{self.root}/kv-state/{self.number + 1}.json", json.dumps(state)):
                self.number, self.state = self.number + 1, state
                if self.number > KEPT:
                    self.files.delete(f"{self.root}/kv-state/{self.number - KEPT}.json")
                return state

    def log(self) -> DataFrame:
        """All rows; those of a commit carry its timestamp, those of a compaction their own."""
        folders = self.state["folders"]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        at = self.spark.createDataFrame([(f.rsplit("/", 1)[1], ts) for f, ts in folders], "folder string, at long")
        rows = self.spark.read.schema(SCHEMA).parquet(*[f for f, _ in folders]).withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2))
        return rows.join(F.broadcast(at), "folder").select("key", "value", F.coalesce("ts", "at").alias("ts"), "deleted")

    def begin(self) -> Transaction:
        self.refresh()
        return Transaction(self)

    def commit(self, writes: dict[str, str | None]) -> int:
        if not writes:
            return self.state["ts"]
        rows = [(k, v, v is None) for k, v in writes.items()]
        return self.append(self.spark.createDataFrame(rows, "key string, value string, deleted boolean").coalesce(1))

    def append(self, pairs: DataFrame) -> int:
        """Commits rows (key, value, deleted) at one timestamp, which is told by the state, not by the files."""
        folder = f"{self.root}/kv/{uuid.uuid4().hex}"
        pairs.select("key", "value", F.lit(None).cast("long").alias("ts"), "deleted").write.parquet(folder)
        return self._advance(lambda s: {"ts": s["ts"] + 1, "folders": [*s["folders"], [folder, s["ts"] + 1]]})["ts"]

    def put(self, key: str, value: str) -> None:
        self.commit({key: value})

    def delete(self, key: str) -> None:
        self.commit({key: None})

    def get(self, key: str, ts: int | None = None) -> str | None:
        row = snapshot(self.log().where(F.col("key") == key), ts).first()
        return row["value"] if row else None

    def scan(self, start: str | None = None, end: str | None = None, ts: int | None = None) -> DataFrame:
        """Keys from ``start`` to ``end``, both included, in order."""
        log = self.log()
        if start is not None:
            log = log.where(F.col("key") >= start)
        if end is not None:
            log = log.where(F.col("key") <= end)
        return snapshot(log, ts).orderBy("key")

    def count(self) -> int:
        return snapshot(self.log()).count()

    def stats(self) -> dict:
        return {"keys": self.count(), "folders": len(self.state["folders"]), "ts": self.state["ts"]}

    def compact(self) -> int:
        """Folders that went.  Commits that come in meanwhile stay as they are."""
        old, folder = list(self.state["folders"]), f"{self.root}/kv/{uuid.uuid4().hex}"
        last = self.log().groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"), F.max_by("deleted", "ts").alias("deleted"))
        last.where("NOT deleted").select("key", "value", "ts", "deleted").write.parquet(folder)
        self._advance(lambda s: {"ts": s["ts"], "folders": [[folder, 0], *(f for f in s["folders"] if f not in old)]})
        for f, _ in old:
            self.files.delete(f)
        return len(old)

    def dump(self, path: str) -> int:
        """All pairs as one JSON object, streamed to any file system that Spark reaches."""
        n = 0

        def text():
            nonlocal n
            yield "{"
            for r in self.scan().toLocalIterator():
                yield ("," if n else "") + f"\n  {json.dumps(r['key'])}: {json.dumps(r['value'])}"
                n += 1
            yield "\n}\n"

        self.files.stream(path, text())
        return n

    def load(self, path: str) -> int:
        """Commits the pairs of a JSON object (or of several files with one each), which executors read; values that aren't texts are kept as JSON."""
        whole = self.spark.read.text(path, wholetext=True)
        pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value")).select("key", "value", F.lit(False).alias("deleted"))
        n = pairs.count()
        if n:
            self.append(pairs)
        return n


class Transaction:
    """Buffered writes over a pinned snapshot (READ COMMITTED: over the latest)."""

    def __init__(self, store: KvStore):
        self.store, self.ts, self.writes, self.open = store, store.state["ts"], {}, True

    def _read_ts(self) -> int:
        if self.store.isolation != "READ COMMITTED":
            return self.ts
        self.store.refresh()
        return self.store.state["ts"]

    def put(self, key: str, value: str) -> None:
        self.writes[key] = value

    def delete(self, key: str) -> None:
        self.writes[key] = None

    def get(self, key: str) -> str | None:
        return self.writes[key] if key in self.writes else self.store.get(key, self._read_ts())

    def scan(self, start: str | None = None, end: str | None = None) -> list[tuple[str, str]]:
        have = {r["key"]: r["value"] for r in self.store.scan(start, end, self._read_ts()).toLocalIterator()}
        have |= {k: v for k, v in self.writes.items() if (start is None or k >= start) and (end is None or k <= end)}
        return sorted((k, v) for k, v in have.items() if v is not None)

    def commit(self) -> int:
        if not self.open:
            raise ValueError("transaction is closed")
        self.open = False
        return self.store.commit(self.writes)

    def rollback(self) -> None:
        self.open, self.writes = False, {}
