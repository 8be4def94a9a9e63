"""The engine over HTTP, a line protocol, and a prompt.

    python -m marlspar.server --data-dir DIR [--port N]     HTTP
    python -m marlspar.server --repl                         a prompt

``POST /api/sql`` runs a script up to its first failing statement; ``/api/sql/prepare``, ``execute`` and
``deallocate`` keep statements between requests; ``/api/tables`` lists tables, ``/api/tables/T/schema`` and
``/api/tables/T/rows?limit=N`` show one; ``/health`` and ``/stats`` tell how the server is; ``/api/admin/compact``
vacuums.  At most ``max_connections`` requests run at a time, each with temporary tables and cursors of its own."""

from __future__ import annotations

import argparse
import json
import re
import shlex
import socketserver
import sys
import threading
from contextlib import nullcontext
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .plans import ast as A
from .plans.parser import SqlError, parse_script
from .session import Engine, EngineConfig, Result, session
from .sources.kv import KvStore

ROWS = 100


class Pool:
    """Engines over one warehouse, a bounded number at a time."""

    def __init__(self, spark: SparkSession, config: EngineConfig):
        self.spark, self.config = spark, config
        self.free = threading.BoundedSemaphore(config.max_connections)
        self.prepared: dict = {}
        self.lock = threading.Lock()  # statements that write take turns

    def __enter__(self) -> Engine:
        self.free.acquire()
        e = Engine(self.spark, self.config.warehouse_dir, merge_beyond=self.config.compaction_threshold)
        e.prepared = self.prepared
        return e

    def __exit__(self, *_) -> None:
        self.free.release()


def as_json(r: Result) -> dict:
    out: dict = {"success": r.ok, "type": r.kind}
    if r.kind == "error":
        out["error"] = r.message
    elif r.kind == "select":
        out |= {"columns": r.columns, "rows": [list(x) for x in r.rows]}
    elif r.kind == "explain":
        out |= {"plan": r.message, "plan_tree": r.tree}
    else:
        out |= {"message": r.message, "count": r.count}
    return out


def run_script(pool: Pool, sql: str) -> dict:
    try:
        changes = not all(isinstance(s, (A.Select, A.Union, A.Explain)) for s in parse_script(sql))
    except SqlError:
        changes = False  # reported below
    with pool as e, pool.lock if changes else nullcontext():  # readers don't wait for anyone
        results = [as_json(r) for r in e.script(sql)]
    last = results[-1] if results else {"success": True, "type": "empty"}
    done = sum(r["success"] for r in results)
    return {**last, "executed_count": done, "statement_results": results}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    raise SqlError("parameters must be scalars")


def handler(pool: Pool):
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def reply(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type"), ("Content-Length", "0")):
                self.send_header(k, v)
            self.end_headers()

        def body(self) -> str:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            table = re.fullmatch(r"/api/tables/(\w+)/(schema|rows)", url.path)
            if url.path == "/health":
                return self.reply(200, {"status": "ok"})
            if url.path in ("/api/sql", "/api/sql/prepare", "/api/sql/execute", "/api/sql/deallocate", "/api/admin/compact", "/api/admin/flush", "/compact", "/flush"):
                return self.reply(405, {"success": False, "error": "method not allowed"})
            with pool as e:
                c = e.store.catalog
                if url.path == "/stats":
                    return self.reply(200, {"tables": len(c.tables), "views": len(c.views), "folders": sum(len(t.folders) for t in c.tables.values())})
                if url.path == "/api/tables":
                    return self.reply(200, {"tables": sorted(c.tables), "views": sorted(c.views), "materialized_views": sorted(c.matviews)})
                if table and table[1] in c.tables:
                    t = c.tables[table[1]]
                    if table[2] == "schema":
                        return self.reply(200, {"table": t.name, "columns": [{"name": n, "type": k, "primary_key": n == t.key} for n, k in t.columns], "indexes": t.indexes})
                    n = (parse_qs(url.query).get("limit") or [str(ROWS)])[0]
                    if not n.isdigit():
                        return self.reply(400, {"success": False, "error": "limit must be a number"})
                    return self.reply(200, as_json(e.execute(f"SELECT * FROM {t.name} LIMIT {n}")))
            return self.reply(404, {"success": False, "error": "not found"})

        def do_POST(self) -> None:
            path, body = urlsplit(self.path).path, self.body()
            if path in ("/api/admin/compact", "/compact", "/api/admin/flush", "/flush"):
                return self.reply(200, run_script(pool, "VACUUM"))
            if path == "/api/sql":
                kind = (self.headers.get("Content-Type") or "text/plain").split(";")[0].strip()
                if kind == "application/json":
                    try:
                        body = json.loads(body)["sql"]
                    except (ValueError, KeyError, TypeError):
                        return self.reply(400, {"success": False, "error": "expected a JSON object with sql"})
                elif kind != "text/plain":
                    return self.reply(415, {"success": False, "error": "unsupported media type"})
                if not body.strip():
                    return self.reply(400, {"success": False, "error": "empty statement"})
                out = run_script(pool, body)
                return self.reply(200 if out["success"] else 400, out)
            if path in ("/api/sql/prepare", "/api/sql/execute", "/api/sql/deallocate"):
                try:
                    x = json.loads(body)
                    name = x["name"]
                    if not re.fullmatch(r"[A-Za-z_]\w*", name):
                        raise SqlError("bad name")
                    args = ", ".join(map(literal, x.get("params", [])))
                    sql = {"prepare": lambda: f"PREPARE {name} AS {x['sql']}", "execute": lambda: f"EXECUTE {name}({args})", "deallocate": lambda: f"DEALLOCATE {name}"}[path.rsplit("/", 1)[1]]()
                except (ValueError, KeyError, TypeError, SqlError) as e:
                    return self.reply(400, {"success": False, "error": f"bad request: {e}"})
                out = run_script(pool, sql)
                return self.reply(200 if out["success"] else 400, out)
            return self.reply(404, {"success": False, "error": "not found"})

    return Handler


def http(spark: SparkSession, config: EngineConfig) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((config.server_host, config.server_port), handler(Pool(spark, config)))


class Shell:
    """One command a line: SQL statements, or keys in ``mode kv``."""

    def __init__(self, engine: Engine, kv: KvStore):
        self.engine, self.kv, self.mode, self.txn = engine, kv, "sql", None

    def run(self, line: str) -> str:
        line = line.strip()
        if not line:
            return ""
        word = line.rstrip(";").split()[0].lower()
        if word == "mode":
            self.mode = "kv" if line.endswith("kv") else "sql"
            return f"mode {self.mode}"
        if self.mode == "sql":
            if self.txn is not None:
                return "Error: SQL is not allowed while a key-value transaction is open"
            return "\n".join(r.text() for r in self.engine.script(line))
        try:
            return self.key_value(word, shlex.split(line)[1:])
        except (ValueError, OSError) as e:
            return f"Error: {e}"

    def key_value(self, word: str, args: list[str]) -> str:
        at = self.txn or self.kv
        match word, len(args):
            case "get", 1:
                v = at.get(args[0])
                return "(nil)" if v is None else v
            case ("put" | "set"), 2:
                at.put(*args)
            case ("delete" | "del"), 1:
                at.delete(*args)
            case "scan", 0 | 1 | 2:
                rows = at.scan(*args)
                pairs = rows if isinstance(rows, list) else [tuple(r) for r in rows.toLocalIterator()]
                return "\n".join(f"{k} = {v}" for k, v in pairs) or "(empty)"
            case "list", 0:
                return "\n".join(r["key"] for r in self.kv.scan().toLocalIterator()) or "(empty)"
            case "count", 0:
                return str(self.kv.count())
            case "stats", 0:
                return json.dumps(self.kv.stats())
            case "begin", 0:
                if self.txn:
                    raise ValueError("a transaction is open")
                self.txn = self.kv.begin()
            case "commit", 0:
                self._open().commit()
                self.txn = None
            case "rollback", 0:
                self._open().rollback()
                self.txn = None
            case "compact", 0:
                return f"compacted {self.kv.compact()} folder(s)"
            case "dump", 1:
                return f"dumped {self.kv.dump(args[0])} key(s)"
            case "load", 1:
                return f"loaded {self.kv.load(args[0])} key(s)"
            case _:
                raise ValueError(f"unknown command '{word}'")
        return "OK"

    def _open(self):
        if self.txn is None:
            raise ValueError("no transaction is open")
        return self.txn


def tcp(spark: SparkSession, config: EngineConfig) -> socketserver.ThreadingTCPServer:
    """The line protocol: a command a line, its answer, and an empty line."""
    free = threading.BoundedSemaphore(config.max_connections)

    class Line(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            with free:
                shell = Shell(Engine(spark, config.warehouse_dir), KvStore(spark, config.warehouse_dir))
                for raw in self.rfile:
                    self.wfile.write((shell.run(raw.decode()) + "\n\n").encode())

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address = daemon_threads = True

    return Server((config.server_host, config.server_port), Line)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--config")
    p.add_argument("--data-dir")
    p.add_argument("--host")
    p.add_argument("--port", type=int)
    p.add_argument("--tcp", action="store_true")
    p.add_argument("--repl", action="store_true")
    a = p.parse_args(argv)
    config = EngineConfig.load(a.config, data_dir=a.data_dir, server_host=a.host, server_port=a.port)
    spark = session()
    if a.repl:
        shell = Shell(Engine(spark, config.warehouse_dir), KvStore(spark, config.warehouse_dir))
        for line in sys.stdin:
            if line.strip().lower() in ("exit", "quit"):
                break
            print(shell.run(line), flush=True)
        return
    (tcp if a.tcp else http)(spark, config).serve_forever()


if __name__ == "__main__":
    main()
