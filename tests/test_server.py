import json
import socket
import threading
import urllib.error
import urllib.request

import pytest

from marlspar.server import Shell, http, tcp
from marlspar.session import Engine, EngineConfig
from marlspar.sources.kv import KvStore


@pytest.fixture
def base(spark, tmp_path):
    server = http(spark, EngineConfig(warehouse_dir=str(tmp_path), server_port=0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def ask(url, body=None, kind="text/plain"):
    data = None if body is None else (body if isinstance(body, str) else json.dumps(body)).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": kind}), timeout=60) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(base):
    code, out = ask(base + "/api/sql", "CREATE TABLE t (id INT, name TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); SELECT * FROM t ORDER BY id ASC")
    assert code == 200 and out["executed_count"] == 3 and out["type"] == "select" and out["rows"] == [[1, "a"], [2, "b"]]
    code, out = ask(base + "/api/sql", "INSERT INTO t VALUES (3, 'c'); SELECT * FROM missing; SELECT 1")
    assert code == 400 and out["executed_count"] == 1 and "does not exist" in out["error"]
    j = "application/json"
    assert ask(base + "/api/sql/prepare", {"name": "p", "sql": "SELECT name FROM t WHERE id = $1"}, j)[0] == 200
    assert ask(base + "/api/sql/execute", {"name": "p", "params": [2]}, j)[1]["rows"] == [["b"]]
    assert ask(base + "/api/sql/deallocate", {"name": "p"}, j)[0] == 200
    assert ask(base + "/api/tables")[1]["tables"] == ["t"]
    assert ask(base + "/api/tables/t/schema")[1]["columns"][0] == {"name": "id", "type": "INT", "primary_key": True}
    assert len(ask(base + "/api/tables/t/rows?limit=2")[1]["rows"]) == 2
    assert ask(base + "/health")[1] == {"status": "ok"}
    assert ask(base + "/nowhere")[0] == 404 and ask(base + "/api/sql")[0] == 405
    assert ask(base + "/api/sql", "x", "text/html")[0] == 415 and ask(base + "/api/sql", "{}", j)[0] == 400


def test_shell(spark, tmp_path):
    s = Shell(Engine(spark, str(tmp_path)), KvStore(spark, str(tmp_path)))
    assert s.run("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)") == "Table 't' created\nInserted 1 row(s)"
    s.run("mode kv")
    assert [s.run(x) for x in ("put a 1", "get a", "begin", "put b 2", "scan", "get zz")] == ["OK", "1", "OK", "OK", "a = 1\nb = 2", "(nil)"]
    s.run("mode sql")
    assert "not allowed" in s.run("SELECT 1")
    s.run("mode kv")
    assert s.run("commit") == "OK" and s.run("count") == "2" and s.run("what") == "Error: unknown command 'what'"


def test_tcp(spark, tmp_path):
    server = tcp(spark, EngineConfig(warehouse_dir=str(tmp_path), server_port=0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with socket.create_connection(server.server_address[:2], timeout=60) as c:
        f = c.makefile("rw")
        f.write("SELECT 1 AS one\n")
        f.flush()
        assert [f.readline() for _ in range(5)] == ["one\n", "---\n", "1  \n", "(1 rows)\n", "\n"]
    server.shutdown()
