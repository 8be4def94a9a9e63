import json

from marlspar.sources.kv import KvStore


def test_log(spark, tmp_path):
    kv = KvStore(spark, str(tmp_path))
    kv.commit({"a": "1", "b": "2", "c": "3"})
    t = kv.begin()
    kv.put("a", "9")
    kv.delete("b")
    assert kv.get("a") == "9" and kv.get("b") is None and kv.get("zz") is None
    assert t.get("a") == "1" and t.scan("a", "b") == [("a", "1"), ("b", "2")]
    t.put("d", "4")
    t.delete("c")
    assert t.get("d") == "4" and ("c", "3") not in t.scan()
    t.commit()
    assert [tuple(r) for r in kv.scan().collect()] == [("a", "9"), ("d", "4")]
    r = kv.begin()
    r.put("x", "no")
    r.rollback()
    assert kv.compact() == 4 and kv.count() == 2
    again = KvStore(spark, str(tmp_path), "READ COMMITTED")
    assert again.get("a") == "9" and again.stats()["folders"] == 1
    t = again.begin()
    again.put("a", "10")
    assert t.get("a") == "10"
    assert again.dump(str(tmp_path / "d.json")) == 2
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": "10", "d": "4"}
    assert KvStore(spark, str(tmp_path / "other")).load(str(tmp_path / "d.json")) == 2
