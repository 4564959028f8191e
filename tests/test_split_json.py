"""Documents cut into byte ranges give what whole documents give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditlens.sources.ingest import read_json_documents
from auditlens.sources.split_json import read_large_documents

TEXTS = ['}', '{', '"', '\\', '\\"', '}{][', '\\}', 'ä€😀', '\n', 'a}b"c', '\\\\"}', "", ":[{", "Records"]


@pytest.fixture(params=[90, 700])
def small_ranges(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice([rng.choice(TEXTS), rng.randrange(100), None, True, 1.5])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(TEXTS) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def member(rng):
    return {"k": value(rng), "n": rng.randrange(1000)} if rng.random() < 0.85 else rng.choice(
        [5, "}", None, [1], [{"in": {"a": 1}}]]
    )


def rows(events):
    listed = events.select(
        F.element_at(F.split("file", "/"), -1).alias("f"), "row", F.to_json("event").alias("e")
    )
    return sorted((r.f, r.row, r.e) for r in listed.collect())


def test_equal_to_whole_documents(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    for n in range(8):
        records = [member(rng) for _ in range(rng.randrange(0, 16))]
        doc = records if n % 2 else {"a}": {"b": {"c": "]}"}}, "Records": records, "z": [{"q": 1}, 2]}
        text = json.dumps(doc, ensure_ascii=n % 3 == 0, indent=None if n % 4 else 1)
        (tmp_path / f"{n:02}.json").write_text(text + ["", "\n", " \r\n"][n % 3], encoding="utf-8")
    (tmp_path / "bom.json").write_bytes(b'\xef\xbb\xbf[{"a": 1}, {"a": "}"}]')
    events, other = read_large_documents(spark, str(tmp_path))
    want = [r for r in rows(read_json_documents(spark, str(tmp_path))) if r[0] != "bom.json"]
    want += [("bom.json", 1, '{"a":1}'), ("bom.json", 2, '{"a":"}"}')]
    found = rows(events)
    left = {r.file.split("/")[-1] for r in other.collect()}
    assert found == [r for r in want if r[0] not in left]
    # only lists in lists that are longer than a range are left to the other reader
    assert all(r.reason == "no list" for r in other.collect())
    assert len(left) < 4 and len(found) > 20


def test_what_is_no_list_is_reported(spark, tmp_path, small_ranges):
    files = {
        "cut": '{"Records": [{"a": 1}, {"b": {"c": 2}',
        "brace": '[{"a": 1}]}',
        "comma": '[{"a": 1} {"a": 2}]',
        "member": '[{"a": 1}, {"a": oops}, {"b": "' + "x" * 300 + '"}]',
        "one": '{"eventName": "x", "userIdentity": {"type": "y"}}',
        "wrapped": '{"audit_log": {"eventName": "x", "userIdentity": {"type": "y"}}}',
        "empty": "",
        "fine": '{"Records": [{"a": 1}, 7, {"a": "' + "y}" * 200 + '"}]}\n',
        "none": '{"Records": []}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    events, other = read_large_documents(spark, str(tmp_path))
    assert {r.file.split("/")[-1][:-5]: r.reason for r in other.collect()} == {
        "cut": "not JSON", "brace": "not JSON", "comma": "not JSON", "member": "not JSON",
        "one": "no list", "wrapped": "no list",
    }
    assert [(f, n) for f, n, _ in rows(events)] == [("fine.json", 1), ("fine.json", 3)]


def test_a_document_is_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps([{"n": n} for n in range(200)]))
    from auditlens.sources import split_json

    seen = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert seen.rdd.getNumPartitions() > 4
    events, other = split_json.read_large_documents(spark, str(tmp_path))
    assert [json.loads(e)["n"] + 1 for _, _, e in rows(events)] == list(range(1, 201))
    assert [r for _, r, _ in rows(events)] == list(range(1, 201))
    assert other.isEmpty()
