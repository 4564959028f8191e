"""File shapes, quarantine, CSV cells, line numbers, labels."""

import json

import pytest
from pyspark.sql import functions as F

from auditlens.functions import labels as L
from auditlens.sources import ingest as I
from auditlens.sources import labelled as LD

E1 = {"eventName": "A", "eventTime": "2026-08-08T20:00:00+05:00", "userIdentity": {"arn": "x/y"}}
E2 = {"eventName": "B", "eventTime": "not a time"}


def names(df):
    return sorted(r.eventName for r in df.select("eventName").collect())


@pytest.mark.parametrize(
    "document, want",
    [
        ({"Records": [E1, 5, E2, "x"]}, ["A", "B"]),
        ([E1, None, E2], ["A", "B"]),
        (E1, ["A"]),
        ({"audit_log": E2}, ["B"]),
    ],
)
@pytest.mark.parametrize("indent", [None, 2])
def test_json_shapes(spark, tmp_path, document, want, indent):
    (tmp_path / "a.json").write_text(json.dumps(document, indent=indent))
    assert names(I.read_json_events(spark, str(tmp_path))) == want


def test_rows_are_positions_in_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([E1, 3, E2]))
    rows = I.read_json_events(spark, str(tmp_path)).select("row", "error").orderBy("row").collect()
    assert [(r.row, r.error) for r in rows] == [(1, None), (3, "unparsable event time")]


def test_bad_number_is_an_error_row_and_null_is_absent(spark, tmp_path):
    bad = {**E1, "geo_anomaly_score": "high", "api_burst_rate": None}
    (tmp_path / "a.json").write_text(json.dumps([bad]))
    assert I.read_json_events(spark, str(tmp_path)).first().error == "non-numeric: geo_anomaly_score"


def test_json_lines_with_quarantine_and_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{json.dumps(E1)}\n\n{{broken\n7\n{json.dumps(E2)}\n")
    lines = I.number_lines(I.read_lines(spark, str(tmp_path)))
    events, bad = I.parse_lines(lines)
    assert sorted(r.row for r in events.collect()) == [1, 5]
    assert sorted((r.row, r.reason) for r in bad.collect()) == [(3, "not JSON"), (4, "not an object")]


def test_line_numbers_over_several_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(1, 301)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        numbered = I.number_lines(I.read_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(numbered) == 2300
    assert all(r.value == f"line {r.row}" for r in numbered)


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "eventName,userIdentity.arn,userIdentity.mfaAuthenticated,accountId,login_freq_1h,eventTime\n"
        "A,arn:x/y,true,00123,-5,2026-08-08T09:00:00Z\n"
        "B,z\n"
        "C,q,false,1,1e3,2026-08-08T09:00:00Z,extra\n"
    )
    rows = {r.eventName: r for r in I.read_csv_events(spark, str(tmp_path)).collect()}
    assert rows["A"].accountId == "00123" and rows["A"].login_freq_1h == -5
    assert rows["A"].userIdentity.mfaAuthenticated == "true"
    assert rows["B"].accountId is None and rows["B"].userIdentity.arn == "z"
    assert rows["C"].login_freq_1h == 1000


def test_mixed_folder_by_extension(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(E1))
    (tmp_path / "b.log").write_text(json.dumps([E1, E2]))
    (tmp_path / "c.NDJSON").write_text(json.dumps(E2) + "\n")
    (tmp_path / "d.csv").write_text("eventName,eventTime\nD,2026-08-08T09:00:00Z\n")
    assert names(I.read_events(spark, str(tmp_path))) == ["A", "A", "B", "B", "D"]


def test_fallback_and_empty_input(spark, tmp_path):
    (tmp_path / "a.json").write_text(f"{json.dumps(E1)}\n{json.dumps(E2)}\n")
    assert names(I.with_fallback(spark, str(tmp_path / "a.json"), "jsonl")) == ["A", "B"]
    (tmp_path / "empty.json").write_text(" \n")
    with pytest.raises(ValueError):
        I.with_fallback(spark, str(tmp_path / "empty.json"))


def test_formats():
    assert [I.format_of(n) for n in ("a.CSV", "b.jsonl", "c.NdJson", "d.json", "e")] == [
        "csv", "jsonl", "jsonl", "json", "json",
    ]


def test_size_bound_reports_what_it_leaves_out(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("{" + " " * 100 + "}")
    small, large = I.split_by_size(I.list_files(spark, str(tmp_path)), 50)
    assert (small.count(), large.count()) == (1, 1)


def test_coerce_cell(spark):
    cells = [" -5 ", "1e3", "abc", "", "00123"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(I.coerce_cell(F.col("c")).cast("string")).collect()]
    assert got == ["-5", "1000.0", "abc", "", "123"]


@pytest.mark.parametrize(
    "cell, want",
    [("0", 0), ("4", 4), ("2", 2), ("C2", 2), ("C2: Vertical Escalation", 2), (" c 3", 3),
     ("2.7", 2), ("12", None), ("C5", None), ("2_x", None), ("", None), (None, None), ("2é", None)],
)
def test_text_labels(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(L.coerce_text(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("cell, want", [(2.5, 2), (3.5, 4), (2.7, 3), (4.6, None), (-0.4, 0),
                                        (float("nan"), None)])
def test_number_labels(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c double")
    assert df.select(L.coerce_number(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("cell, want", [("2", 2), ('"C3: x"', 3), ("true", None), ("null", None),
                                        ("3.5", 4), ("[1]", None)])
def test_variant_labels(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string").select(F.parse_json("c").alias("v"))
    assert df.select(L.coerce_variant(F.col("v"))).first()[0] == want


def test_first_usable_label_column_wins(spark):
    df = spark.createDataFrame([("bad", 3, "C1"), (None, None, "C1")],
                               "label string, threat_class int, y string")
    rows = L.with_label(df).collect()
    assert [(r.label, r.label_key) for r in rows] == [(3, "threat_class"), (1, "y")]
    assert set(L.with_label(df).columns) == {"label", "label_key"}


def test_dataset_checks(spark):
    def problem(counts):
        row = {f"class_{c}": counts.get(c, 0) for c in range(5)}
        df = spark.createDataFrame([{**row, "rows_used": sum(counts.values())}])
        return LD.check(df).first().problem

    assert problem({}) == "no labelled rows"
    assert problem({2: 50}) == "only one threat class: 2"
    assert problem({0: 20, 2: 12}) == "only 32 usable rows, at least 40 needed"
    assert problem({0: 90, 4: 3, 1: 9}).startswith("too few rows (class 1: 9, class 4: 3)")
    assert problem({0: 90, 1: 10}) == ""


def test_json_lines_taken_for_a_document_lose_nothing(spark, tmp_path):
    """A file of lines named .json is no document; the fallback reads all of its lines."""
    path = tmp_path / "lines.json"
    path.write_text('{"eventName": "A"}\n{"eventName": "B"}\n')
    assert I.read_events(spark, str(path), "json").isEmpty()
    broken = I.read_events(spark, str(path), "json", keep_broken=True).collect()
    assert [r.error for r in broken] == ["not JSON"]
    assert {r.eventName for r in I.with_fallback(spark, str(path)).collect()} == {"A", "B"}


def test_broken_texts_hold_no_event(spark):
    texts = ['{"a": 1}', ' {"a": 1} ', '{"a": 1} {"b": 2}', '{"a": 1} x', "", "{", "1, 2", "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(I.parse_one(F.col("t")).isNotNull()).collect()]
    assert got == [True, True, False, False, False, False, False, True]


def test_large_files_are_reported(spark, tmp_path):
    (tmp_path / "small.jsonl").write_text('{"eventName": "A"}\n')
    (tmp_path / "large.jsonl").write_text('{"eventName": "B"}\n' * 50)
    (tmp_path / "large.csv").write_text("eventName\n" + "C\n" * 500)
    rows = I.read_events(spark, str(tmp_path), max_file_bytes=100).collect()
    assert [r.eventName for r in rows if r.eventName] == ["A"]
    assert sorted(r.error for r in rows if "over 100" in (r.error or "")) == [
        "file of 1010 bytes is over 100", "file of 950 bytes is over 100"
    ]
    none = I.read_events(spark, str(tmp_path), "jsonl", max_file_bytes=1).collect()
    assert len(none) == 3 and all(r.error for r in none)
    assert I.read_events(spark, str(tmp_path)).filter("error IS NULL OR true").count() == 551


def test_a_text_is_parsed_once_whatever_reads_it(spark, tmp_path):
    path = str(tmp_path / "one.json")
    with open(path, "w") as out:
        out.write('{"eventTime": "2024-01-01T00:00:00Z", "eventName": "GetObject"}\n')
    records = spark.read.text(path).withColumnRenamed("value", "CloudTrailEvent")
    for events in (
        I.read_jsonl_events(spark, path)[0],
        I.with_event_columns(I.read_json_document_lines(spark, path), "event"),
        I.read_json_events(spark, path),
        I.with_event_columns(I.poll_records(records), "event"),
    ):
        known = events.filter("error IS NULL AND eventName = 'GetObject'")
        assert known.count() == 1
        plan = known._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1


@pytest.mark.parametrize("ids", [range(25), [3, 3, 3, 12, 12, None, None, 9, 29, 31]])
def test_large_exports_are_written_row_by_row(spark, tmp_path, ids):
    """One JSON document a file, of all its events, whatever ids repeat or are missing."""
    from auditlens.plans import io

    rows = [(i, f'"}}{{\n{n}' if n % 2 else None, n) for n, i in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id bigint, text string, n int").repartition(3)
    io._write_large_exports(events, f"{tmp_path}/out", 10)
    found = [json.loads(f.read_text())["Records"] for f in (tmp_path / "out").rglob("part-*.txt")]
    numbers = {None if i is None else i // 10 for i in ids}
    assert len(found) == len(numbers)
    assert all(len({r["event_id"] // 10 if "event_id" in r else None for r in d}) == 1 for d in found)
    read = [(r.get("event_id"), r.get("text"), r["n"]) for d in found for r in d]
    assert sorted(read, key=lambda r: r[2]) == rows
    # the reader finds every event of them
    again, other = io.split_json.read_large_documents(spark, f"{tmp_path}/out")
    assert other.isEmpty() and again.count() == len(rows)


def test_no_task_holds_large_exports_as_a_whole(spark, tmp_path, sf_dir, monkeypatch):
    from auditlens.plans import io

    plans = []
    writer = type(spark.range(1).write)
    text = writer.text

    def seen(self, path, *rest, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return text(self, path, *rest, **options)

    monkeypatch.setattr(writer, "text", seen)
    assert io.ingest_large_exports(spark, sf_dir).count() == 1000
    assert plans and not any("collect_list" in plan for plan in plans)
