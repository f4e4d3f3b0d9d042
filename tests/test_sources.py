"""Reading, header resolution, required columns, exports."""

import csv

import pytest
from pyspark.errors import AnalysisException

from prioscope.operators.ingest import prepare_tickets, synthetic_ids
from prioscope.sources import sinks
from prioscope.sources import tickets as ST

HEADER = ["Ticket ID", "Ticket Subject", "Ticket Description", "Ticket Priority", "CSAT"]


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "t.csv", HEADER, [
        [" 1 ", 'say "hi", now', "line one\nline two", "High", "4"],
        ["2", "NA", "x", "P1", "n/a"],
        ["3", "dropped", "x", "none", "5"],
    ])
    rows = {r.ticket_id: r for r in prepare_tickets(ST.read_ticket_csv(spark, path)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].full_text == 'say "hi", now [SEP] line one line two'
    assert (rows["1"].priority, rows["1"].priority_rank, rows["1"].priority_raw) == (
        "high", 2, "High")
    assert rows["2"].subject == "" and rows["2"].csat_numeric is None
    assert rows["1"].csat_numeric == 4.0 and rows["1"].resolution_time is None


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        ST.read_ticket_csv(spark, str(tmp_path / "absent.csv"))


def test_first_alias_wins_and_headers_are_normalised():
    got = ST.resolve_columns(["  TITLE ", "message", "Body", "Urgency", "Channel"])
    assert got["subject"] == "  TITLE " and got["description"] == "Body"
    assert got["priority"] == "Urgency" and got["channel"] == "Channel"
    assert got["ticket_id"] is None


def test_colliding_header_keeps_its_data(spark):
    df = spark.createDataFrame([("a", "b")], "`Ticket Priority` STRING, priority STRING")
    out = ST.rename_to_standard(df, ST.resolve_columns(df.columns))
    assert out.columns == ["priority", "priority_original"]
    assert tuple(out.first()) == ("a", "b")


def test_required_columns(spark):
    df = spark.createDataFrame([("a", None, "high")],
                               "subject STRING, description STRING, priority STRING")
    with pytest.raises(ValueError, match="description"):
        prepare_tickets(df)
    with pytest.raises(ValueError, match="priority"):
        prepare_tickets(df.drop("priority"))


def test_ids_are_made_after_the_drop(spark, tmp_path):
    path = write(tmp_path / "t.csv", HEADER[1:], [
        [f"s{i}", "d", "none" if i % 3 == 0 else "low", ""] for i in range(10)])
    rows = prepare_tickets(ST.read_ticket_csv(spark, path)).collect()
    assert {r.subject: r.ticket_id for r in rows} == {
        f"s{i}": f"TKT-{n:06d}" for n, i in enumerate(i for i in range(10) if i % 3)}


def test_ids_by_order_on_both_paths(spark):
    df = spark.range(0, 500, 1, 7).selectExpr("id", "hash(id) AS k")
    small = {r.id: r.ticket_id for r in synthetic_ids(df, ["k", "id"]).collect()}
    large = {r.id: r.ticket_id for r in synthetic_ids(df, ["k", "id"]).collect()}
    assert small == large and len(set(small.values())) == 500


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_pseudo_labels_round_trip(spark, labelled, tmp_path, format):
    path = str(tmp_path / "labels")
    sinks.write_pseudo_labels(labelled, path, format)
    back = sinks.read_pseudo_labels(spark, path, format)
    kept = sinks.pseudo_label_columns(labelled)
    assert back.columns == kept.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kept.collect()))


def test_read_back_of_a_missing_export(spark, tmp_path):
    with pytest.raises(AnalysisException):
        sinks.read_pseudo_labels(spark, str(tmp_path / "absent"))


def test_a_whole_table_through_csv(spark, sf_dir, labelled, tmp_path):
    """The stage from CSV files gives the labels of the same tickets read from parquet."""
    from prioscope import fixtures
    from prioscope.plans import stages

    path = str(tmp_path / "csv")
    fixtures.raw_tickets(spark, sf_dir).write.option("header", True).option(
        "quote", '"').option("escape", '"').csv(path)
    got = stages.infer(ST.read_ticket_csv(spark, path), valence=fixtures.VALENCE)
    key = ["ticket_id", "full_text", "is_mismatch", "pseudo_label_quality"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(
        map(tuple, labelled.select(*key).collect()))


def test_one_file_is_many_tasks_where_fields_hold_no_line_breaks(spark, tmp_path):
    path = str(tmp_path / "flat")
    rows = spark.range(20_000).selectExpr(
        "CAST(id AS STRING) AS id", "'s' AS subject", "repeat('d', 40) AS description", "'high' AS priority")
    rows.coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert ST.read_ticket_csv(spark, path).rdd.getNumPartitions() == 1
        split = ST.read_ticket_csv(spark, path, line_breaks=False)
        assert split.rdd.getNumPartitions() > 1 and split.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_other_formats_take_the_same_path(spark, tmp_path):
    rows = spark.createDataFrame([(1, "N/A", [1, 2]), (2, "007", None)], "id INT, subject STRING, tags ARRAY<INT>")
    for kind in ("parquet", "json", "orc"):
        path = str(tmp_path / kind)
        rows.write.format(kind).save(path)
        got = ST.read_ticket_table(spark, path, kind)
        assert {t for _, t in got.dtypes} == {"string"}
        tags = '["1","2"]' if kind == "json" else "[1,2]"  # JSON numbers stay as they are written
        assert sorted((r.id, r.subject, r.tags) for r in got.collect()) == [("1", None, tags), ("2", "007", None)]


@pytest.mark.parametrize("value", ["1e400", "-1e400", "1e309", "inf", "nan"])
def test_numbers_beyond_doubles_are_missing(spark, value):
    from prioscope.functions import text as T

    row = spark.createDataFrame([(value,)], "v STRING").selectExpr(
        f"{T.to_number('v')} AS n", f"{T.duration_minutes('v')} AS d").first()
    assert row.n is None and row.d is None
