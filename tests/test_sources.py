import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from shelfmark.cli import load_dotenv, main, parser, setting
from shelfmark.sources import files, jdbc, synth

DATE = dt.date(2024, 1, 2)


def test_parts_manifest_and_overwrite_protection(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(25).select(F.col("id").cast("string").alias("id"), F.array("id").alias("a"), F.col("id").cast("string").cast("binary").alias("b"))
    manifest = files.write_parts(df.coalesce(1), folder, "t", DATE, rows_per_file=10)
    assert manifest["files"] == [f"t_2024_01_02_part-0000{i}.parquet" for i in range(3)] and manifest["rows"] == 25
    assert json.loads((tmp_path / "out/t_2024_01_02_manifest.json").read_text())["reconciled"] is True
    row = spark.read.parquet(*files.discover(spark, folder, "t")).where("id = '3'").first()
    assert (row.a, row.b) == ("[3]", "33")
    with pytest.raises(FileExistsError):
        files.write_parts(df, folder, "t", DATE)
    assert files.write_parts(df.limit(5).coalesce(1), folder, "t", DATE, overwrite=True)["rows"] == 5
    assert len(files.discover(spark, folder, "t")) == 1
    files.write_parts(df.limit(1), folder, "t_more", DATE)
    assert len(files.discover(spark, folder, "t")) == 1
    assert files.discover(spark, folder, "t", set(files.discover(spark, folder, "t"))) == []
    assert files.discover(spark, str(tmp_path / "none"), "t") == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="no"):
        files.write_parts(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), folder, "t", DATE)
    assert not any((tmp_path / "out").rglob("*.parquet"))


def test_upload_selects_and_protects(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    for day in (2, 3):
        files.write_parts(spark.range(3), source, "t", dt.date(2024, 1, day))
    n = len(files.discover(spark, source, "t")) // 2
    assert len(files.upload(spark, source, target, date="2024_01_02")["copied"]) == n
    again = files.upload(spark, source, target, date="2024_01_02")
    assert (len(again["copied"]), len(again["skipped"])) == (0, n)
    assert len(files.upload(spark, source, target, manifests=True, overwrite=True)["copied"]) == 2 * n + 2
    with pytest.raises(ValueError):
        files.upload(spark, source, target, date="2024-01-02")
    with pytest.raises(FileNotFoundError):
        files.upload(spark, source, target, date="1999_01_01")


def test_csv_by_header_name_and_missing_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).collect()] == [("2", "1", None)]
    assert files.read_csv_if_there(spark, str(tmp_path), ["no.csv", "x.csv"], ["a"]).count() == 1
    assert files.read_csv_if_there(spark, str(tmp_path), ["no.csv"], ["a"]) is None


def test_types_from_first_values(spark):
    rows = [{"a": None, "b": 1, "c": {"x": [1]}, "d": uuid.UUID(int=1)}, {"a": 2.5, "b": None, "c": None, "d": None}]
    df = files.typed_rows(spark, rows, ["a", "b", "c", "d", "e"])
    assert [t for _, t in df.dtypes] == ["double", "bigint", "string", "string", "string"]
    assert df.first().c == '{"x": [1]}' and df.first().d == str(uuid.UUID(int=1))
    with pytest.raises(Exception):
        files.typed_rows(spark, [{"a": 1}, {"a": "x"}], ["a"]).collect()


def test_generator_is_deterministic_and_keeps_its_shares(spark):
    raw = synth.retail_raw(spark, 4000)
    assert raw.agg(F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)"))).first() == synth.retail_raw(spark, 4000).repartition(7).agg(F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)"))).first()
    heads, lines = synth.headers_and_lines(raw)
    assert heads.count() == 4000
    guests = heads.where("customer_id is null").count() / 4000
    assert 0.12 < guests < 0.19
    sizes = lines.groupBy("invoice_id").count()
    assert 0.015 < sizes.where("count > 8").count() / 4000 < 0.045
    years = {r[0]: r[1] / 4000 for r in heads.where("invoice_date is not null").groupBy(F.substring("invoice_date", 1, 4)).count().collect()}
    assert abs(years["2023"] - 0.30) < 0.04 and abs(years["2025"] - 0.37) < 0.04
    assert heads.join(lines, "invoice_id", "left_anti").count() > 0


def test_jdbc_options_and_table_choice():
    assert jdbc.options("u", "s", 'a"b')["dbtable"] == '"s"."a""b"'
    assert jdbc.chosen_tables({"b", "a"}, None) == ["a", "b"]
    assert jdbc.chosen_tables({"b", "a"}, ["b", "a", "b"]) == ["b", "a"]
    with pytest.raises(LookupError, match="c"):
        jdbc.chosen_tables({"a"}, ["c"])


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport SHELFMARK_ROOT='x'\nSHELFMARK_RAW=y\nbroken\n")
    found = load_dotenv(str(tmp_path / ".env"))
    assert found == {"SHELFMARK_ROOT": "x", "SHELFMARK_RAW": "y"}
    monkeypatch.setenv("SHELFMARK_RAW", "z")
    assert setting("SHELFMARK_RAW", "d", found) == "z" and setting("OTHER", "d", found) == "d"
    args = parser(found).parse_args(["bronze", "--table", "stores", "--table", "products"])
    assert (args.root, args.raw, args.table) == ("x", "z", ["stores", "products"])


def test_command_line_from_csv_to_report(spark, tmp_path, capsys):
    csv, raw, root = (str(tmp_path / x) for x in ("csv", "raw", "root"))
    for name, df in (("stores", synth.stores(spark, 4)), ("products", synth.products(spark, 20)), ("customers", synth.customers(spark, 30)), ("retail_raw", synth.retail_raw(spark, 60, store_count=4, product_count=20, customer_count=30))):
        synth.write_csv(df, csv, name, sample=5, order=df.columns[0])
    assert main(["--root", root, "--raw", raw, "extract", "--csv", csv, "--date", "2024-01-02"]) == 0
    assert main(["--root", root, "--raw", raw, "silver"]) == 2
    assert main(["--root", root, "--raw", raw, "--as-of", "2026-01-01 00:00:00", "run"]) == 0
    assert "executive" in capsys.readouterr().out


def test_part_numbers_of_six_digits_are_found(spark, tmp_path):
    from shelfmark.sources.files import discover

    for name in ("t_2024_01_01_part-99999.parquet", "t_2024_01_01_part-100000.parquet", "t_2024_01_01_part-1.parquet"):
        (tmp_path / name).write_bytes(b"")
    assert [p.rsplit("-", 1)[1] for p in discover(spark, str(tmp_path), "t")] == ["100000.parquet", "99999.parquet"]


def test_files_that_were_begun_are_merged_and_new_ones_appended(spark, tmp_path):
    import datetime as dt

    from shelfmark.operators.store import TableStore
    from shelfmark.sources.files import write_parts
    from shelfmark.streaming import ingest

    store, raw, now = TableStore(spark, str(tmp_path / "lake")), str(tmp_path / "raw"), "2024-01-02 00:00:00"
    rows = spark.createDataFrame([(str(i), "1", None, "2024-01-01", "Cash") for i in range(6)], "invoice_id string, store_id string, customer_id string, invoice_date string, payment_method string")
    write_parts(rows.coalesce(1), raw, "invoices", dt.date(2024, 1, 1))
    path = ingest.discover(spark, raw, "invoices")[0]
    # A run that loaded the file and died before it could say so.
    ingest.mark(store, "invoices", [path], now, "STARTED")
    ingest.append_bronze(store, "invoices", ingest.with_lineage(spark.read.parquet(path), now))
    assert ingest.ingest(spark, store, raw, "invoices", now) == [path]
    assert store.read("bronze/invoices").count() == 6
    write_parts(rows.coalesce(1), raw, "invoices", dt.date(2024, 1, 2))
    assert len(ingest.ingest(spark, store, raw, "invoices", now)) == 1
    assert store.read("bronze/invoices").count() == 12 and ingest.ingest(spark, store, raw, "invoices", now) == []
