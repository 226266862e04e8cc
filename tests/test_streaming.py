"""Structured Streaming ingest: many uploads per micro-batch, typed and cleaned each
on its own, and a restarted query resumes (no upload is loaded twice)."""

import os

from pyspark.sql import functions as F

from conftest import SMALL
from tillsight.plans.catalog import sales
from tillsight.plans.etl import file_order, transform_upload
from tillsight.sinks import uploads
from tillsight.sinks.writers import CSV_OPTIONS, land_uploads, read_sales
from tillsight.sources.headers import header_groups, unique_names
from tillsight.sources.raw import read_raw_csv
from tillsight.sources.tables import Tables
from tillsight.streaming.ingest import ingest_landing

COLS = ["Order Date", "Product Name", "Category", "Quantity", "Sales", "Customer ID", "Region", "Stock Level"]
NOW = "2024-01-01 00:00:00"


def _write_upload(spark, s, uid, folder, edit=lambda p: p):
    part = s.where(F.col("user_id") == uid).select(
        F.date_format("date", "yyyy-MM-dd").alias(COLS[0]), F.col("product_name").alias(COLS[1]),
        F.col("category").alias(COLS[2]), F.col("quantity").cast("string").alias(COLS[3]),
        F.col("total_sales").cast("string").alias(COLS[4]), F.col("customer_id").alias(COLS[5]),
        F.col("region").alias(COLS[6]), F.col("inventory_level").cast("string").alias(COLS[7]))
    path = f"{folder}/user_id={uid}/dataset_id=1"
    os.makedirs(path)
    rows = edit(part.distinct().toPandas())   # test fixture: a few hundred rows
    rows.to_csv(f"{path}/upload.csv", index=False)
    return rows


def test_stream_ingest_many_uploads_and_resume(spark, tmp_path):
    s = sales(Tables(spark, SMALL))
    landing, table, ckpt = (str(tmp_path / n) for n in ("landing", "table", "ckpt"))
    n = {u: len(_write_upload(spark, s, u, landing)) for u in (0, 1)}
    ingest_landing(spark, landing, table, ckpt, now=NOW).awaitTermination()
    counts = lambda: {r["user_id"]: r["count"] for r in
                      read_sales(spark, table).groupBy("user_id").count().collect()}
    assert counts() == n
    # a third upload arrives; the restarted query only loads the new files
    n[2] = len(_write_upload(spark, s, 2, landing))
    ingest_landing(spark, landing, table, ckpt, now=NOW).awaitTermination()
    assert counts() == n


def test_stream_types_each_upload_on_its_own(spark, tmp_path):
    """A bad amount in one upload leaves the other's amounts numeric; missing-value
    tokens, quotes and line breaks read as in the batch path."""
    s = sales(Tables(spark, SMALL))
    landing, table, ckpt = (str(tmp_path / n) for n in ("landing", "table", "ckpt"))

    def spoil(rows):
        rows.loc[0, "Sales"] = "twelve"
        return rows

    def mark(rows):
        rows.loc[0, "Product Name"] = 'TV 40" flat,\nblack'
        rows.loc[1, "Quantity"] = "N/A"
        return rows

    _write_upload(spark, s, 0, landing, spoil)
    given = _write_upload(spark, s, 1, landing, mark)
    ingest_landing(spark, landing, table, ckpt, now=NOW).awaitTermination()
    loaded = read_sales(spark, table).where("user_id = 1")
    assert loaded.where(F.col("product_name") == 'TV 40" flat,\nblack').count() == 1
    raw = read_raw_csv(spark, f"{landing}/user_id=1/dataset_id=1")
    _, batch, _ = transform_upload(file_order(raw), 1, 1, NOW)
    columns = ["product_name", "quantity", "customer_id"]
    revenue = F.round("total_sales", 2).alias("revenue")
    rows = lambda df: sorted(map(tuple, df.select(*columns, revenue).collect()))
    assert len(given) == loaded.count() and rows(loaded) == rows(batch)


ORDERS = [COLS, COLS[::-1], [COLS[i] for i in (3, 7, 1, 5, 0, 2, 6, 4)]]
OTHER = dict(zip(COLS, ["sale date", "item", "dept", "qty", "revenue", "client", "territory", "stock"]))


def _rows(df):
    columns = ["id", "date", "product_name", "category", "quantity", "customer_id", "region", "inventory_level"]
    return sorted(map(tuple, df.select(*columns, F.round("total_sales", 4).alias("revenue")).collect()))


def _batch(spark, path, uid):
    _, out, _ = transform_upload(file_order(read_raw_csv(spark, path)), uid, 1, NOW)
    return _rows(out)


def test_uploads_of_other_header_orders_equal_the_batch_path(spark, tmp_path):
    s = sales(Tables(spark, SMALL))
    landing, table, ckpt, log = (str(tmp_path / n) for n in ("landing", "table", "ckpt", "log"))
    for uid, order in enumerate(ORDERS):
        _write_upload(spark, s, uid, landing, lambda rows: rows[order])
    _write_upload(spark, s, 3, landing, lambda rows: rows[ORDERS[2]].rename(columns=OTHER))
    ingest_landing(spark, landing, table, ckpt, now=NOW, log_dir=log).awaitTermination()
    loaded = read_sales(spark, table)
    for uid in range(4):
        assert _rows(loaded.where(F.col("user_id") == uid)) == _batch(
            spark, f"{landing}/user_id={uid}/dataset_id=1", uid)
    states = uploads.latest(uploads.read_log(spark, log)).collect()
    assert {(r.user_id, r.status, r.row_count) for r in states} == {
        (r.user_id, "processed", r["count"]) for r in loaded.groupBy("user_id").count().collect()}


def test_files_of_one_upload_may_differ(spark, tmp_path):
    """Columns are matched by name; one that a file lacks is missing there."""
    folder = tmp_path / "landing" / "user_id=4" / "dataset_id=1"
    os.makedirs(folder)
    (folder / "a.csv").write_text("Sales,Product Name,Order Date\n10.5,Lamp,2024-01-05\n")
    (folder / "b.csv").write_text("Order Date, Sales \n2024-01-06,20\n")
    (folder / "c.csv").write_text('\ufeff"Order Date","Sales","Product\nName"\n2024-01-07,30,"x, ""y"""\n')
    landing, table, ckpt = (str(tmp_path / n) for n in ("landing", "table", "ckpt"))
    ingest_landing(spark, landing, table, ckpt, now=NOW).awaitTermination()
    got = read_sales(spark, table).orderBy("id").select("product_name", F.to_date("date").cast("string"), "total_sales")
    assert [tuple(r) for r in got.collect()] == [
        ("Lamp", "2024-01-05", 10.5), ("Lamp", "2024-01-06", 20.0), ("Lamp", "2024-01-07", 30.0)]   # mode


def test_headers_are_read_as_csv(spark):
    texts = ['a,b\n1,2', '\ufeff"x, 1","say ""hi""",c\r\n', "one", '"a\nb",c\n1,2', "a,,a,a\n", " a , b \n", ""]
    files = spark.createDataFrame([(f"/{i}", t.encode(), i, 1) for i, t in enumerate(texts)],
                                  "path string, content binary, user_id long, dataset_id long")
    found = {paths[0]: header for _, headers in header_groups(files) for header, paths in headers.items()}
    assert found == {"/0": ("a", "b"), "/1": ("x, 1", 'say "hi"', "c"), "/2": ("one",), "/3": ("a\nb", "c"),
                     "/4": ("a", "Unnamed: 1", "a.1", "a.2"), "/6": ("Unnamed: 0",)} | (
        {"/5": ("a", "b")} if "/5" in found else {})
    assert unique_names(["a", "", "a"]) == ["a", "Unnamed: 1", "a.1"]


def test_refused_and_failing_uploads_leave_the_others_alone(spark, tmp_path):
    s = sales(Tables(spark, SMALL))
    landing, table, ckpt, log = (str(tmp_path / n) for n in ("landing", "table", "ckpt", "log"))
    n = len(_write_upload(spark, s, 0, landing))
    for uid, name, text in ((1, "book.xlsx", "not a workbook"), (2, "notes.txt", "x"), (3, "bad.csv", "_row,_row\n1,2\n")):
        os.makedirs(f"{landing}/user_id={uid}/dataset_id=1")
        with open(f"{landing}/user_id={uid}/dataset_id=1/{name}", "w") as f:
            f.write(text)
    ingest_landing(spark, landing, table, ckpt, now=NOW, log_dir=log).awaitTermination()
    states = {r.user_id: r for r in uploads.latest(uploads.read_log(spark, log)).collect()}
    assert (states[0].status, states[0].row_count) == ("processed", n)
    assert (states[1].status, states[1].error) == ("failed", "no reader for .xlsx files")
    assert (states[2].status, states[2].error) == ("failed", "unsupported file type")
    assert states[3].status == "failed" and states[3].error
    assert {r.user_id for r in read_sales(spark, table).select("user_id").distinct().collect()} == {0}


def test_an_upload_cut_over_batches_is_loaded_whole_and_once(spark, tmp_path):
    """Its files may come in several micro-batches; each would replace the one before."""
    landing, table, ckpt, log = (str(tmp_path / n) for n in ("landing", "table", "ckpt", "log"))
    for uid, days in ((0, 3), (1, 2)):
        folder = tmp_path / "landing" / f"user_id={uid}" / "dataset_id=1"
        os.makedirs(folder)
        for d in range(1, days + 1):
            (folder / f"{d}.csv").write_text(f"Order Date,Product Name,Sales\n2024-01-0{d},Lamp {d},{d}0\n")
    os.makedirs(f"{landing}/user_id=2/dataset_id=1")
    for name in ("a.txt", "b.txt"):
        (tmp_path / "landing" / "user_id=2" / "dataset_id=1" / name).write_text("x")
    ingest_landing(spark, landing, table, ckpt, now=NOW, log_dir=log, files_per_batch=1).awaitTermination()
    got = read_sales(spark, table).groupBy("user_id").agg(F.count("id"), F.sum("total_sales")).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 60.0), (1, 2, 30.0)]
    events = uploads.read_log(spark, log).groupBy("user_id", "status").count().collect()
    assert {tuple(r) for r in events} == {(0, "uploaded", 1), (0, "processing", 1), (0, "processed", 1),
                                          (1, "uploaded", 1), (1, "processing", 1), (1, "processed", 1),
                                          (2, "uploaded", 1), (2, "failed", 1)}
    # another file for an upload that is known: the whole folder counts again
    (tmp_path / "landing" / "user_id=1" / "dataset_id=1" / "3.csv").write_text(
        "Order Date,Product Name,Sales\n2024-01-03,Lamp 3,30\n")
    ingest_landing(spark, landing, table, ckpt, now=NOW, log_dir=log, files_per_batch=1).awaitTermination()
    got = read_sales(spark, table).groupBy("user_id").agg(F.count("id"), F.sum("total_sales")).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 60.0), (1, 3, 60.0)]


def test_landed_files_pass_admission(spark, tmp_path):
    """An upload larger than a file may be is landed as several files, with all its rows."""
    rows = [(u, 1, f'{"é" * (i % 40)}"{i}", x', str(i), None) for u in (0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id bigint, dataset_id bigint, item string, qty string, note string")
    landing = str(tmp_path / "landing")
    land_uploads(df, landing, max_bytes=4000)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(landing) for f in files if f.endswith(".csv")]
    assert len(sizes) > 4 and max(sizes) <= 4000
    back = spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(landing)
    columns = ["user_id", "item", "qty"]
    key = lambda d: sorted((int(r[0]), r[1], r[2]) for r in d.select(*columns).collect())
    assert key(back) == key(df)
