import pytest

from tabscope.sources import (
    dataset_metadata,
    detect_file_type,
    file_metadata,
    load,
    require_rows,
    results_as_json,
    write_results,
)
from tabscope.sources.readers import needs_multi_line
from tabscope.session import materialize, shared_folder


def test_extension_decides(spark):
    assert detect_file_type("/x/Data.CSV") == ".csv"
    assert detect_file_type("a.json") == ".json"
    assert detect_file_type("a.parquet") == ".parquet"
    for path in ("a.txt", "a.xlsx", "a"):
        with pytest.raises(ValueError):
            detect_file_type(path)


SHOP = """id,name,price,note
1,"pen, blue",1.5,"line one
line two"
2,ink,2.5,"say ""hi"", ok"
3,caf\u00e9,,\ufffd
"""


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_bytes(SHOP.encode())
    df = load(spark, str(path))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("price", "double"), ("note", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "pen, blue", 1.5, "line one\nline two"), (2, "ink", 2.5, 'say "hi", ok'), (3, "caf\u00e9", None, "\ufffd"),
    ]
    assert load(spark, str(path), encoding="UTF-8").count() == 3


@pytest.mark.parametrize(("line", "open_"), [
    ("a,b", False), ('"a, b",""', False), ('"say ""hi""",x', False), ('"""",""""""', False), ('"a,"",b",c', False),
    ('1,"line one', True), ('1,"""', True), ('"a""', True), ('5" nail,"line one', True), ('a,"b"c', True), ('"a,"x",b', True),
    ('"' + 'quoted "" ' * 20_000 + '"', False), ('"' + 'quoted "" ' * 20_000, True),
])
def test_lines_that_are_whole_records(spark, tmp_path, line, open_):
    path = tmp_path / "lines.csv"
    path.write_text("x,y\n" + line + "\n")
    assert needs_multi_line(spark, str(path)) == open_


def test_large_csv_without_line_breaks_is_split(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("n,text\n" + "".join(f'{i},"word, word {i}"\n' for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = load(spark, str(path))
        assert df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.count() == df.select("text").distinct().count() == 200_000


def test_written_csv_reads_back(spark, tmp_path):
    rows = [(1, 'a "quoted" text, with\nbreaks'), (2, "plain")]
    (path,) = write_results({"t": spark.createDataFrame(rows, "i int, s string")}, str(tmp_path), "csv")
    assert sorted(map(tuple, load(spark, path).collect())) == rows


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))


def test_latin_bytes_are_read_again(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name,n\ncafé,1\nplain,2\n".encode("latin-1"))
    assert {r["name"] for r in load(spark, str(path)).collect()} == {"café", "plain"}
    header = tmp_path / "header.csv"
    header.write_bytes("prénom,n\nx,1\n".encode("latin-1"))
    assert load(spark, str(header)).columns == ["prénom", "n"]
    utf = tmp_path / "utf.csv"
    utf.write_bytes("name,n\ncafé,1\n".encode())
    assert load(spark, str(utf)).first()["name"] == "café"


def test_json_document_and_lines(spark, tmp_path):
    whole = tmp_path / "whole.json"
    whole.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert load(spark, str(whole)).orderBy("a").collect()[1]["b"] is None
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert load(spark, str(lines), json_lines=True).count() == 2


def test_empty_tables_are_refused(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("a,b\n")
    with pytest.raises(ValueError, match="empty"):
        load(spark, str(path))
    with pytest.raises(ValueError, match="no columns"):
        require_rows(spark.range(3).select())


def test_metadata(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text("day,ticker,close\n2024-01-02,AB,1.5\n2024-01-03,AB,2.5\n")
    rows = dataset_metadata(load(spark, str(path))).orderBy("position").collect()
    assert [(r["column"], r["dtype"]) for r in rows] == [("day", "date"), ("ticker", "string"), ("close", "double")]
    assert {(r["rows"], r["columns"]) for r in rows} == {(2, 3)}
    (meta,) = file_metadata(spark, str(path)).collect()
    assert meta["file_name"] == "shop.csv" and meta["file_size_mb"] == 0.0


def test_results_are_written_and_json_is_clean(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["a"]), (2, 1.5, [])], "i int, x double, l array<string>")
    for fmt in ("parquet", "json", "csv"):
        (path,) = write_results({"t": df}, str(tmp_path), fmt)
        assert load(spark, path, json_lines=True).count() == 2
    with pytest.raises(ValueError):
        write_results({"t": df}, str(tmp_path), "pdf")
    texts = sorted(r["json"] for r in results_as_json(df).collect())
    assert texts == ['{"i":1,"x":null,"l":["a"]}', '{"i":2,"x":1.5,"l":[]}']


def test_materialize_uses_the_session_folder(spark):
    folder = shared_folder(spark)
    assert folder and spark.sparkContext.getCheckpointDir()
    assert materialize(spark.range(10)).count() == 10
