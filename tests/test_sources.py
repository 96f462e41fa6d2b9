import csv
import random

import pytest

from tableprep import CsvError, PrepError, ingest_stats, latest_per_key, list_results, read_csv, store_results, table_preview


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scan_types_and_missing_tokens(spark, tmp_path):
    text = 'a,b,c,d,e\n1,1.5,x,True,\n2,NA,"N/A",False,\n 3 ,2e3,"say ""hi"", you",true,\n'
    df = read_csv(spark, write(tmp_path, text))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if not f.name.startswith("__tp_")}
    assert kinds == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "double"}
    rows = df.orderBy("__tp_row").drop("__tp_row").collect()
    assert [tuple(r) for r in rows] == [(1, 1.5, "x", True, None), (2, None, None, False, None), (3, 2000.0, 'say "hi", you', True, None)]


def test_cells_that_span_lines(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, 'a,b\n1,"two\nlines"\n2,z\n'))
    assert [r["b"] for r in df.orderBy("a").collect()] == ["two\nlines", "z"]


def test_row_order_is_file_order(spark, tmp_path):
    lines = "\n".join(str(i * 7919 % 1000) for i in range(1000))
    df = read_csv(spark, write(tmp_path, "v\n" + lines + "\n"))
    assert [r["v"] for r in table_preview(df, 3).collect()] == [0, 919, 838]
    assert table_preview(df, 3).first()["total_rows"] == 1000
    with pytest.raises(PrepError):
        table_preview(df, 21)


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(CsvError, match="empty"):
        read_csv(spark, write(tmp_path, ""))
    with pytest.raises(CsvError, match="more cells"):
        read_csv(spark, write(tmp_path, "a,b\n1,2\n1,2,3\n"))
    with pytest.raises(CsvError):
        read_csv(spark, str(tmp_path / "absent.csv"))
    short = read_csv(spark, write(tmp_path, "a,b\n1\n2,3\n", "short.csv"))
    assert [(r["a"], r["b"]) for r in short.orderBy("a").collect()] == [(1, None), (2, 3)]


def test_stats_and_result_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1)], "id int, k string, at int")
    row = ingest_stats(df).first()
    assert (row["row_count"], row["column_count"], row["columns"]) == (3, 3, ["id", "k", "at"])
    assert {(r["k"], r["id"]) for r in latest_per_key(df, ["k"], "at").collect()} == {("a", 2), ("b", 3)}
    store_results(df, "one", str(tmp_path / "res"))
    store_results(df.limit(1), "two", str(tmp_path / "res"))
    assert list_results(spark, str(tmp_path / "res"), "one", "id").count() == 3


def test_csv_folder_is_read_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "2.csv").write_text("b,a\nz,3\n")
    got = read_csv(spark, str(tmp_path), row_order=False)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"} and sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "3.csv").write_text("a,c\n1,2\n")
    with pytest.raises(CsvError, match="different columns: b, c"):
        read_csv(spark, str(tmp_path))


def test_csv_repeated_names_stay_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,a,A,,b\n1,2,3,4,5\n")
    got = read_csv(spark, str(tmp_path / "t.csv"), row_order=False)
    assert got.columns == ["a", "a.1", "A.2", "Unnamed: 3", "b"] and tuple(got.first()) == (1, 2, 3, 4, 5)


@pytest.fixture
def tiny_splits(spark):
    """Splits of 200 bytes, so that cells and records cross many of them."""
    small = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _cell(dice):
    kind = dice.randrange(7)
    words = ["".join(dice.choices("xyz ,\"\n", k=dice.randrange(1, 12))) for _ in range(dice.choice([1, 1, 1, 8]))]
    if kind < 2:
        return "".join(c for c in words[0] if c not in ',\n"') + "w"
    if kind == 2:
        return 'w"' + "".join(c for c in words[0] if c not in ",\n")  # a quote that opens nothing
    return '"' + "q\n".join(words).replace('"', '""') + '"'


@pytest.mark.parametrize("seed,end", [(1, "\n"), (3, "\r\n")])
def test_records_of_many_splits(spark, tmp_path, tiny_splits, seed, end):
    dice = random.Random(seed)
    lines = ['id,"first\nname",c'] + [f"{i},{_cell(dice)},{_cell(dice)}" for i in range(60)]
    lines.insert(40, "")
    text = end.join(lines) + end
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    names, *rows = [r for r in csv.reader(text.splitlines(keepends=True)) if r]
    assert text.count("\n") > len(rows) + 10
    got = read_csv(spark, str(path))
    assert got.drop("__tp_row").columns == names
    assert [[str(v) for v in r[:3]] for r in got.orderBy("__tp_row").collect()] == rows


def test_records_of_a_folder_and_of_one_endless_cell(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {i}" for i in range(120))
    (tmp_path / "1.csv").write_text(f'a,b\n1,"{long}"\n2,y\n')
    (tmp_path / "2.csv").write_text('b,a\n"z\n\nz",3\n')
    (tmp_path / "3.csv").write_text('a,b\n4,"never closed\n5,x')
    got = read_csv(spark, str(tmp_path)).orderBy("a").drop("__tp_row")
    assert [tuple(r) for r in got.collect()] == [(1, long), (2, "y"), (3, "z\n\nz"), (4, "never closed\n5,x")]


def test_one_file_with_line_breaks_is_read_by_several_tasks(spark, tmp_path, tiny_splits):
    from tableprep.sources.csv_records import csv_records

    path = write(tmp_path, "a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(50)))
    records = csv_records(spark, path)
    assert records.count() == 51 and records.select("block").distinct().count() > 2


def test_cells_that_span_lines_are_parsed_once(spark, tmp_path, capsys):
    df = read_csv(spark, write(tmp_path, 'a,"b,; (c)`=",a\n1,"two\nlines",2.5\n,x,n/a\n'))
    assert df.columns == ["a", "b,; (c)`=", "a.1", "__tp_row"]
    assert [tuple(r)[:3] for r in df.orderBy("a").collect()] == [(None, "x", None), (1, "two\nlines", 2.5)]
    df.explain()
    assert "from_csv" not in capsys.readouterr().out
