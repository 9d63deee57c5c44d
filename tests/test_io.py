from pyspark.sql import types as T

from lendscope.session import work_path
from lendscope.sources import io as sio

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("s", T.StringType())])


def _file(tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    return str(tmp_path / "x.csv")


def test_columns_by_name_absent_and_extra(spark, tmp_path):
    path = _file(tmp_path, "s,extra,a\nhello,9,1\nbye,8,x\n")
    got = [tuple(r) for r in sio.read_csv(spark, path, SCHEMA).orderBy("s").collect()]
    assert got == [(None, None, "bye"), (1, None, "hello")]


def test_quotes_blanks_and_newlines(spark, tmp_path):
    path = _file(tmp_path, 'b,a,s\n1.5,1,"x ""q"" y"\n2.5,2,"  pad  "\n3.5,3,"two\nlines, one field"\n')
    got = {r.a: r.s for r in sio.read_csv(spark, path, SCHEMA, multi_line=True).collect()}
    assert got == {1: 'x "q" y', 2: "  pad  ", 3: "two\nlines, one field"}


def test_every_na_token_is_null(spark, tmp_path):
    path = _file(tmp_path, "a,b,s\n" + "".join(f'{i},1.0,"{t}"\n' for i, t in enumerate(sio.NA_TOKENS)) + "99,1.0,kept\n")
    got = {r.a: r.s for r in sio.read_csv(spark, path, SCHEMA).collect()}
    assert got.pop(99) == "kept" and len(got) == len(sio.NA_TOKENS) and not any(got.values())


def test_csv_round_trip(spark):
    rows = [(1, 0.5, '  "quoted", and, commas  '), (2, None, "two\nlines"), (3, 1e300, "\\back\\slash"), (None, -0.0, "plain")]
    path = sio.write_table(spark.createDataFrame(rows, SCHEMA), work_path(spark, "csv"), "csv")
    got = [tuple(r) for r in sio.read_csv(spark, path, SCHEMA, multi_line=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
