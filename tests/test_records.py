"""Records read by byte ranges: equal to Spark's reader of whole files, however the ranges fall."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from gradeflow.session import ensure_checkpoint_dir
from gradeflow.sources import io as IO
from gradeflow.sources.records import Quotes, read_records

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _write(spark, name, files):
    import os

    path = IO.scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    for i, text in enumerate(files):
        with open(f"{path}/part-{i}.csv", "wb") as f:
            f.write(text)
    return path


def _both(spark, path, sep, encoding):
    ours = sorted(map(tuple, read_records(spark, path, SCHEMA, sep, encoding).collect()), key=str)
    theirs = spark.read.schema(SCHEMA).options(**IO._CSV).option("sep", sep).option("encoding", encoding).csv(path)
    return ours, sorted(map(tuple, theirs.collect()), key=str)


@pytest.mark.parametrize("size,end", [(17, "\n"), (64, "\r\n"), (1 << 20, "\n")])
def test_equal_to_the_reader_of_whole_files(spark, small_ranges, size, end):
    ensure_checkpoint_dir(spark)
    rnd = random.Random(size)
    texts = ['plain', 'a 5" disk', '""', '"quoted"', f'"two{end}lines, with commas"', f'"say ""no""{end}{end}and ""yes"""', '"x"', '',
             f'"{end}"', '"' + f'long line{end}' * 12 + '"', ' kept blanks ', 'café', '","', '"a""', 'it"s"']
    texts.remove('"a""')  # never closed: the rest of the file would be one record
    files = []
    for n in (0, 1, 40, 25):
        rows = [f"{i},{rnd.choice(texts)},{rnd.randrange(99)}" for i in range(n)]
        files.append((end.join(["id,text,n", *rows]) + end * rnd.choice([0, 1, 2])).encode())
    path = _write(spark, "ranges", files)
    small_ranges(size)
    ours, theirs = _both(spark, path, ",", "UTF-8")
    assert end == "\n" or any("\r\n" in (r[1] or "") for r in ours)  # Spark's reader turns these into LF
    assert len(ours) == 66 and sorted([(i, t and t.replace("\r\n", "\n"), n) for i, t, n in ours], key=str) == theirs


def test_latin1_and_a_quoted_header(spark, small_ranges):
    body = 'id\t"te\nxt"\tn\n1\t"caf\xe9\n\x93hi\x94"\t3\n2\t\t\n'.encode("latin-1")
    path = _write(spark, "latin", [body, b""])
    small_ranges(5)
    ours, theirs = _both(spark, path, "\t", "ISO-8859-1")
    assert ours == theirs == [(1, "caf\xe9\n\x93hi\x94", 3), (2, None, None)]


def test_empty_lines_before_the_names(spark):
    path = _write(spark, "lead", [b"\n\r\nid,text,n\n1,a,2\n\n3,b,4", b"\nid,text,n"])
    assert sorted(map(tuple, read_records(spark, path, SCHEMA, ",").collect())) == [(1, "a", 2), (3, "b", 4)]
    assert read_records(spark, path, SCHEMA, ",", header=False).count() == 4


def test_a_file_is_many_tasks(spark, small_ranges):
    text = "id,text,n\n" + "".join(f'{i},"one\ntwo ""{i}""",{i}\n' for i in range(3000))
    path = _write(spark, "tasks", [text.encode()])
    small_ranges(8000)
    df = read_records(spark, path, SCHEMA, ",")
    assert df.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, df.collect())) == [(i, f'one\ntwo "{i}"', i) for i in range(3000)]


def test_missing_path(spark):
    with pytest.raises(AnalysisException):
        read_records(spark, IO.scratch_path(spark, "none"), SCHEMA)


@pytest.mark.parametrize("line,outside,inside", [
    (b'a,b', False, True), (b'a,"b', True, False), (b'"a', True, False), (b'a"b', False, False), (b'', False, True),
    (b'"a""', True, False), (b'"a"x"y,z', False, True), (b'"a","b"', False, True), (b'x","y', True, True), (b'",', True, False)])
def test_state_of_a_line(line, outside, inside):
    quotes = Quotes(b",")
    assert quotes.after(line, False) == outside
    if line not in (b'"a"x"y,z', b'"a","b"'):
        assert quotes.after(line, True) == inside


def test_predictions_begin_with_the_header(spark):
    path = IO.scratch_path(spark, "pred")
    df = spark.range(0, 50, numPartitions=4).selectExpr("id", "id % 3 AS p")
    IO.write_predictions(df, path, "classification", "id", "p")
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert sorted(lines) == sorted(["index\tprediction"] + [f"{i}\t{i % 3}" for i in range(50)])
    import glob

    with open(sorted(glob.glob(path.removeprefix("file:") + "/part-00000*"))[0]) as f:
        assert f.read() == "index\tprediction\n"
