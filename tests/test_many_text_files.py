"""Text files that share their jobs must load as each does alone."""

import re

import pytest

from tabwarden.plans.package import load_package
from tabwarden.sources import text_tables
from tabwarden.sources.text_tables import TextFile, header_names, load_many, read_text_rows


@pytest.mark.parametrize("line", ["a,b,c", "a,,A,b", '"x, y",z', '"say ""hi""",b', "a,A,b,,", "only", " a ,b", "é,ß"])
def test_header_names_are_those_of_the_reader(spark, tmp_path, line):
    (tmp_path / "t.csv").write_text(f"\n{line}\n1,2\n", encoding="utf-8")
    want = read_text_rows(spark, str(tmp_path / "t.csv")).columns[:-1]
    assert list(header_names(line, ",")) == want


def test_open_header():
    assert header_names('a,"b', ",") is None


CONTENTS = {
    "ints.csv": "a,b\n1,2\n3,4\n", "texts.csv": "a,b\nx,2\nNA,\n", "wide.csv": "a,b,c,d,e\n1,2,3,4,5\n1,2,3,4,5,6\n7\n",
    "three.csv": "p,q,r\n1.5,true,007\n2,false,8\n", "long.csv": "a,b\n1,2,3\n4,5\n6,7,8,9\n", "four.csv": "a,b,c,d\n1,2,3,4\n",
    "none.csv": "a,b,c\n", "quoted.csv": 'a,b,c\n"x,y","say ""hi""",3\n"1",2,"3,4,5,6"\n', "latin.csv": "name,b\ncaf\xe9 \x80,1\n".encode("latin-1"),
    "lines.csv": 'a,b\n"two\nlines",2\n', "spaces in+name%20.csv": "k,v\n 1 ,Inf\n",
}


def described(df):
    return df.dtypes, sorted(map(tuple, df.collect()), key=repr)


def test_many_files_load_as_each_alone(spark, tmp_path):
    folder = tmp_path / "pkg"
    folder.mkdir()
    for name, text in CONTENTS.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    pkg = load_package(spark, str(folder), "d")
    got = {t.file: t for t in pkg.tables}
    assert set(got) == set(CONTENTS)
    for name in CONTENTS:
        encoding, multi = ("windows-1252" if name == "latin.csv" else "UTF-8"), name == "lines.csv"
        alone, too_long = text_tables.load_delimited(spark, str(folder / name), ",", encoding, multi)
        assert described(got[name].df) == described(alone.df), name
        said = [m.message for m in pkg.issues.filter("message like '%more fields%'").collect() if m.message.startswith(name)]
        assert [int(re.search(r": (\d+) lines", m)[1]) for m in said] == ([too_long] if too_long else [])


def test_a_thousand_files_take_a_few_jobs(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    files = []
    for i in range(1000):
        n = 2 + i % 3
        (folder / f"t{i}.csv").write_text(",".join(f"f{i}_{k}" for k in range(n)) + "\n" + ",".join([str(i), f"v{i}", "x", "y"][:n]) + "\n")
        files.append(TextFile(str(folder / f"t{i}.csv"), ",", "UTF-8", False, tuple(f"f{i}_{k}" for k in range(n))))
    spark.sparkContext.setJobGroup("many", "many files")
    tables, failed = load_many(spark, files)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many")) < 30
    assert len(tables) == 1000 and not failed
    df, too_long = tables[str(folder / "t7.csv")]
    assert df.dtypes == [("f7_0", "bigint"), ("f7_1", "string"), ("f7_2", "string")] and too_long == 0
    assert [tuple(r) for r in df.collect()] == [(7, "v7", "x")]


def test_a_file_that_is_gone_fails_alone(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"t{i}.csv").write_text(f"a,b\n{i},x\n")
    files = [TextFile(str(tmp_path / f"t{i}.csv"), ",", "UTF-8", False, ("a", "b")) for i in range(6)]
    tables, failed = load_many(spark, files)
    assert sorted(t[-6:] for t in tables) == [f"t{i}.csv" for i in range(5)] and [f.path[-6:] for f, _ in failed] == ["t5.csv"]
