import os

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from paneltide.sources import files, html

SCHEMA = StructType([StructField("team", StringType()), StructField("wins", IntegerType()),
                     StructField("losses", IntegerType())])


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_csv_quarantine_and_provenance(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "wl")
    _write(d, "2001-2002.csv", "team,wins,losses\nAAA,10,72\nBBB,x,41\n")
    _write(d, "2002-2003.csv", "team,wins,losses\nAAA,20,62\n")
    _write(d, "notes.txt", "ignored")
    good, bad = files.with_quarantine(spark, d, SCHEMA)
    assert good.count() == 2 and bad.count() == 1
    df = files.read_csv(spark, d, SCHEMA).withColumn("season", files.file_season())
    assert sorted(r.season for r in df.collect()) == ["2001-2002", "2001-2002", "2002-2003"]
    assert files.header_columns(spark, os.path.join(d, "2002-2003.csv")) == ["team", "wins", "losses"]


def test_csv_columns_are_read_by_name(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "drift")
    _write(d, "2001-2002.csv", "wins,losses,team\n10,20,AAA\n")
    _write(d, "2002-2003.csv", "Tm,extra,L,W\nBBB,z,2,1\nTm,extra,L,W\nCCC,z,4,3\n")
    got = {(r.team, r.wins, r.losses) for r in files.read_csv(
        spark, d, SCHEMA, aliases={"Tm": "team", "W": "wins", "L": "losses"}).collect()}
    assert got == {("AAA", 10, 20), ("BBB", 1, 2), ("CCC", 3, 4)}
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, d, SCHEMA)


def test_empty_directory_raises(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "empty")
    _write(d, "readme.txt", "nothing")
    df = files.read_csv(spark, d, SCHEMA)
    with pytest.raises(RuntimeError):
        files.require_nonempty(df, d)


def test_html_rows_tables_and_blocks(spark):
    page = ("<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body>"
            "<p>one<br>two<p>three</p><ul><li>a <b>b</b></li></ul>"
            "<table><tr><th>Team</th><th>W</th><th>L</th></tr><tr><td>Boston*</td><td>60</td><td>22</td></tr></table>"
            "<table><tr><th>Team</th><th>Pts</th></tr><tr><td>X</td><td>1</td></tr></table>"
            "<table><tr><th>Team</th><th>W</th><th>L</th></tr><tr><td>Boston*</td><td>61</td><td>21</td></tr></table>"
            "</body></html>")
    rows = html.parse_page(page)
    texts = [r[2] for r in rows if r[1] != "tr"]
    assert texts == ["T", "one two", "three", "a b"]
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    out = html.html_rows(pages)
    sel = html.select_tables(out, ["W", "L"]).where("row_no > 0").orderBy("table_no").collect()
    assert [r.cells for r in sel] == [["Boston*", "60", "22"], ["Boston*", "61", "21"]]
    # first table wins for a duplicated name (keep="first" on (table, row))
    from pyspark.sql import functions as F
    from paneltide.operators.panel import dedup_first
    t = html.select_tables(out, ["W", "L"]).where("row_no > 0") \
        .select(F.trim(F.replace(F.col("cells")[0], F.lit("*"), F.lit(""))).alias("name"),
                "table_no", "row_no", F.col("cells")[1].alias("w"))
    assert [r.w for r in dedup_first(t, "name", ["table_no", "row_no"]).collect()] == ["60"]


def test_html_spans_and_nested_tables():
    page = ("<table><tr><th rowspan=2>Team</th><th colspan=2>Record</th></tr><tr><th>W</th><th>L</th></tr>"
            "<tr><td>A</td><td>1</td><td>2</td></tr></table>"
            "<table><tr><td>outer</td><td><table><tr><td>inner</td></tr><tr><td>inner 2</td></tr></table></td></tr>"
            "<tr><td>after</td><td>x</td></tr></table>")
    rows = [(r[3], r[4], r[5]) for r in html.parse_page(page)]
    assert rows[:3] == [(0, 0, ["Team", "Record", "Record"]), (0, 1, ["Team", "W", "L"]), (0, 2, ["A", "1", "2"])]
    assert (2, 0, ["inner"]) in rows and (2, 1, ["inner 2"]) in rows
    assert (1, 0, ["outer", ""]) in rows and (1, 1, ["after", "x"]) in rows
    assert html.parse_page("<table><tr><td colspan=x rowspan=0>a</table>")[0][5] == ["a"]


def test_first_table(spark):
    page = ("<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"
            "<table><tr><th>B</th></tr><tr><td>2</td></tr></table>")
    rows = html.html_rows(spark.createDataFrame([(7, page)], "page_id long, html string"))
    assert [r.cells for r in html.first_table(rows).orderBy("row_no").collect()] == [["A"], ["1"]]


def test_file_season_ignores_ids_in_the_path(spark):
    paths = ["file:/ckpt/a36ae7e4-4916-9943-82ec/x/season=1995-1996/part-00000-1234-5678.csv",
             "file:/data/run-1111-2222/WL/2015-2016.csv", "file:/data/run-0000-1111x/other.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.s for r in df.select(files.file_season("p").alias("s")).collect()] == ["1995-1996", "2015-2016", ""]


def test_standings_from_rows(spark):
    page = ("<table><tr><th>Eastern</th><th>W</th><th>L</th></tr>"
            "<tr><td>Boston Celtics*</td><td>60</td><td>22</td></tr>"
            "<tr><td>Unknown Club</td><td>10</td><td>72</td></tr></table>"
            "<table><tr><th>Team</th><th>Pts</th></tr><tr><td>Boston Celtics</td><td>9</td></tr></table>"
            "<table><tr><th>Division</th><th>L</th><th>W</th></tr>"
            "<tr><td>Boston Celtics</td><td>21</td><td>61</td></tr>"
            "<tr><td>Miami Heat</td><td>30</td><td>52</td></tr></table>")
    rows = html.html_rows(spark.createDataFrame([(1, page)], "page_id long, html string"))
    d = spark.createDataFrame([("Boston Celtics", "BOS"), ("Miami Heat", "MIA")], "name string, code string")
    out = [(r.team, r.wins, r.losses) for r in html.standings_from_rows(rows, d).collect()]
    assert out == [("BOS", 60, 22), ("MIA", 52, 30)]


def test_write_sorted_by_period(spark, tmpdir_path):
    import glob

    from paneltide.sinks.writers import write_sorted_by_period
    rows = [("2001-2002", t, r) for t, r in (("A", 3), ("B", 1), ("C", 2))] + \
           [("2002-2003", t, r) for t, r in (("A", 2), ("B", 3), ("C", 1))]
    df = spark.createDataFrame(rows, "season string, team string, pred_rank int").repartition(3)
    out = os.path.join(tmpdir_path, "pred")
    write_sorted_by_period(df, out, "season", ["pred_rank"])
    for season, order in (("2001-2002", ["B", "C", "A"]), ("2002-2003", ["C", "A", "B"])):
        files = sorted(glob.glob(os.path.join(out, f"season={season}", "*.csv")))
        lines = [ln.split(",") for f in files for ln in open(f).read().splitlines()[1:]]
        assert [ln[0] for ln in lines] == order


def test_csv_of_any_width_is_read_by_name(spark, tmpdir_path):
    import os
    wide = [f"x{i}" for i in range(150)]
    os.makedirs(f"{tmpdir_path}/in")
    with open(f"{tmpdir_path}/in/a.csv", "w") as f:
        f.write(",".join([*wide, "wins", '"team"']) + "\n" + ",".join(["0"] * 150 + ["7", '"A, B"']) + "\n")
        f.write(",".join([*wide, "wins", "team"]) + "\n" + ",".join(["0"] * 150 + ["8", "C"]) + ",more,fields\n")
    with open(f"{tmpdir_path}/in/b.csv", "w") as f:
        f.write("Tm , W\nwins team,3\nD,x\n")
    schema = spark.createDataFrame([], "team string, wins int").schema
    got = files.read_csv(spark, f"{tmpdir_path}/in", schema, aliases={"Tm": "team", "W": "wins"})
    assert sorted((r.team, r.wins) for r in got.collect()) == [("A, B", 7), ("C", 8), ("D", None), ("wins team", 3)]
    with open(f"{tmpdir_path}/in/c.csv", "w") as f:
        f.write("team,losses\nE,1\n")
    with pytest.raises(ValueError, match="c.csv"):
        files.read_csv(spark, f"{tmpdir_path}/in", schema, aliases={"Tm": "team", "W": "wins"})
