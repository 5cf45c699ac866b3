import gzip
import os

import pytest
from pyspark.sql import functions as F

from tablefacts.operators.profile import profile_workspace
from tablefacts.sources import cleanup as C
from tablefacts.sources import grid as G
from tablefacts.session import shared_folder, temporary_folders
from tablefacts.sources.sinks import _commit, land, landed, manifests, sweep, write_frames, write_profile_json
from tablefacts.sources.workspace import list_tables, load_workspace

MESSY = ''',,,
,,,
Week,Gate,Visitors,Rain %
W1,north,1200,10.5
W1,south,800,20.25
W2,"no, ""rth""",1500,0.5
,,,

W2,south,NA,4.75
'''


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("my workspace")
    (root / "Gate Counts.csv").write_text("\ufeff" + MESSY, encoding="utf-8")
    (root / "Empty Sheet.csv").write_text("ColA,ColB\n,\n,\n")
    (root / "blank.csv").write_text("\n\n")
    (root / "Names.csv").write_text(" a ,A,,x,x,gone\n1,true,2024-01-02,07,1.5,\n2,false,2024-01-05,1e3,n/a,\n")
    (root / "tabs.tsv").write_text("k\tv\na,b\t1\n")
    parts = root / "parts.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("k,v\na,1\nb,2\n")
    (parts / "part-1.csv").write_text("k,v\nc,3\n")
    (root / "notes.docx").write_text("not a table")
    return str(root)


def rows(df, order="_row"):
    return [tuple(r) for r in df.orderBy(order).drop("_row").collect()]


def test_listing(spark, folder):
    with pytest.warns(UserWarning, match=r"left out of .*: notes\.docx"):
        found = list_tables(spark, folder)
    assert sorted(found) == ["Empty Sheet", "Gate Counts", "Names", "blank", "parts", "tabs"]


def test_messy_sheet(spark, folder):
    table = load_workspace(spark, folder, keep_order=True)["Gate Counts"]
    assert table.columns == ["Week", "Gate", "Visitors", "Rain %", "_row"]
    assert dict(table.dtypes)["Visitors"] == "bigint" and dict(table.dtypes)["Rain %"] == "double"
    assert rows(table) == [
        ("W1", "north", 1200, 10.5),
        ("W1", "south", 800, 20.25),
        ("W2", 'no, "rth"', 1500, 0.5),
        ("W2", "south", None, 4.75),
    ]


def test_header_detection_off(spark, folder):
    table = load_workspace(spark, folder, header_detection=False, keep_order=True)["Gate Counts"]
    assert table.columns[:-1] == ["Column_1", "Column_2", "Column_3", "Column_4"]
    assert rows(table)[0] == ("Week", "Gate", "Visitors", "Rain %")


def test_names_types_and_empty_columns(spark, folder):
    table = load_workspace(spark, folder, keep_order=True)["Names"]
    assert table.dtypes[:-1] == [
        ("a", "bigint"), ("A_2", "boolean"), ("Column_3", "string"), ("x", "double"), ("x.1", "double"),
    ]
    assert rows(table) == [(1, True, "2024-01-02", 7.0, 1.5), (2, False, "2024-01-05", 1000.0, None)]


def test_other_text_tables(spark, folder):
    tables = load_workspace(spark, folder, keep_order=True)
    assert rows(tables["tabs"]) == [("a,b", 1)]
    assert sorted(rows(tables["parts"])) == [("a", 1), ("b", 2), ("c", 3)]
    assert C.is_empty_table(tables["Empty Sheet"]) and C.is_empty_table(tables["blank"])


def test_gate(spark, folder):
    tables = load_workspace(spark, folder)
    gate = C.validate_workspace(profile_workspace(tables)).first()
    assert (gate["tables"], gate["columns"], gate["usable"]) == (4, 13, True)
    only = C.validate_workspace(profile_workspace({"e": tables["blank"]})).first()
    assert (only["usable"], only["reason"]) == (False, "no table has rows")


def test_header_of_many_sources_in_one_job(spark, folder):
    grid = G.load_grid(spark, folder + "/*.csv")
    got = {r["source"]: (r["header_row"], r["score"]) for r in G.detect_header(G.head_rows(grid)).collect()}
    assert got["Gate Counts"] == (2, 4) and got["Names"] == (0, 4)
    assert "blank" not in got  # blank lines are no rows


def test_header_scores(spark):
    cells = [
        [None, " ", ""], ["a", "a", "b"], ["a", "1", "-2.5"], ["1d", "NaN", "1e3"], ["x", " x", "y"],
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cells array<string>")
    got = [r[0] for r in df.orderBy("i").select(G.header_score(F.col("cells"))).collect()]
    assert got == [0, 2, -1, 1, 3]


def test_first_best_header_wins(spark):
    grid = spark.createDataFrame(
        [("s", i, c) for i, c in enumerate([["1", "2"], ["a", "b"], ["c", "d"]])] + [("n", 0, ["1", "2"]), ("n", 1, ["3", "4"])],
        "source string, row_idx bigint, cells array<string>",
    )
    got = {r["source"]: (r["header_row"], r["header"]) for r in G.detect_header(grid).collect()}
    assert got == {"s": (1, ["a", "b"]), "n": (0, ["1", "2"])}


def test_cells_of_lines(spark, tmp_path):
    lines = ["a", "a,b", ",", 'a,"b,c",d', '"x ""y"" z",', ',"",', 'a"b,c', '"a"b,c', ",,x"]
    path = tmp_path / "lines.csv"
    path.write_text("\n".join(lines) + "\n")
    got = [r["cells"] for r in G.load_grid(spark, str(path)).orderBy("row_idx").collect()]
    assert got == [
        ["a", None, None], ["a", "b", None], [None] * 3, ["a", "b,c", "d"], ['x "y" z', None, None], [None] * 3,
        ['a"b', "c", None], ['"a"b', "c", None], [None, None, "x"],
    ]


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n1,"a\nb, ""c"""\n2,d\n')
    table = load_workspace(spark, str(tmp_path), multiline=["t"], keep_order=True)["t"]
    assert rows(table) == [(1, 'a\nb, "c"'), (2, "d")]


def test_every_file_has_its_title_and_header(spark, tmp_path):
    """Also files without a header, empty ones, and data that repeats a title or a header."""
    parts = tmp_path / "t.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("")
    (parts / "part-1.csv").write_text("Report A\nid,name\n1,x\n2,y\n")
    (parts / "part-2.csv").write_text("Report B,spring\n\nid,name\n3,z\nid,name\n")
    (parts / "part-3.csv").write_text("4,w\n5,v\n")
    table = load_workspace(spark, str(tmp_path), keep_order=True)["t"]
    assert rows(table) == [("1", "x"), ("2", "y"), ("3", "z"), ("id", "name"), ("4", "w"), ("5", "v")]


def test_compressed_and_unnamed_folders(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write("k,v\nx,12345678901234567890\n")
    folder = tmp_path / "v1.2 data"
    folder.mkdir()
    (folder / "part-0.csv").write_text("k,v\na,1\n")
    tables = load_workspace(spark, str(tmp_path))
    assert sorted(tables) == ["a", "v1.2 data"]
    assert tables["a"].first()["v"] == 12345678901234567890
    (folder / "part-1.tsv").write_text("k\tv\n")
    with pytest.raises(ValueError, match="several formats: csv, tsv"):
        list_tables(spark, str(tmp_path))


def test_deeper_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2\n" * 12 + "a,b\n3,4\n")
    assert load_workspace(spark, str(tmp_path), header_scan=13)["t"].columns == ["a", "b"]


def test_a_long_line_is_read_whole(spark, tmp_path):
    path = tmp_path / "long.csv"
    cell = ('word "" and, comma ' * 3000).strip()
    path.write_text("k,v\n" + f'1,"{cell}"\n')
    table = load_workspace(spark, str(tmp_path))["long"]
    assert table.first()["v"] == cell.replace('""', '"')


def test_many_splits_keep_row_order(spark, tmp_path):
    """A file read in many pieces: the header is found once and the order is kept."""
    n = 20000
    body = "".join(f"{i},name {i}\n" for i in range(n))
    (tmp_path / "big.csv").write_text(",\ntitle,\nid,name\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        table = load_workspace(spark, str(tmp_path), keep_order=True)["big"]
        assert G.load_grid(spark, str(tmp_path / "big.csv")).select("block").distinct().count() > 3
        got = [r["id"] for r in table.orderBy("_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opening)
    assert got == list(range(n)) and table.columns == ["id", "name", "_row"]


def test_missing_texts(spark):
    df = spark.createDataFrame([(v,) for v in [*C.MISSING_TEXTS, " ", "none", "x"]], "s string")
    assert [r[0] for r in C.normalize_missing(df, text_source=True).collect() if r[0] is not None] == [" ", "none", "x"]
    assert C.normalize_missing(df).where("s is null").count() == 0


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, None, None)], "a int, b string, `c.d` double")
    assert C.drop_empty_rows(df).count() == 1
    assert C.drop_empty_columns(df).columns == ["a", "c.d"]
    assert not C.is_empty_table(df) and C.is_empty_table(df.where("a is null"))


def test_sinks(spark, harvest, tmp_path):
    write_frames({"harvest": harvest, "more": harvest}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "harvest")).count() == 10
    write_profile_json(profile_workspace({"Harvest": harvest}), str(tmp_path / "json"))
    doc = spark.read.json(str(tmp_path / "json")).first()
    assert doc["columns"]["Crates"]["sum"] == 25000


def test_landing(spark, folder, tmp_path):
    tables = load_workspace(spark, folder)
    some = {n: tables[n] for n in ("Gate Counts", "Names")}
    landed = land(spark, some, str(tmp_path / "landed"))
    for n in some:
        assert landed[n].dtypes == some[n].dtypes
        assert sorted(landed[n].collect(), key=str) == sorted(some[n].collect(), key=str)


def test_a_landing_that_dies_leaves_the_one_before(spark, harvest, visits, tmp_path):
    folder = str(tmp_path / "landed")
    land(spark, {"t": harvest, "v": visits}, folder)
    broken = visits.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        land(spark, {"t": harvest.limit(1), "v": broken}, folder)
    tables = landed(spark, folder)
    assert sorted(tables) == ["t", "v"] and tables["t"].count() == 10
    assert sweep(spark, folder) == []
    assert len(sweep(spark, folder, grace=-60)) == 1
    assert tables["t"].count() == 10 and len(manifests(spark, folder)) == 1


def test_landings_switch_and_old_ones_go(spark, harvest, visits, tmp_path):
    folder = str(tmp_path / "landed")
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "notes.txt").write_text("mine")
    with pytest.raises(FileNotFoundError):
        landed(spark, folder)
    old = land(spark, {"t": harvest}, folder)["t"]
    new = land(spark, {"t": harvest.where("Crates > 2500"), "v": visits}, folder)
    assert old.count() == 10 and new["t"].count() == 4
    assert landed(spark, folder, 1)["t"].count() == 10
    with pytest.raises(FileExistsError):
        _commit(spark, folder, {"number": 2, "folder": "x", "tables": []})
    assert len(sweep(spark, folder)) == 1 and [m["number"] for m in manifests(spark, folder)] == [2]
    assert land(spark, {"t": harvest.where("Crates > 5000")}, folder)["t"].count() == 1
    assert sweep(spark, folder, keep=2) == [] and (tmp_path / "landed" / "notes.txt").exists()


def test_parsed_text_goes_with_its_scope(spark, folder, tmp_path, monkeypatch):
    handed = []
    monkeypatch.setattr(G, "shared_folder", lambda session: handed.append(shared_folder(session)) or handed[-1])
    with temporary_folders(spark):
        tables = load_workspace(spark, folder)
        rows = tables["Names"].count()
        assert handed and all(map(os.path.exists, handed))
        kept = land(spark, {"Names": tables["Names"]}, str(tmp_path / "landed"))
    assert not any(map(os.path.exists, handed))
    assert kept["Names"].count() == rows


def test_typed_sources_keep_their_order(spark, harvest, tmp_path):
    harvest.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    harvest.write.orc(str(tmp_path / "o.orc"))
    tables = load_workspace(spark, str(tmp_path), keep_order=True)
    got = [r["Crates"] for r in tables["t"].orderBy("_row").collect()]
    assert got == [r["Crates"] for r in harvest.collect()]
    assert "_row" not in load_workspace(spark, str(tmp_path))["t"].columns
    assert tables["o"].count() == 10


def test_two_tables_of_one_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\na,1\n")
    (tmp_path / "a.tsv").write_text("k\tv\na\t1\n")
    with pytest.raises(ValueError, match="two tables are named a"):
        list_tables(spark, str(tmp_path))
