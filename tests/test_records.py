"""Records with line breaks in quoted cells, read in splits, against Spark's unsplit reader."""

import random

import pytest

from tablefacts import load_workspace
from tablefacts.sources import grid as G
from tablefacts.sources import records as R

WIDTH = 4


def cell(rng, breaks):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("abc \té") for _ in range(rng.randint(0, 6)))
    if kind < 0.4:
        return rng.choice(['a"b', 'x"', 'a""b'])
    parts = ["x", "y,", '""', " ", "日本", *breaks]
    return '"' + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + '"'


def text(rng, lines, end, breaks):
    rows = [",".join(cell(rng, breaks) for _ in range(rng.randint(1, WIDTH))) for _ in range(lines)]
    return "".join(r + end * rng.choice([1, 1, 1, 2]) for r in rows)


@pytest.fixture
def settings(spark):
    kept = {}

    def put(**values):
        for key, value in values.items():
            name = f"spark.sql.{key.replace('_', '.')}"
            kept.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, value)

    yield put
    for name, value in kept.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("end, breaks", [("\n", ["\n", "\n\n"]), ("\r\n", ["\r\n"])])
def test_splits_equal_the_unsplit_reader(spark, tmp_path, settings, monkeypatch, end, breaks):
    rng = random.Random(len(end))
    folder = tmp_path / "t.csv"
    folder.mkdir()
    files = {"a": text(rng, 150, end, breaks), "b": text(rng, 60, end, breaks) + 'last,"never closed' + end + "end", "c": "", "d": "one"}
    # a cell that is longer than some splits, and splits without a record of their own
    files["e"] = f'1,"{"long line, " * 200}{end}{"x" * 5000}{end}"{end}2,y{end}' * 3
    for name, content in files.items():
        (folder / f"{name}.csv").write_bytes(content.encode())
    whole = spark.read.options(sep=",", quote='"', escape='"', multiLine=True).schema(G._cell_schema(WIDTH)).csv(str(folder))
    expected = {}
    for row in whole.select("_metadata.file_name", "*").collect():
        expected.setdefault(row[0], []).append(tuple(row)[1:])
    settings(files_maxPartitionBytes="1200", files_openCostInBytes="1", execution_arrow_maxRecordsPerBatch="3")
    monkeypatch.setattr(R, "CHUNK_LENGTH", 120)
    chunks = G.kept_grid(R.load_chunks(spark, str(folder)))
    settings(files_maxPartitionBytes="128m", files_openCostInBytes="4m")
    assert chunks.select("file", "block").distinct().count() > 12
    for most in (R.MOST_SPLITS, 0):
        monkeypatch.setattr(R, "MOST_SPLITS", most)
        records = R.cut_records(chunks).selectExpr("file", "block", "place", "record")
        cells = G.F.from_csv("record", G._cell_schema(WIDTH), G._options(",", multiline=True)).alias("x")
        got = {}
        for row in records.select("file", "block", "place", cells).orderBy("file", "block", "place").collect():
            got.setdefault(row["file"].rsplit("/", 1)[1], []).append(tuple(row["x"]))
        for name, rows in expected.items():
            assert len(got.get(name, [])) == len(rows), name
            assert next(((n, x, y) for n, (x, y) in enumerate(zip(got[name], rows)) if x != y), None) is None
        assert got == expected


def test_quoted_tables_of_many_splits(spark, tmp_path, settings):
    rng = random.Random(5)
    notes = ["".join(rng.choice(["a", "b,", "\n", '""', " c"]) for _ in range(rng.randint(0, 40))) + "." for _ in range(2000)]
    (tmp_path / "t.csv").write_text("id,note\n" + "".join(f'{k},"{n}"\n' for k, n in enumerate(notes)))
    settings(files_maxPartitionBytes="20000", files_openCostInBytes="1")
    table = load_workspace(spark, str(tmp_path), multiline=["t"], keep_order=True)["t"]
    settings(files_maxPartitionBytes="128m", files_openCostInBytes="4m")
    rows = table.orderBy("_row").collect()
    assert [(r["id"], r["note"]) for r in rows] == [(k, n.replace('""', '"')) for k, n in enumerate(notes)]
    assert [r["id"] for r in rows] == list(range(2000))


def test_states_are_composed_from_all_splits_before(spark):
    rng = random.Random(2)
    maps, expected = [], []
    for file in ("a", "b"):  # each has splits of all four kinds
        inside = False
        for block in range(60):
            ends = rng.choice([(False, True), (True, False), (True, True), (False, False)])
            expected.append((file, block, inside))
            maps.append((file, block, *ends))
            inside = ends[inside]
    frame = spark.createDataFrame(rng.sample(maps, len(maps)), "file string, block bigint, ends_out boolean, ends_in boolean")
    got = R.start_states(frame).select("file", "block", "inside").collect()
    assert sorted(map(tuple, got)) == expected


def test_many_cells_and_doubled_quotes_need_no_stack(spark, tmp_path):
    doubled = '""' * 200_000
    wide = ",".join(["x"] * 100_000 + [f'"{doubled}"'])
    assert R.Cutter(",").cut(f"{wide}\na\n") == [wide, "a"]
    (tmp_path / "t.csv").write_text(f'"{doubled}",b\n')
    grid = G.load_grid(spark, str(tmp_path / "t.csv"), multiline=True).collect()
    assert [r["cells"] for r in grid] == [['"' * 200_000, "b"]]


def test_python_holds_one_chunk_at_a_time(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    parts = ["\n", '""', ",", "é", "日本", "𝄞", " word"]
    notes = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = [f'{k},"{n}"' if rng.random() < 0.6 else f"{k},plain" for k, n in enumerate(notes)]
    content = "id,note\n" + "\n".join(rows) + "\n"
    (tmp_path / "t.csv").write_text(content, newline="")
    monkeypatch.setattr(R, "CHUNK_LENGTH", 500)
    chunks = G.kept_grid(R.load_chunks(spark, str(tmp_path / "t.csv")))
    lengths = [r[0] for r in chunks.select(G.F.octet_length("text")).collect()]
    longest = max(len(line.encode()) + 1 for line in content.split("\n"))
    # all lines come in one batch, yet no chunk is as long as that
    assert max(lengths) <= 500 + longest and sum(lengths) == len(content.encode())
    records = R.cut_records(chunks)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan  # batches of many chunks would go to Python
    got = [r["record"] for r in records.orderBy("file", "block", "place").collect()]
    assert got == R.Cutter(",").cut(content)
