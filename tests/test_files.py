import contextlib
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tallygrid import (
    Cut,
    apply_cuts,
    file_catalogue,
    finish_saves,
    load_cuts,
    save_cut,
    save_cuts,
    save_separate,
    save_single,
    scan_events,
    scan_selected,
    select_files,
    toggle_file,
)
from tallygrid.plans import workloads
from tallygrid.plans.workloads import scratch_dir
from tallygrid.sources.paths import first_overlap

BOX = Cut("box", ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)), "a", "b")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three event files, one of which has no row inside the box, and some files to ignore."""
    root = tmp_path_factory.mktemp("events")
    values = {"run+ 1%": [1.0, 5.0, 50.0], "run.2": [2.0, 3.0], "run_3": [70.0, 80.0]}
    for age, (name, column) in enumerate(values.items()):
        rows = [(v, v, f"{name}-{i}") for i, v in enumerate(column)]
        part = root / f"part-{age}"
        spark.createDataFrame(rows, "a double, b double, tag string").coalesce(1).write.parquet(
            str(part)
        )
        file = next(p for p in part.iterdir() if p.name.endswith(".parquet"))
        target = root / "data" / f"{name}.parquet"
        target.parent.mkdir(exist_ok=True)
        shutil.copy(file, target)
        os.utime(target, (1_700_000_000 + age, 1_700_000_000 + age))
    (root / "data" / "notes.txt").write_text("no events")
    (root / "data" / "old.PARQUET").write_text("no events")
    below = root / "data" / "below"
    below.mkdir()
    shutil.copy(root / "data" / "run_3.parquet", below / "deep.parquet")
    return str(root / "data")


def event_paths(folder):
    return [f"{folder}/{name}.parquet" for name in ("run+ 1%", "run.2", "run_3")]


def tags(df):
    return sorted(r["tag"] for r in df.collect())


def test_catalogue_lists_newest_first(spark, folder):
    rows = file_catalogue(spark, folder).collect()
    assert [r["name"] for r in rows] == ["run_3", "run.2", "run+ 1%"]
    assert all(r["length"] > 0 for r in rows)
    plan = file_catalogue(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_selection(spark, folder):
    listed = file_catalogue(spark, folder)
    assert select_files(listed).count() == 3
    assert select_files(listed.union(listed)).count() == 3
    assert [r["name"] for r in select_files(listed, include=["run.2"]).collect()] == ["run.2"]
    assert select_files(listed, exclude=["run+ 1%", "run.2"]).count() == 1
    assert select_files(listed, include=[]).count() == 0
    assert toggle_file(["a", "b"], "a") == ["b"]
    assert toggle_file(["b"], "a") == ["b", "a"]


def test_scan_many_files(spark, folder):
    paths = event_paths(folder)
    assert scan_events(spark, paths).count() == 7
    assert scan_events(spark, paths + paths[:1]).count() == 7
    with_source = scan_events(spark, paths, "source")
    found = {r["source"]: r["count"] for r in with_source.groupBy("source").count().collect()}
    assert found == {"run+ 1%.parquet": 3, "run.2.parquet": 2, "run_3.parquet": 2}
    with pytest.raises(ValueError):
        scan_events(spark, [])
    with pytest.raises(ValueError):
        scan_events(spark, paths, "tag")


@pytest.mark.parametrize("compact", [False, True])
def test_save_single(spark, folder, tmp_path, compact):
    paths = event_paths(folder)
    save_single(spark, paths, [BOX], str(tmp_path / "out"), compact=compact)
    saved = spark.read.parquet(str(tmp_path / "out"))
    want = apply_cuts(scan_events(spark, paths), [BOX])
    assert saved.columns == want.columns
    assert tags(saved) == tags(want) == ["run+ 1%-0", "run+ 1%-1", "run.2-0", "run.2-1"]


@pytest.mark.parametrize("compact", [False, True])
def test_save_separate(spark, folder, tmp_path, compact):
    out = str(tmp_path / "out")
    manifest = save_separate(spark, event_paths(folder), [BOX], out, compact=compact)
    assert {tuple(r) for r in manifest.collect()} == {
        ("run+ 1%.parquet", "run+ 1%_filtered", 2),
        ("run.2.parquet", "run.2_filtered", 2),
        ("run_3.parquet", "run_3_filtered", 0),
    }
    one = spark.read.parquet(f"{out}/out_name=run.2_filtered")
    assert one.columns == ["a", "b", "tag"]
    assert tags(one) == ["run.2-0", "run.2-1"]


def test_save_modes(spark, folder, tmp_path):
    paths = event_paths(folder)[1:]
    assert save_cuts(spark, paths, [BOX], str(tmp_path / "1"), mode="single") is None
    manifest = save_cuts(spark, paths, [BOX], str(tmp_path / "2"), suffix="box")
    assert {r["out_name"] for r in manifest.collect()} == {"run.2_box", "run_3_box"}
    with pytest.raises(ValueError, match="mode"):
        save_cuts(spark, paths, [BOX], str(tmp_path / "3"), mode="both")


def test_save_nothing(spark, folder, tmp_path):
    paths = event_paths(folder)[2:]
    manifest = save_separate(spark, paths, [BOX], str(tmp_path / "out"))
    assert [tuple(r) for r in manifest.collect()] == [("run_3.parquet", "run_3_filtered", 0)]


def test_outputs_must_not_clash(spark, folder, tmp_path):
    other = tmp_path / "run_3.parquet"
    shutil.copy(event_paths(folder)[2], other)
    with pytest.raises(ValueError, match="run_3_filtered"):
        save_separate(spark, [*event_paths(folder), str(other)], [BOX], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_cut_round_trip(spark, tmp_path):
    path = save_cut(spark, BOX, str(tmp_path))
    assert os.path.basename(path) == "b_a_cut.json"
    back = load_cuts(spark, [path])[0]
    assert (back.vertices, back.x_column, back.y_column) == (BOX.vertices, "a", "b")
    text = next(p for p in (tmp_path / "b_a_cut.json").iterdir() if p.suffix == ".json").read_text()
    assert json.loads(text) == {
        "vertices": [list(v) for v in BOX.vertices],
        "selected_vertex_index": None,
        "selected_x_column": "a",
        "selected_y_column": "b",
    }
    with pytest.raises(ValueError, match="both columns"):
        save_cut(spark, Cut("c", BOX.vertices, "a", None), str(tmp_path))


def test_cut_files_of_other_origin(spark, tmp_path):
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps({"vertices": [[0, 1], [2.5, 3], [4, 5]]}, indent=2))
    cut = load_cuts(spark, [str(pretty)])[0]
    assert (cut.cut_id, cut.usable, len(cut.vertices)) == ("cut_1", False, 3)
    for name, content in {"none": "{}", "odd": '{"vertices": [[1, 2, 3]]}'}.items():
        bad = tmp_path / f"{name}.json"
        bad.write_text(content)
        with pytest.raises(ValueError, match="vertices"):
            load_cuts(spark, [str(bad)])


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark) != scratch_dir(spark)


@pytest.fixture
def own_folder(spark, folder, tmp_path):
    """A folder of its own with two inputs and a foreign file."""
    target = tmp_path / "runs"
    target.mkdir()
    for name in ("run.2", "run_3"):
        shutil.copy(f"{folder}/{name}.parquet", target / f"{name}.parquet")
    (target / "notes.txt").write_text("mine")
    return target


def content(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file() and p.suffix in (".txt", ".parquet")}


def test_a_save_never_replaces_what_it_reads(spark, own_folder):
    before = content(own_folder)
    files = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")]
    for paths in (files, f"{own_folder}/*.parquet"):
        for output in (str(own_folder), files[0], f"{files[0]}/below"):
            with pytest.raises(ValueError, match="overlap"):
                save_single(spark, paths, [BOX], output, replace=True)
    (own_folder / "notes.txt").rename(own_folder.parent / "notes.txt")
    for save in (save_single, save_separate):
        with pytest.raises(ValueError, match="overlap"):
            save(spark, str(own_folder), [BOX], f"{own_folder}/out", replace=True)
    (own_folder.parent / "notes.txt").rename(own_folder / "notes.txt")
    assert content(own_folder) == before


def test_saves_beside_the_inputs_and_with_two_suffixes(spark, own_folder):
    before = content(own_folder)
    files = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")]
    save_separate(spark, files, [BOX], str(own_folder), suffix="one")
    second = save_separate(spark, files[:1], [BOX], str(own_folder), suffix="two")
    assert [tuple(r) for r in second.collect()] == [("run.2.parquet", "run.2_two", 2)]
    assert content(own_folder) == before
    assert {p.name for p in own_folder.glob("out_name=*")} == {"out_name=run.2_one", "out_name=run.2_two"}
    assert not list(own_folder.glob("_new-*"))


def test_an_existing_output_stays_unless_replaced(spark, own_folder, tmp_path):
    files = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")]
    far = Cut("far", ((60.0, 60.0), (90.0, 60.0), (90.0, 90.0), (60.0, 90.0)), "a", "b")
    out = str(tmp_path / "out")
    save_separate(spark, files, [BOX], out)
    with pytest.raises(ValueError, match="run.2_filtered"):
        save_separate(spark, files, [far], out)
    manifest = save_separate(spark, files, [far], out, replace=True)
    assert {tuple(r)[1:] for r in manifest.collect()} == {("run.2_filtered", 0), ("run_3_filtered", 2)}
    assert [p.name for p in (tmp_path / "out").glob("out_name=*")] == ["out_name=run_3_filtered"]
    single = str(tmp_path / "single")
    save_single(spark, files, [BOX], single)
    with pytest.raises(ValueError, match="exists"):
        save_single(spark, files, [far], single)
    assert spark.read.parquet(single).count() == 2
    save_single(spark, files, [far], single, replace=True)
    assert spark.read.parquet(single).count() == 2 and sorted(tags(spark.read.parquet(single)))[0].startswith("run_3")


def test_a_failed_job_changes_no_output(spark, own_folder, tmp_path):
    good = str(own_folder / "run.2.parquet")
    for save, out in ((save_single, tmp_path / "s"), (save_separate, tmp_path / "m")):
        save(spark, good, [BOX], str(out))
        before = sorted(p.name for p in out.rglob("*"))
        broken = own_folder / "broken"
        shutil.copytree(own_folder, broken, ignore=lambda d, names: [n for n in names if n != "run.2.parquet"], dirs_exist_ok=True)
        data = bytearray((broken / "run.2.parquet").read_bytes())
        data[4:40] = b"\xff" * 36
        (broken / "run.2.parquet").write_bytes(bytes(data))
        with pytest.raises(Exception):
            save(spark, str(broken / "run.2.parquet"), [BOX], str(out), replace=True)
        assert sorted(p.name for p in out.rglob("*")) == before
        assert not list(tmp_path.glob("*.new-*")) and not list(out.glob("_new-*"))


def test_catalogue_leaves_out_value_folders(spark, own_folder):
    files = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")]
    save_separate(spark, files, [BOX], str(own_folder))
    assert sorted(r["name"] for r in file_catalogue(spark, str(own_folder)).collect()) == ["run.2", "run_3"]
    assert scan_selected(file_catalogue(spark, str(own_folder))).count() == 4


def test_a_cut_replaces_nothing_but_a_cut(spark, tmp_path):
    save_cut(spark, BOX, str(tmp_path), "c.json")
    with pytest.raises(ValueError, match="exists"):
        save_cut(spark, BOX, str(tmp_path), "c.json")
    save_cut(spark, BOX, str(tmp_path), "c.json", replace=True)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "rows.json").write_text("{}\n{}")
    with pytest.raises(ValueError):
        save_cut(spark, BOX, str(tmp_path), "data", replace=True)
    assert (tmp_path / "data" / "rows.json").exists()


def test_cuts_come_in_the_order_of_the_paths(spark, tmp_path):
    other = Cut("o", ((0.0, 0.0), (1.0, 0.0), (0.0, 2.0)), "b", "a")
    paths = [save_cut(spark, cut, str(tmp_path), f"n {i}.json") for i, cut in enumerate((BOX, other))]
    back = load_cuts(spark, [paths[1], paths[0], paths[1]])
    assert [c.vertices for c in back] == [other.vertices, BOX.vertices, other.vertices]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert "tallygrid-" in scratch_dir(Session(spark_master="local[4]"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(Session(spark_master=master))


# -- replacing with recovery -----------------------------------------------------------


class Died(Exception):
    pass


def dying_after(monkeypatch, moves):
    """The file system dies at the move after so many."""
    from tallygrid.sources import commit
    from tallygrid.sources.paths import Folder

    done, move = [], Folder.move_to
    monkeypatch.setattr(commit, "each", lambda work, items: [work(item) for item in items])

    def move_to(self, name):
        if len(done) == moves:
            raise Died
        done.append(name)
        move(self, name)

    monkeypatch.setattr(Folder, "move_to", move_to)


FAR = Cut("far", ((60.0, 60.0), (90.0, 60.0), (90.0, 90.0), (60.0, 90.0)), "a", "b")


@pytest.mark.parametrize("moves", [0, 1])
def test_single_save_that_died_is_finished(spark, own_folder, tmp_path, monkeypatch, moves):
    files, out = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")], str(tmp_path / "out")
    save_single(spark, files, [BOX], out)
    with monkeypatch.context() as patched:
        dying_after(patched, moves)
        with pytest.raises(Died):
            save_single(spark, files, [FAR], out, replace=True)
    assert finish_saves(spark, str(tmp_path)) == 1
    assert sorted(tags(spark.read.parquet(out)))[0].startswith("run_3")
    assert finish_saves(spark, str(tmp_path)) == 0 and not list(tmp_path.glob("*.new-*"))


@pytest.mark.parametrize("moves", range(4))
def test_separate_save_that_died_is_finished_by_the_next(spark, own_folder, tmp_path, monkeypatch, moves):
    files, out = [str(own_folder / f"{n}.parquet") for n in ("run.2", "run_3")], tmp_path / "out"
    save_separate(spark, files, [Cut("all", ((-1e3, -1e3), (1e3, -1e3), (1e3, 1e3), (-1e3, 1e3)), "a", "b")], str(out))
    before = spark.read.parquet(str(out)).count()
    with monkeypatch.context() as patched:
        dying_after(patched, moves)
        # one output is replaced, the other has no rows now and goes
        with pytest.raises(Died) if moves < 3 else contextlib.nullcontext():
            save_separate(spark, files, [FAR], str(out), replace=True)
    save_separate(spark, files[:1], [BOX], str(out), suffix="other")
    assert before > 2 and sorted(p.name for p in out.glob("out_name=*")) == ["out_name=run.2_other", "out_name=run_3_filtered"]
    assert spark.read.parquet(str(out / "out_name=run_3_filtered")).count() == 2
    assert not list(out.glob("_new-*")) and not list(out.glob("_replace-*"))


def test_foreign_folders_are_not_replaced(spark, own_folder, tmp_path):
    file = str(own_folder / "run.2.parquet")
    for name in ("mine", "out/out_name=run.2_filtered"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "diary.txt").write_text("mine")
    for save, out in ((save_single, "mine"), (save_separate, "out")):
        with pytest.raises(ValueError, match="not written by a save"):
            save(spark, file, [BOX], str(tmp_path / out), replace=True)
    assert len(list(tmp_path.rglob("diary.txt"))) == 2 and not list(tmp_path.rglob("*.parquet"))[2:]


def test_overlaps_of_very_many_names():
    inputs = [f"file:/data/in/run_{i}.parquet" for i in range(100_000)]
    outputs = [f"file:/data/out/out_name=run_{i}" for i in range(100_000)]
    started = time.monotonic()
    assert first_overlap(outputs, inputs) is None
    assert first_overlap([*outputs, "file:/data/in"], inputs) == ("file:/data/in", "file:/data/in/run_0.parquet")
    assert first_overlap([*outputs, "file:/data/in/run_7.parquet/x"], inputs)[1] == "file:/data/in/run_7.parquet"
    assert first_overlap(["file:/data/in/run_1"], inputs) is None
    assert time.monotonic() - started < 10


def test_saving_many_files_takes_no_task_for_a_whole_kind(spark, tmp_path):
    """Tables of several parts stay several files, and the manifest adds up the parts of a kind."""
    rows = [(i, i % 7, float(i % 50 + 1), 200.0 * (i % 300), 0.05, "ANR"[i % 3]) for i in range(4_000)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    spark.createDataFrame(rows, schema).repartition(4).write.option("maxRecordsPerFile", 250).parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        target, manifest = workloads._save_twice(spark, str(tmp_path))
        names = spark.read.parquet(target).select("out_name").distinct().count()
        found = sorted(map(tuple, workloads.manifest_many(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    assert names > 4 and manifest.count() > 3 and sum(files for _, files in found) == 3
    kept = {kind: spark.read.parquet(target).where(F.col("out_name").endswith(kind)).count() for kind in ("_square", "_triangle")}
    assert sum(n * files for n, files in found) == kept["_triangle"] and kept["_square"] > 0
