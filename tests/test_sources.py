"""CSV with positions: pieces that begin anywhere, and first rows."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from kinweave.sources import positions


def _file(seed, rows=60, crlf=False):
    rng, out = random.Random(seed), io.StringIO(newline="")
    cell = lambda: "".join(rng.choice(["a", "ü", ",", '"', "\n", " ", "漢", "\r\n"]) for _ in range(rng.randrange(9)))
    writer = csv.writer(out, lineterminator="\r\n" if crlf else "\n")
    writer.writerow(["id", "te,xt", "more"])
    for i in range(rows):
        writer.writerow([i % 23, cell(), cell()])
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue() if seed % 2 else out.getvalue().rstrip("\r\n")


@pytest.mark.parametrize("seed, piece", [(1, 1 << 20), (2, 7), (3, 40), (4, 300)])
def test_rows_and_places_against_one_reader(spark, tmp_path, seed, piece):
    text = _file(seed, 60 if piece > 20 else 12, seed == 3)
    (tmp_path / "t.csv").write_bytes(text.encode())
    told = [(i, *row) for i, row in enumerate(csv.reader(io.StringIO(text, newline=""))) if i and row]
    df = positions.read_positioned(spark, str(tmp_path / "t.csv"), piece)
    assert df.columns == ["id", "te,xt", "more", "_file", "_row"]
    assert sorted((r._row, r.id, r["te,xt"], r.more) for r in df.collect()) == told
    first = {}
    for i, key, *rest in told:
        first.setdefault(key, rest)
    assert {r.id: [r["te,xt"], r.more] for r in positions.first_rows(df, "id").collect()} == first


def test_folders_short_rows_and_empty_files(spark, tmp_path):
    for name, text in (("part-0.csv", "id,t\nx,1\ny\n"), ("part-1.csv", "id,t\nx,2,3\n"), ("_SUCCESS", ""), (".crc", "zz"), ("part-2.csv", "")):
        (tmp_path / name).write_text(text)
    rows = [(r._file[-10:], r._row, r.id, r.t) for r in positions.read_positioned(spark, f"file://{tmp_path}", 5).collect()]
    assert sorted(rows) == [("part-0.csv", 1, "x", "1"), ("part-0.csv", 2, "y", ""), ("part-1.csv", 1, "x", "2")]
    (tmp_path / "none").mkdir()
    assert positions.read_positioned(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "head.csv").write_text("id,t")
    assert positions.read_positioned(spark, str(tmp_path / "head.csv")).columns == ["id", "t", "_file", "_row"]


def test_a_run_keeps_the_first_row_of_a_key(spark, tmp_path):
    from kinweave.plans.pipeline import read_split
    from kinweave.sources import config

    root = tmp_path / "toy"
    root.mkdir()
    (root / "tableA.csv").write_text('id,title,authors\n7,zeta,"E Rahm"\n7,alpha,"H Do"\n')
    (root / "tableB.csv").write_text('id,title,authors\n9,"b\nc","E Rahm"\n9,a,\n')
    (root / "test.csv").write_text("ltable_id,rtable_id,label\n7,9,1\n")
    split = read_split(spark, config.from_dict({"dataset": {"name": "toy", "data_dir": str(tmp_path)}, "run": {}, "algo": {}}), "test")
    assert [(r.l_title, r.r_title) for r in split.enriched.collect()] == [("zeta", "b\nc")]


BAGS = """
from kinweave.operators import scorers


def make(config):
    same = lambda line: 5.0 if line.split("\\t")[0].split("title")[1].split(",")[0] == line.split("\\t")[1].split("title")[1].split(",")[0] else -5.0
    return scorers.External(["title"], lambda: lambda lines: [(0.0, same(x)) for x in lines])
"""


@pytest.mark.parametrize("strategy", ["LATE_FUSION", "INLINE_ENCODE"])
def test_a_scorer_named_on_the_command_line(spark, tmp_path, monkeypatch, strategy):
    import json

    from kinweave.__main__ import main

    (tmp_path / "my_bags.py").write_text(BAGS)
    monkeypatch.syspath_prepend(str(tmp_path))
    root = tmp_path / "toy"
    root.mkdir()
    (root / "tableA.csv").write_text('id,title,authors\n1,red car,"E Rahm"\n2,blue boat,"H Do"\n')
    (root / "tableB.csv").write_text('id,title,authors\n3,red car,"E Rahm"\n4,boat blue,"A Li"\n')
    for split in ("train", "valid", "test"):
        (root / f"{split}.csv").write_text("ltable_id,rtable_id,label\n1,3,1\n2,4,0\n")
    given = {"dataset": {"name": "toy", "data_dir": str(tmp_path)}, "run": {"log_dir": str(tmp_path / "logs"), "output_dir": str(tmp_path / "out"), "reduced_dir": str(tmp_path / "reduced")}, "algo": {"strategy": strategy, "alpha": 0.1, "threshold": 0.6}}
    (tmp_path / "c.json").write_text(json.dumps(given))
    found = main(["--config", str(tmp_path / "c.json"), "--scorer", "my_bags:make"])
    assert (found["accuracy"], found["f1"]) == (1.0, 1.0)


def test_a_file_of_some_megabytes_is_read_by_several_tasks(spark, tmp_path):
    n = 500_000
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{i},"N\n""O,{i % 97}"\n' for i in range(n)))
    found = positions.read_positioned(spark, str(tmp_path / "a.csv"))
    at = found.select("_row", "id").agg({"_row": "sum", "id": "count"}).first()
    size = (tmp_path / "a.csv").stat().st_size
    assert (at["sum(_row)"], at["count(id)"]) == (n * (n + 1) // 2, n) and size > 8 << 20
    assert found.select(F.spark_partition_id()).distinct().count() == -(-size // (8 << 20)) > 1


def test_rows_of_the_trained_scorer_are_made_once(spark):
    from kinweave.plans import registry

    found = registry.queries()["trained_scorer"](spark, "/root/testdata/sf0.01")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pred for r in found.collect()} <= {0, 1}
