from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphframe import arguments
from glyphframe.operators import clips, exclusions, masks, timeline
from glyphframe.plans import catalogue
from glyphframe.sources.frames import Y4mSource, get_masks, probe, put_clips, put_masks, scan_clips

SF = "/root/testdata/sf0.001"


def test_entry_has_the_expected_runs(spark):
    assert __spark_entry__.entry(spark).count() == 442


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain(value):
    return round(float(value), 5) + 0.0 if isinstance(value, (float, int, Decimal)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_against_their_oracles(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = catalogue.QUERIES[name](spark, SF), con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: Counter(tuple(map(plain, r)) for r in found)
    assert rows(want.fetchall()) == rows(got.select(*columns).collect())


def test_y4m_and_masks(spark, tmp_path):
    path = tmp_path / "a.y4m"
    path.write_bytes(b"YUV4MPEG2 W4 H2 F24:1 C420\n" + b"".join(b"FRAME\n" + bytes([n] * 8) + bytes([128] * 4) for n in range(3)) + b"FRAME\n12")
    spark.dataSource.register(Y4mSource)
    rows = spark.read.format("y4m").option("paths", str(path)).load().orderBy("frame").collect()
    assert [(r.frame, r.w, r.h, r.luma[0], len(r.chroma)) for r in rows] == [(0, 4, 2, 0, 4), (1, 4, 2, 1, 4), (2, 4, 2, 2, 4)]
    ramp = [i / 63 for i in range(64)]
    put_masks(spark.createDataFrame([(0, 5, ramp)], "clip_id long, frame long, prob array<double>"), str(tmp_path / "masks"))
    back = get_masks(spark, str(tmp_path / "masks")).first().prob
    assert max(abs(a - b) for a, b in zip(ramp, back, strict=True)) < 1 / 255 + 1e-6


def test_clips_survive_their_files(spark, tmp_path):
    rows = [(c, n, 4, 2, 23.976 if c else 25.0, 10 if c == 2 else 8, bytes([n + c] * (16 if c == 2 else 8)), bytes([128] * (8 if c == 2 else 4))) for c in range(3) for n in range(7)]
    frames = spark.createDataFrame(rows, "clip_id long, frame long, w int, h int, fps double, bit_depth int, luma binary, chroma binary")
    put_clips(frames, str(tmp_path / "clips"))
    back = scan_clips(spark, [str(tmp_path / f"clips/clip-{c}.y4m") for c in range(3)], 3)
    assert back.rdd.getNumPartitions() == 9
    found = sorted((r.clip_id, r.frame, r.w, r.h, round(r.fps, 3), r.bit_depth, bytes(r.luma), bytes(r.chroma)) for r in back.collect())
    assert found == sorted((*r[:4], round(r[4], 3), *r[5:]) for r in rows)
    paths = spark.createDataFrame([(c, str(tmp_path / f"clips/clip-{c}.y4m")) for c in (0, 2, 9)] + [(10, None)], "clip_id long, path string")
    said = {r.clip_id: (r.w, r.h, r.n_frames, r.fmt, r.bit_depth) for r in probe(paths).collect()}
    assert said == {0: (4, 2, 7, "yuv420p", 8), 2: (4, 2, 7, "yuv420p10le", 10), 9: (None,) * 5, 10: (None,) * 5}


def test_masks_are_cleared_by_clip(spark, tmp_path):
    put_masks(spark.createDataFrame([(c, 1, [0.5] * 4) for c in (1, 2)], "clip_id long, frame long, prob array<double>"), str(tmp_path / "m"))
    assert masks.cleared(spark, str(tmp_path / "m"), 1) > 0 and masks.cleared(spark, str(tmp_path / "m"), 1) == 0
    assert [r.clip_id for r in get_masks(spark, str(tmp_path / "m")).collect()] == [2]


def test_models_files_and_weights(spark):
    files = spark.createDataFrame([("vit_l-b.pth",), ("vit_l-a.pth",), ("vit_h.pth",), ("vit_l-0.txt",)], "name string")
    assert clips.checkpoint(files, "vit_l", suffix=".pth") == "vit_l-a.pth"
    with pytest.raises(FileNotFoundError):
        clips.checkpoint(files, "vit_b")
    weights = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    clips.check_weights(weights, spark.createDataFrame([("a",), ("hi_decoder.x",)], "key string"))
    with pytest.raises(ValueError, match="such as c"):
        clips.check_weights(weights, spark.createDataFrame([("a",), ("c",)], "key string"))


def test_documents_say_why_they_are_not_read(spark):
    docs = spark.createDataFrame([(1, '{"version":1,"regions":[[]],"excluded":[3,1]}'), (2, '{"regions":[[]],"excluded":[3]}'), (3, "{broken"), (4, None)], "clip_id long, document string")
    got = {r.clip_id: (r.excluded, r.note) for r in timeline.document_states(docs).collect()}
    assert got[1] == ([3, 1], None) and got[2][0] == [] and "version" in got[2][1] and "read" in got[3][1] and "read" in got[4][1]
    again = docs.where("clip_id < 3").select("clip_id", exclusions.persisted(F.col("document"), F.array(F.lit(5), F.lit(2), F.lit(5))).alias("document"))
    assert {r.clip_id: r.excluded for r in timeline.document_states(again).collect()} == {1: [2, 5], 2: []}
    bare = spark.createDataFrame([(1, '{"version":1,"regions":[]}')], "clip_id long, document string")
    assert timeline.document_states(bare.select("clip_id", exclusions.persisted(F.col("document"), F.array(F.lit(4))).alias("document"))).first().excluded == [4]


def test_written_documents_are_read_and_not_worked_out_again(spark):
    found = catalogue.QUERIES["s13_timeline_write"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan and "document" in plan


def test_documents_of_many_clips_are_written_in_parts(spark, monkeypatch):
    from glyphframe.plans import timeline_queries

    query, rows, kept = catalogue.QUERIES["s13_timeline_write"], [], []
    whole = sorted(map(tuple, query(spark, SF).collect()))
    n = timeline_queries.dets_of(spark, SF).count()
    write, stored = timeline_queries.stored, []

    def counted(found, path, *mode):
        table = write(found, path, *mode)
        stored.append(path)
        rows.append(table.count()) if path.endswith("/regions") else kept.append(table.count())
        return table

    monkeypatch.setattr(timeline_queries, "stored", counted)
    monkeypatch.setattr(timeline_queries, "AT_ONCE", n // 3)
    assert sorted(map(tuple, query(spark, SF).collect())) == whole
    assert len(rows) >= 3 and max(rows) < 0.75 * sum(rows), "regions of some clips at a time"
    assert kept == sorted(kept) and kept[-1] == len(whole)
    place = spark._jvm.org.apache.hadoop.fs.Path(stored[0])
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_arguments_are_checked():
    assert arguments.roi("0,0.5,1,1") == (0, 0.5, 1, 1) and arguments.quality(" Lossless ") == "lossless" and arguments.quality("51") == "51"
    assert arguments.run_ids("3, 1,") == (3, 1) and arguments.text_value("AUTO") is None and arguments.text_value("255") == 255
    for check, wrong in ((arguments.roi, "0.5,0,0.5,1"), (arguments.roi, "0,0,1"), (arguments.quality, "52"), (arguments.quality, "best"), (arguments.run_ids, "-1"), (arguments.run_ids, "x"), (arguments.text_value, "256")):
        with pytest.raises(ValueError):
            check(wrong)
