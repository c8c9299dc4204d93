import time

import pandas as pd

from glyphframe.operators import regions, tracks
from glyphframe.streaming.tracking import link_stream, linked


def test_stream_links_as_the_batch_does(spark, tmp_path):
    rows = [(c, f, o, 100 + 40 * o * 10 + 3 * (f % 2), 100, 400 + 400 * o, 160, [], 1.0, -1) for c in (0, 1) for f in range(30) if f % 9 != 4 for o in (0, 1)]
    found = spark.createDataFrame(rows, regions.REGIONS)
    for n, (a, z) in enumerate([(0, 10), (10, 25), (25, 30)]):
        found.where(f"frame >= {a} and frame < {z}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = link_stream(stream).writeStream.format("memory").queryName("links").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = ["clip_id", "frame", "item_ord", "first_frame", "first_ord", "sticky"]
    assert sorted(map(tuple, spark.table("links").select(*key).collect())) == sorted(map(tuple, tracks.build_tracks(found).select(*key).collect()))


def test_many_frames_of_a_clip_cost_no_more_than_their_links():
    rows = pd.DataFrame([(f, o, 100 + 400 * o, 100, 400 + 400 * o, 160) for f in range(20_000) for o in (1, 0)], columns=["frame", "item_ord", "x0", "y0", "x1", "y1"])
    linker = tracks.Linker(0.3, 12, 0.8)
    began = time.process_time()
    made = pd.concat([linked(linker, 7, rows[:30_000]), linked(linker, 7, rows[30_000:])])
    assert time.process_time() - began < 3
    assert list(made.columns) == ["clip_id", "frame", "item_ord", "first_frame", "first_ord", "sticky"] and len(made) == 40_000
    assert (made["first_frame"] == 0).all() and (made["first_ord"] == made["item_ord"]).all() and made["item_ord"].tolist()[:4] == [0, 1, 0, 1]
