"""The batch linker on a stream of regions: state is the open tracks of a clip, and output is the same links."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphframe.config import RegionConfig
from glyphframe.operators.tracks import Linker
from glyphframe.sources.frames import shared_folder

LINKS = "clip_id bigint, frame bigint, item_ord int, first_frame bigint, first_ord int, sticky int"


def linked(linker: Linker, clip: int, rows: pd.DataFrame) -> pd.DataFrame:
    """The links of a clip's next frames; the tracks of its last frame are open from now on.

    Rows go through the linker as plain values: a data frame for each frame of a clip would cost more than all its links.
    """
    order = np.lexsort((rows["item_ord"].to_numpy(), rows["frame"].to_numpy()))
    frames, ordinals, *corners = (rows[c].to_numpy()[order] for c in ("frame", "item_ord", "x0", "y0", "x1", "y1"))
    links = []
    for frame, ordinal, *box in zip(frames.tolist(), ordinals.tolist(), *[c.tolist() for c in corners], strict=True):
        if frame != linker.now:
            linker.begin(frame)
        links.append(linker.link(ordinal, tuple(box)))
    linker.open, linker.begun = linker.open + linker.begun, []
    first_frame, first_ord, sticky = zip(*links, strict=True)
    return pd.DataFrame({"clip_id": clip, "frame": frames, "item_ord": ordinals, "first_frame": first_frame, "first_ord": first_ord, "sticky": sticky})


def link_stream(regions: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    """first_frame, first_ord and sticky for each region of a stream with clip_id, frame, item_ord and the box.

    A clip's frames must come in order, and all regions of a frame in one micro-batch. A track that the horizon has left
    behind falls out of the state with the next frame, so that the state is bounded by what a clip shows at a time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker = Linker(cfg.link_iou, cfg.link_horizon, cfg.sticky_iou)
        if state.exists:
            linker.open = [[*t[:3], tuple(t[3]), tuple(t[4]), t[5]] for t in json.loads(state.get[0])]
        made = linked(linker, key[0], pd.concat(list(batches)))
        state.update((json.dumps(linker.open),))
        yield made

    columns = regions.select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1")
    return columns.groupBy("clip_id").applyInPandasWithState(step, LINKS, "open string", "append", GroupStateTimeout.NoTimeout)


def replayed_links(regions: DataFrame, frames: int, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    """link_stream over a table that is replayed as a stream: so many frames of every clip are a micro-batch.

    The files and the stream's state lie in the folder of spark.checkpoint.dir; a local session may do without.
    """
    spark = regions.sparkSession
    root = shared_folder(spark, "links")
    rows = regions.select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1").withColumn("part", F.floor(F.col("frame") / frames).cast("int"))
    saved = rows.persist()
    for part in range((saved.agg(F.max("part")).first()[0] or 0) + 1):  # bounded by a clip's frames
        saved.where(F.col("part") == part).drop("part").write.parquet(f"{root}/in/{part:06d}")
        # All files of a part are one micro-batch, however many tasks have written them.
        stream = spark.readStream.schema(rows.drop("part").schema).parquet(f"{root}/in/*")
        link_stream(stream, cfg).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    saved.unpersist()
    return spark.read.schema(LINKS).parquet(f"{root}/out")
