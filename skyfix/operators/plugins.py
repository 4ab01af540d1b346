"""User-supplied encoders and matchers, run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A match result: correspondences in pixels of query and tile with the inlier mask, and the homography from query to tile.
CORRESPONDENCES = "array<struct<qu: double, qv: double, tu: double, tv: double, inlier: boolean>>"
_NAMES = ("qu", "qv", "tu", "tv", "inlier")


def embed(images: DataFrame, encoder_factory: Callable, key: str = "id", image: str = "content") -> DataFrame:
    """(key, descriptor): encoder_factory() is called once a task and gives a function from an Arrow array of images to a row of
    numbers for each. Images reach it as they lie in the batch."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder_factory()
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.asarray(encode(batch.column(1)), dtype=np.float32).reshape(batch.num_rows, -1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], [key, "descriptor"])

    return images.select(key, image).mapInArrow(run, f"{key} {kind}, descriptor array<float>")


def match(pairs: DataFrame, matcher_factory: Callable, partitions: int) -> DataFrame:
    """(query_id, tile_id, num_matches, num_inliers, correspondences, homography) of candidate pairs (query_id, tile_id,
    query_image, tile_image): what localize needs of a candidate.

    matcher_factory() is called once a task and gives a function of (query image, tile image, tile id) to (points, mask,
    homography): points in rows of qu, qv, tu, tv, a flag for each, and nine numbers or None. Fewer than four points count as no
    inlier (see localize.usable_inliers); the points stay. Pairs are dealt by tile and sorted, so what a task's matcher keeps for a
    tile is used again. What is done already is left out before, by select.pending on both ids.
    """
    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "tile_id"))

    def run(batches):
        matcher = matcher_factory()
        for batch in batches:
            points, masks, homographies, sizes = [np.zeros((0, 4))], [np.zeros(0, bool)], [], [0]
            for i in range(batch.num_rows):
                found, mask, homography = matcher(*(batch.column(c)[i].as_py() for c in ("query_image", "tile_image", "tile_id")))
                points.append(np.asarray(found, np.float64).reshape(-1, 4))
                masks.append(np.asarray(mask, bool).reshape(-1))
                sizes.append(len(points[-1]))
                homographies.append(None if homography is None else np.asarray(homography, np.float64).ravel().tolist())
            every, mask = np.concatenate(points), np.concatenate(masks)
            structs = pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(every[:, j])) for j in range(4)), pa.array(mask)], _NAMES)
            inliers = [int(m.sum()) for m in masks[1:]]
            columns = [
                batch.column("query_id"), batch.column("tile_id"), pa.array(sizes[1:], pa.int32()), pa.array(inliers, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), structs), pa.array(homographies, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "tile_id", "num_matches", "num_inliers", "correspondences", "homography"])

    dealt = pairs.select("query_id", "tile_id", "query_image", "tile_image").repartition(partitions, "tile_id").sortWithinPartitions("tile_id")
    return dealt.mapInArrow(run, f"{ids}, num_matches int, num_inliers int, correspondences {CORRESPONDENCES}, homography array<double>")


def image_key(path: str = "path"):
    """Stem of an image path."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
