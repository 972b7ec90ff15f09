"""Aligned numeric grids in NPZ archives, as rows of cells."""

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def grid_cells(archives: DataFrame, arrays: list[str]) -> DataFrame:
    """(file, y, x, *arrays) of ``archives(file, content)``: a row for each cell of an archive's grids.

    All of an archive's ``arrays`` must be there, have two axes and the same
    shape; otherwise the job fails with the file's name. NaN becomes null. Other
    members are not read. Objects are never unpickled.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if lacking := sorted(set(arrays) - set(z.files)):
                        raise ValueError(f"{file} has no {lacking}")
                    grids = [z[name].astype(np.float64) for name in arrays]
                if grids[0].ndim != 2 or len({g.shape for g in grids}) != 1:
                    raise ValueError(f"{file}: grids of the shapes {[g.shape for g in grids]} are not aligned")
                y, x = (i.ravel() for i in np.indices(grids[0].shape))
                yield pa.record_batch([pa.array([file] * len(y), pa.string()), pa.array(y, pa.int64()), pa.array(x, pa.int64()), *(pa.array(g.ravel(), from_pandas=True) for g in grids)], names=["file", "y", "x", *arrays])

    schema = ", ".join(["file string, y long, x long", *(f"`{a}` double" for a in arrays)])
    return archives.select("file", "content").mapInArrow(cells, schema)


def read_grids(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """The cells of all NPZ files below ``path``."""
    return grid_cells(spark.read.format("binaryFile").load(path).selectExpr("element_at(split(path, '/'), -1) as file", "content"), arrays)
