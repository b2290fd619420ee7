"""Embeddings as fixed-width binaries, so that tasks read them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass


def component_bytes(table: DataFrame, vec_col: str) -> int:
    """Bytes of a component as read() keeps it: floats stay 32 bits wide, all else becomes 64 bits wide."""
    return 4 if table.schema[vec_col].dataType.simpleString() == "array<float>" else 8


def read(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of every row: vec holds the components as floats (see component_bytes). It is null where the vector
    takes no part: null, empty and zero vectors, those with null or non-finite components, and vectors with a null id."""
    kind = np.float32 if component_bytes(table, vec_col) == 4 else np.float64
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, kind) if i is not None and v and None not in v else np.zeros(1)
                ids.append(i)
                vecs.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield tk.batch(schema, vec_id=ids, vec=vecs)

    kept = F.col(vec_col) if kind == np.float32 else F.col(vec_col).cast("array<double>")
    src = table.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("v"))
    return arrow_pass(src, run, "vec_id long, vec binary")


def common_width(rows: DataFrame) -> tuple[int, int]:
    """Of rows of read(): how many have the most frequent length of vec (ties: the smaller), and that length; (0, 0) for none."""
    kinds = rows.where("vec is not null").groupBy(F.length("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return (kinds["count"], kinds["w"]) if kinds else (0, 0)


def matrix(col, width: int) -> np.ndarray:
    """The rows of a binary column (or list of bytes) as a matrix of 64-bit floats."""
    rows = col if isinstance(col, list) else col.to_pylist()
    raw = b"".join(rows)
    kind = np.float32 if len(raw) == 4 * width * len(rows) else np.float64
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.float64)
