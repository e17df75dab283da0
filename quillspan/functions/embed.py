"""A deterministic embedder without a model: hashed tokens on the unit sphere."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def embed_text(text: str | None, size: int = 64) -> list[float] | None:
    """Signed counts of the text's words in ``size`` hash slots, scaled to length 1; null for a text without words."""
    v = np.zeros(size)
    for w in _WORD.findall((text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h >> 31 else -1
    norm = np.linalg.norm(v)
    return (v / norm).tolist() if norm else None


def hashed_embedding(size: int = 64):
    """``embed_text`` as a column function."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([embed_text(t.as_py(), size) for t in texts], pa.list_(pa.float32()))

    return embed
