"""Bitmaps of bounded size that carry a set of hashes to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits that are packed together by one row.
PIECE = 1 << 14


def has_bits(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def slot_bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the values of ``slot``, packed by the cluster; ``bits / 8`` bytes in all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column(1):
                flags = np.zeros(PIECE, dtype=bool)
                flags[held.values.to_numpy()] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["piece", "bits"])

    pieces = slots.groupBy(F.expr(f"slot div {PIECE}").alias("piece")).agg(F.collect_set(F.expr(f"cast(slot % {PIECE} as int)")).alias("held"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for row in pieces.mapInArrow(pack, "piece long, bits binary").toLocalIterator():
        at = row["piece"] * PIECE // 8
        bitmap[at : at + PIECE // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bitmap
