"""A bounded bitmap of hashes that thins a scan before a shuffle join.

It never loses a row; what passes by chance is removed by the exact join that follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize

_BITMAP_MOST = 28  # 2**28 bits, 32 MiB: beyond it the bitmap lets more rows pass, and no result changes
_PART_BITS = 19
_TABLE_BITS = 15  # of a part that bitmap_construct_agg builds


def bitmap(probes: DataFrame, count: int) -> np.ndarray:
    """One bit per leading bits of ``probe``, built by ranges of the hash; at most 32 MiB come to the driver."""
    bits = min(_BITMAP_MOST, max(_PART_BITS, int(np.ceil(np.log2(16 * count + 1)))))

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            part = (at >> np.uint64(_PART_BITS)).astype(np.int64)
            for p in np.unique(part).tolist():
                inner = (at[part == p] & np.uint64((1 << _PART_BITS) - 1)).astype(np.int64)
                own = parts.setdefault(p, np.zeros(1 << (_PART_BITS - 3), np.uint8))
                np.bitwise_or.at(own, inner >> 3, (1 << (inner & 7)).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["part", "bits"])

    part = F.shiftrightunsigned("probe", 64 - (bits - _PART_BITS)) if bits > _PART_BITS else F.lit(0)
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_PART_BITS - 3)
    for row in probes.repartition(part).select("probe").mapInArrow(build, "part int, bits binary").collect():
        out[row.part * size : (row.part + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return out


def may_hold(probes: DataFrame, count: int) -> Callable[[DataFrame, Column, str], DataFrame]:
    """A function that adds to a table whether a hash of its rows may be one of ``probes`` (a column ``probe``).

    The bitmap is a table of 4 KiB parts, 32 MiB in all at most, that is broadcast; rows
    are looked up in the JVM, so texts beside them pass through no Python worker.  A null
    hash or an empty ``probes`` gives false.
    """
    bits = min(_BITMAP_MOST, max(_TABLE_BITS, int(np.ceil(np.log2(16 * count + 1)))))

    def part(probe: Column) -> Column:
        return F.shiftrightunsigned(probe, 64 - bits + _TABLE_BITS) if bits > _TABLE_BITS else F.when(probe.isNotNull(), F.lit(0).cast("long"))

    def bit(probe: Column) -> Column:
        return F.shiftrightunsigned(probe, 64 - bits).bitwiseAND(F.lit((1 << _TABLE_BITS) - 1))

    own = probes.where("probe is not null").select(part(F.col("probe")).alias("__part"), bit(F.col("probe")).alias("__bit"))
    # Dealt before it is built: 8 bytes a probe move, not a part a probe.
    table = materialize(own.repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bits")

    def held(rows: DataFrame, probe: Column, name: str) -> DataFrame:
        at = rows.select("*", probe.alias("__probe"))
        at = at.select(*at.columns, part(F.col("__probe")).alias("__part")).join(F.broadcast(table), "__part", "left")
        inner = bit(F.col("__probe"))
        byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(inner, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
        found = F.coalesce(F.getbit(byte, inner.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        return at.select(*rows.columns, found.alias(name))

    return held
