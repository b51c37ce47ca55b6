"""Exact Jaccard self-join on word shingles as a blocked sparse matrix product.

Rows of the matrix are classes of documents with the same shingle set, columns are
shingles.  Columns are ordered from rare to common by a fixed-size count sketch of
the whole corpus, ties by hash; two sets of similarity t or more must share one of
the first ``n - ceil(t*n) + 1`` columns of each (prefix incidence), so only those
are multiplied.

1. Classes: documents with equal sets collapse to their smallest id; copies cost one
   row in a map-side combined aggregate and are never paired.
2. Prefix incidence is dealt by column; columns with one row are dropped at once.
3. Star round, for groups of near copies: in every column each row is paired with the
   row that has most shared columns - the least edited copy; a row's most frequent such
   partner, if it could be similar enough, is verified against the full sets.  Verified
   pairs give first components with a number of pairs linear in the group.  This round
   may miss anything; it only saves work.
4. Product round, over columns that rows of different components have, now ordered by
   how many rows they have.  A column's rows are dealt in blocks of ``block``, and each
   pair of blocks of a column is a cell of its own, so a column that very many rows have
   is many small tasks.  Cells emit overlap counts of pairs of different components, which
   are summed map-side and then over all cells; pairs whose sizes are too far apart, or
   that have too few columns left for the overlap their sizes ask for, are never formed,
   and those whose sum with what is left stays below it are discarded.  The rest is
   verified exactly.  A pair left out was in one component already, so no link between
   components is lost.

Nulls, empties, repeats: a null text counts as empty; a document without words has an
empty set and links with nothing; one with fewer than ``width`` words has its whole
sequence as one shingle.  Rows that repeat an id are one document whose links are
those of any of its rows; each input row gives an output row.  Texts of any length are
read whole.  A row without id keeps a null id and takes part in no class.  Ids are whole
numbers; others are an error.  Empty tables give empty results; further columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.bitmap import may_hold
from tidemark.llm.components import components
from tidemark.llm.scratch import drop, materialize, whole_ids

SKETCH_BITS = 20
_PART = 1 << 16


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, raw, offsets in W.text_chunks(column):
        h, _, _, first = W.words(raw, offsets)
        grams = W.ngrams(h, width)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield W.whole(h[a:b])
            else:
                yield h[:0]


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """Log-scale counts of shingles by the top bits of their hash: 2**SKETCH_BITS bytes, whatever the corpus."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, raw, offsets in W.text_chunks(batch.column(0)):
                grams = W.ngrams(W.words(raw, offsets)[0], width)  # those across texts only blur the order
                total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        total = np.minimum(total, 2**31 - 1).astype("<i4")
        parts = range(0, size, _PART)
        yield pa.RecordBatch.from_arrays([pa.array([p // _PART for p in parts], pa.int32()), pa.array([total[p : p + _PART].tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob, "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    parts = docs.mapInArrow(W.lean(count), "part int, counts binary")
    summed = parts.repartition(size // _PART, "part").mapInArrow(W.lean(add), "part int, counts binary")
    out = np.zeros(size, np.int64)
    for row in summed.collect():
        out[row.part * _PART : (row.part + 1) * _PART] += np.frombuffer(row.counts, "<i4")
    return np.minimum(np.log2(out + 1) * 8, 255).astype(np.uint8)


def _order(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of the hashes from rare to common."""
    return np.lexsort((s, rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))


def incidence(docs: DataFrame, rank, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, d1, d2 (digest of the set), key, prefix: one row per document.

    ``key`` is n * 2**24 plus the leading bits of the place, in the order of columns,
    of the last column of the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank.value
        for batch in W.slices(batches):
            n, d1, d2, key, prefix = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                d1.append(int(W.mix(s * W._ODD[40]).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(W.mix(s + W._ODD[41]).sum(dtype=np.uint64).view(np.int64)))
                keep = len(s) - (num * len(s) + den - 1) // den + 1 if len(s) else 0
                prefix.append(s[_order(s, table)[:keep]].view(np.int64))
                last = prefix[-1][-1:].view(np.uint64)
                place = (int(table[int(last[0] >> np.uint64(64 - SKETCH_BITS))]) << 16 | int(last[0] >> np.uint64(48))) if keep else 0
                key.append(len(s) << 24 | place)
            sizes = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(key, pa.int64()), lists], names=["id", "n", "d1", "d2", "key", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(W.lean(run), f"id {kind}, n long, d1 long, d2 long, key long, prefix array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted batches, cut only where the first column (the cell) changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield tuple(np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True))
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    return start, np.r_[start[1:], len(cell)].astype(np.int64)[: len(start)]


def shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (col, key, id): the columns that two rows or more have; a row is held back at most."""
    names, held, before = ["col", "key", "id"], None, None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        col = now[0]
        same = np.r_[before is not None and col[0] == before, col[1:] == col[:-1]]
        keep = np.flatnonzero(same[:-1] | same[1:])
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in now], names=names)
        held = [x[-1:] for x in now]
        before = col[-2] if len(col) > 1 else before
    if held is not None and before is not None and held[0][0] == before:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)


def least_overlap(key_u, key_v, num: int, den: int, where, most, ceil):
    """The least prefix overlap with which two rows can be similar enough; over arrays or columns alike.

    All columns up to the end of the prefix that ends first are in both prefixes' reach;
    what overlaps beyond it lies past that prefix.
    """
    nu, nv = key_u[0], key_v[0]
    past_u, past_v = ceil(nu * num, den) - 1, ceil(nv * num, den) - 1
    past = where(key_u[1] < key_v[1], past_u, where(key_u[1] > key_v[1], past_v, most(past_u, past_v)))
    return ceil((nu + nv) * num, num + den) - past


def multiply(num: int, den: int):
    """Over sorted (cell, key, id, comp, room, side): overlaps of pairs of different components, accumulated.

    A cell is a column, or of a column with many rows a block of them against another
    (sides 1 and 2) or itself (side 0).  ``room`` is how many of its columns a row has
    from this one on, ``need`` the least overlap of prefixes that the pair's sizes ask
    for.  A pair counts in the columns where both rows have that much room; so its
    overlap is ``c`` at least and ``c`` + ``rest`` at most.
    """
    split = lambda key: (key >> 24, key & 0xFFFFFF)
    ceil = lambda x, y: -(-x // y)
    names = ["u", "v", "c", "rest", "need"]

    def summed(found: list[tuple]) -> pa.RecordBatch:
        u, v, rest, need = map(np.concatenate, zip(*found, strict=True))
        by = np.lexsort((v, u))
        u, v, rest, need = u[by], v[by], rest[by], need[by]
        new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        columns = u[new], v[new], np.diff(np.r_[new, len(u)]), np.minimum.reduceat(rest, new), np.maximum.reduceat(need, new)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0
        for cell, key, ids, comp, room, side in _runs(batches):
            n = key >> 24

            def keep(u: np.ndarray, v: np.ndarray) -> int:
                fits = (n[v] * num <= n[u] * den) & (comp[u] != comp[v]) & ((side[u] == 0) | (side[u] != side[v]))  # noqa: B023
                u, v = u[fits], v[fits]
                need = least_overlap(split(key[u]), split(key[v]), num, den, np.where, np.maximum, ceil)  # noqa: B023
                both = np.minimum(room[u], room[v])  # noqa: B023
                fits = both >= need
                if fits.any():
                    found.append((ids[u[fits]], ids[v[fits]], both[fits] - 1, need[fits]))  # noqa: B023
                return int(fits.sum())

            # Each row with those after it in its cell, some rows of all cells at a time.
            start, end = _bounds(cell)
            after = np.repeat(end, end - start) - np.arange(len(cell)) - 1
            total = np.cumsum(after)
            cuts = np.searchsorted(total, np.arange(0, int(total[-1]), 500_000), side="right") if len(total) and total[-1] else []
            for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                u = np.repeat(np.arange(a, b), after[a:b])
                held += keep(u, np.arange(len(u)) - np.repeat(total[a:b] - after[a:b] - (total[a - 1] if a else 0), after[a:b]) + u + 1)
                if held > 1_000_000:  # bounds the memory, not the pairs
                    yield summed(found)
                    found.clear()
                    held = 0
        if found:
            yield summed(found)

    return go


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (u, v), those whose full sets have den * overlap >= num * union."""
    left = sets.select(F.col("id").alias("u"), F.col("s").alias("us"))
    right = sets.select(F.col("id").alias("v"), F.col("s").alias("vs"))
    both = pairs.join(left, "u").join(right, "v")
    overlap = F.size(F.array_intersect("us", "vs"))
    union = F.size("us") + F.size("vs") - F.col("o")
    return both.withColumn("o", overlap).where(F.lit(den) * F.col("o") >= F.lit(num) * union).select("u", "v")


def jaccard_components(
    spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id: components over links of Jaccard similarity num/den or more."""
    whole_ids(docs, id_col)
    rank = spark.sparkContext.broadcast(rarity(docs.select(text_col), width))
    rows = materialize(incidence(docs, rank, width, num, den, id_col, text_col), "incidence")

    # 1. Classes of equal sets.
    meta = materialize(rows.select("id", "n", "d1", "d2"), "meta")
    named = meta.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = materialize(named.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    reps = rows.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi").dropDuplicates(["id", "d1", "d2"])

    # 2. Columns that two rows share.
    cells = reps.select(F.explode("prefix").alias("col"), "key", "id")
    dealt = cells.repartition("col").sortWithinPartitions("col", "key", "id")
    shared = materialize(dealt.mapInArrow(W.lean(shared_columns), "col long, key long, id long"), "columns")
    drop(rows)

    def sets_of(ids: DataFrame) -> DataFrame:
        """The full sets of some documents, from their texts; a bitmap thins the scan."""
        ids = materialize(ids.distinct(), "wanted")
        held = may_hold(ids.select(F.xxhash64("id").alias("probe")), ids.count())
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
        texts = held(texts, F.xxhash64("id"), "wanted").where("wanted").drop("wanted").join(ids, "id", "left_semi")

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches):
                s = list(shingle_sets(batch.column(1), width))
                sizes = np.cumsum([0, *map(len, s)]).astype(np.int32)
                flat = np.concatenate(s).view(np.int64) if s else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["id", "s"])

        return materialize(texts.mapInArrow(W.lean(full), "id long, s array<long>"), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select("u", "v"), "pairs")
        sets = sets_of(pairs.select(F.col("u").alias("id")).union(pairs.select("v")))
        out = materialize(verified(pairs, sets, num, den), "links")
        drop(sets, pairs)
        return out

    # 3. Star round.
    ranked = shared.join(shared.groupBy("id").agg(F.count(F.lit(1)).alias("k")), "id")
    centre = ranked.groupBy("col").agg(F.max(F.struct("k", F.negative("id").alias("v"), F.col("key").alias("v_key"))).alias("x"))
    centre = centre.select("col", F.negative("x.v").alias("v"), F.col("x.v_key").alias("v_key"))
    met = shared.join(centre, "col").where("id != v").groupBy("id", "v").agg(F.count(F.lit(1)).alias("c"), F.max("key").alias("key"), F.max("v_key").alias("v_key"))
    split = lambda c: (F.shiftright(c, 24), F.col(c).bitwiseAND(0xFFFFFF))
    ceil = lambda x, y: F.ceil(x / y - 1e-9)
    need = least_overlap(split("key"), split("v_key"), num, den, lambda c, x, y: F.when(c, x).otherwise(y), F.greatest, ceil)
    best = met.where(F.col("c") >= need).groupBy("id").agg(F.max_by("v", F.struct("c", F.negative("v"))).alias("v")).select(F.col("id").alias("u"), "v")
    first = components(links_of(best))

    # 4. Product of what lies in different components.
    tagged = shared.join(first.select(F.col("node").alias("id"), "component"), "id", "left").select("col", "key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = tagged.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi")
    own = Window.partitionBy("id")
    room = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("m", "col")) + 1
    placed = tagged.join(mixed.select("col", "m"), "col").withColumn("room", room.cast("long"))
    # A column's rows are dealt in blocks, and each pair of blocks is a cell.
    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = placed.withColumns({"b": F.pmod(F.xxhash64("id"), blocks).cast("int"), "o": F.explode(F.sequence(F.lit(0), blocks - 1))})
    cell = F.xxhash64("col", F.least("b", "o"), F.greatest("b", "o"))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).cast("long")
    product = dealt.select(cell.alias("cell"), "key", "id", "comp", "room", side.alias("side")).repartition("cell").sortWithinPartitions("cell", "key", "id")
    summed = product.mapInArrow(W.lean(multiply(num, den)), "u long, v long, c long, rest long, need long")
    found = summed.groupBy("u", "v").agg(F.sum("c").alias("c"), F.min("rest").alias("rest"), F.max("need").alias("need"))
    links = links_of(found.where(F.col("c") + F.col("rest") >= F.col("need")))
    drop(shared)
    a, b = (first.select(F.col("node").alias(x), F.col("component").alias(f"{x}c")) for x in ("u", "v"))
    lifted = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    second = components(lifted)

    # Class -> component -> component of components; then to every document.
    top = first.select(F.col("node").alias("rep"), "component").join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    top = top.select("rep", F.coalesce("top", "component").alias("comp")).union(second.join(first, "node", "left_anti").select("node", "component"))
    final = classes.join(top, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).where((F.col("members") > 1) | (F.col("comp") != F.col("rep")))
    final = materialize(final.select("n", "d1", "d2", "comp"), "classes")
    out = meta.join(final, ["n", "d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
