"""Hierarchical best-fit packing of documents into token sequences.

1. Tokenise (map only): each document becomes pieces of at most ``capacity`` tokens;
   full pieces are finished sequences.
2. The ids and lengths of the short pieces - a few bytes each - are dealt evenly over
   the partitions.  Each partition packs its own by best fit, longest first.
3. Bins that are full to within ``slack`` are final.  Underfull bins go up a tree,
   ``fan_in`` groups at a time, as items of their fill, and are best-fitted again.
   After best fit a group holds at most one bin that is half full or less, and two
   fuller ones never fit into one; so a round of ``fan_in`` groups saves ``fan_in``
   sequences at most, and needs no more fuller bins to do so.  The ``fan_in`` + 1
   emptiest bins of a group go up and the rest are final, which bounds every task and
   gives as few sequences as sending all of them up.
4. The rounds' maps from bins to bins, which are small, are composed and then joined to
   the pieces once.

Nulls, empties, repeats: a null text counts as empty and yields one piece that holds
the end token alone.  A text of any length is cut into as many pieces as it takes.  A
repeated id repeats its pieces; each copy has its own place (``number`` tells pieces
apart).  A null id is kept as null.  Equal sizes are taken in the order of ``number``.
Empty tables give empty results.  Further columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.scratch import materialize

_ENCODERS: dict[str, Encoder] = {}


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet of public byte BPE files: printable bytes as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a public byte-level BPE file, as ``tokenizers`` gives them.

    A file whose merges give tokens in the order of their ids runs on tiktoken's merge
    loop, which gives the same ids about four times as fast.  Any other file, any text
    that holds one of the file's added tokens, and any text that loop refuses, goes to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str, fast: bool = True):
        self.path, self.fast, self.slow, self.added = path, None, None, None
        if fast:
            self._load()

    def agrees(self) -> bool:
        """Whether both ways give the same ids on texts that tell them apart."""
        probe = ["Plain words, 12345 and it's  two  spaces\n\n\ttab", "ünïcödé 漢字 🙂   x'll", " <|endoftext|> ", ""]
        return self.fast is not None and all(self.ids(t) == self._theirs(t) for t in probe)

    def _load(self) -> None:
        """The merge loop and the added tokens' pattern, if the file allows the loop."""
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return
        added = [t["content"] for t in spec.get("added_tokens", ())]
        plain = {token: i for token, i in model["vocab"].items() if token not in added}
        made = [plain.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        single = {i for token, i in plain.items() if len(token) == 1}
        if None in made or made != sorted(set(made)) or not single.isdisjoint(made) or len(single) + len(made) != len(plain) or max(single) > made[0]:
            return
        import tiktoken

        alphabet = _byte_alphabet()
        try:
            ranks = {bytes(alphabet[c] for c in token): i for token, i in plain.items()}
        except KeyError:
            return
        # The published splitting pattern of byte-level BPE.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _theirs(self, text: str) -> list[int]:
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """The text's ids; none is put around them."""
        if self.fast is not None and (self.added is None or not self.added.search(text)):
            try:
                return self.fast(text)
            except Exception:  # its splitter's stack has a limit on long runs of blanks
                pass
        return self._theirs(text)


def encoder(path: str, fast: bool) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, fast)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """number (unique), doc_id, piece, start, length, ids (little-endian unsigned 32-bit), one row per piece."""
    fast = Encoder(tokenizer).agrees()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = encoder(tokenizer, fast), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0)[lo : lo + 1000].to_pylist(), batch.column(1)[lo : lo + 1000].to_pylist(), strict=True):
                    tokens = np.array([*own.ids(text or ""), end_id], dtype="<u4")
                    n = len(tokens)
                    cuts = [0, n] if n <= capacity else sorted({0, *range(n % capacity, n + 1, capacity)})
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((number, doc, piece, a, b - a, tokens[a:b].tobytes()))
                        number += 1
                kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        W.lean(run), f"number long, doc_id {kind}, piece int, start long, length long, ids binary"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and the bins' fills.

    The gaps that open bins have are the bits of one integer, so the tightest fitting
    gap is found by a shift and a lowest-bit test.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
        else:
            b, gap = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if gap > size:
            if not by_gap[gap - size]:
                open_gaps |= 1 << (gap - size)
            by_gap[gap - size].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """Best fit within each group: item, bin (unique by level and group), place, fill, grp, first (a row per bin)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        grp = int(pdf["grp"].iloc[0])
        bins, place, fills = best_fit(pdf["size"].to_numpy(), capacity)
        return pd.DataFrame({"item": pdf["item"], "bin": (level << 56) + (grp << 28) + bins, "place": place, "fill": fills[bins], "grp": grp, "first": place == 0})

    return items.groupBy("grp").applyInPandas(fit, "item long, bin long, place long, fill long, grp int, first boolean")


def _followed(items: DataFrame, moved: DataFrame) -> DataFrame:
    """item, bin, place after the bins of ``items`` that are items of ``moved`` have moved on."""
    step = moved.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("place").alias("shift"))
    return items.join(step, "bin", "left").select("item", F.coalesce("next", "bin").alias("bin"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    items_per_group: int = 20_000,
    fan_in: int = 8,
    slack: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: dict[str, Column] | None = None,
) -> DataFrame:
    """number, doc_id, piece, start, length, the payload, sequence_id, offset: every piece and its place.

    ``payload`` names what to keep of a piece's ``ids``, as columns over it; by default
    the ids themselves.
    """
    payload = payload or {"ids": F.col("ids")}
    kept = [v.alias(k) for k, v in payload.items()]
    pieces = materialize(tokenise(docs, tokenizer, capacity, end_id, id_col, text_col).select("number", "doc_id", "piece", "start", "length", *kept), "pieces")
    # An item is a short piece; a document has one at most, its first.
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // items_per_group))
    items = short.select(F.col("number").alias("item"), F.col("length").alias("size"), F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("grp"))
    rounds = [materialize(_round(items, capacity, 0), "round0")]
    while groups > 1:
        groups = -(-groups // fan_in)
        under = rounds[-1].where(F.col("first") & (F.col("fill") < capacity - slack))
        rank = F.row_number().over(Window.partitionBy("grp").orderBy("fill", "bin"))
        up = under.withColumn("rank", rank).where(F.col("rank") <= fan_in + 1)
        up = up.select(F.col("bin").alias("item"), F.col("fill").alias("size"), F.floor(F.col("grp") / fan_in).cast("int").alias("grp"))
        rounds.append(materialize(_round(up, capacity, len(rounds)), f"round{len(rounds)}"))
    # Follow each bin that went up to the bin it became, adding the places.
    where = rounds[0].select("item", "bin", "place")
    moved = None
    for table in reversed(rounds[1:]):
        here = table.select("item", "bin", "place")
        moved = here if moved is None else _followed(here, moved)
    if moved is not None:
        where = _followed(where, moved)
    columns = ["number", "doc_id", "piece", "start", "length", *payload]
    placed = short.join(where, short["number"] == where["item"]).select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    # A full piece is a sequence of its own, numbered apart from the bins.
    full = pieces.where(F.col("length") >= capacity).select(*columns, (-F.col("number") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
