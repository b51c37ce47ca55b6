"""Language-model scoring with an Elias-Fano n-gram trie.

Model: absolute discounting over all n-grams of the training texts, those that occur
once too, interpolated with the next lower order, down to unigrams with one added
count; probabilities sum to one.

Building, from the training texts:

1. Words are hashed and counted (map-side in NumPy, then by Spark).  The distinct words
   in the order of their hashes are level one; a word's id is its rank.
2. Texts become id sequences, written once; each ends in the end token.
3. Nodes of an order are numbered in the order of (context node, word).  For the next
   order, that number line is cut into shards by what the nodes before it counted: a shard
   gets the n-grams of at most ``shard_tokens`` places of the texts, and a context that
   has more by itself is cut by the word that follows.  So no shard grows with a common word.
4. Each batch of texts emits its distinct (context node, word) with their counts, sorted,
   as blobs of a few thousand each; a shard's blobs are merged and written as a level:
   the words in a fixed number of bits, monotone Elias-Fano pointers from contexts to
   their first child, discounted log-probabilities of the nodes in 8 bits and the share
   that contexts leave to the lower order in 16 bits.  Shards are files in the shared
   folder, committed by the table that lists them.

Scoring maps a shard's files into memory where the folder is mounted (an object store
is read into memory, a shard at a time), and finds a word among the children of its
context by successor search between two pointers, for all tokens of a batch at once.
The lower orders' probabilities of a token, which interpolation adds, are at hand then.

The driver holds a file name and a few numbers for each shard.  Ids have 32 bits: more
than 2**31 distinct words are an error.

Nulls, empties, repeats: a null or empty text is the end token alone.  Rows that repeat
an id are scored and counted each.  A row without id is scored; it is held out only if
``held`` says so, and null is no.  A text of any length is counted and scored whole.
Without any training text every token has probability one over one word.  Empty tables
give empty results; further columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.scratch import drop, file_system, materialize, new_dir

END = np.uint64(0x0123456789ABCDEF)
_STEP = 1 / 24  # of quantised log10 probabilities: 8 bits reach -10.6
_FINE = 1 / 4096  # of the shares left to lower orders: 16 bits reach -16


# Elias-Fano


_SELECT = np.zeros((256, 8), np.uint8)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_at)] = _at


@dataclass
class Monotone:
    """A non-decreasing sequence: low bits packed, high bits unary with a count for each 64 bits."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def encode(values: np.ndarray, top: int) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(np.floor(np.log2(max(top, 1) / max(n, 1))))) if n else 0
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(place[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(_ONES[high].reshape(-1, 8).sum(axis=1))]).astype("<u4")
        low = pack(values & np.uint64((1 << bits) - 1), bits)
        head = np.array([n, bits, len(low), len(high), len(ranks)], "<i8")
        return head.tobytes() + ranks.tobytes() + high.tobytes() + low.tobytes()

    @classmethod
    def decode(cls, data: np.ndarray) -> Monotone:
        n, bits, low, high, ranks = data[:40].view("<i8").tolist()
        a, b = 40 + 4 * ranks, 40 + 4 * ranks + high
        return cls(n, bits, data[b : b + low], data[a:b], data[40:a].view("<u4"))

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: the place of the i-th one less i, then the low bits."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        left = (i - self.ranks[word]).astype(np.uint8)
        ones = np.cumsum(_ONES[self.high.reshape(-1, 8)[word]], axis=1, dtype=np.uint8)  # up to each byte of the word
        byte = (ones <= left[:, None]).sum(axis=1)
        left -= np.where(byte > 0, ones[np.arange(len(i)), np.maximum(byte - 1, 0)], 0).astype(np.uint8)
        place = word * 64 + byte * 8 + _SELECT[self.high[word * 8 + byte], left]
        return ((place - i) << self.low_bits) | unpack(self.low, self.low_bits, i)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values in ``bits`` bits each, little-endian, with spare bytes for whole-word reads."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    places, parts = np.arange(bits, dtype=np.uint64), []
    for lo in range(0, len(values), 1 << 15):  # whole bytes each time
        spread = ((values[lo : lo + (1 << 15), None] >> places) & np.uint64(1)).astype(np.uint8)
        parts.append(np.packbits(spread.ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def unpack(data: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    """The i-th packed values (of at most 56 bits)."""
    if not bits:
        return np.zeros(len(i), np.int64)
    at = i * bits
    words = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


# Levels


def _quantise(log10: np.ndarray, step: float, kind: str) -> np.ndarray:
    return np.clip(np.round(-log10 / step), 0, np.iinfo(kind).max).astype(kind)


_P = 10.0 ** (-_STEP * np.arange(1 << 8))
_W = 10.0 ** (-_FINE * np.arange(1 << 16))


def level_bytes(context: np.ndarray, word: np.ndarray, p: np.ndarray, left: np.ndarray, bits: int) -> bytes:
    """A shard's level; ``context`` (0..len(left)-1) and, within it, ``word`` ascend."""
    pointers = Monotone.encode(np.searchsorted(context, np.arange(len(left) + 1)), len(context))
    head = np.array([len(word), len(left), bits, len(pointers)], "<i8").tobytes()
    codes = _quantise(np.log10(left), _FINE, "<u2").tobytes(), _quantise(np.log10(p), _STEP, "u1").tobytes()
    return b"".join([head, pointers, bytes(-len(pointers) % 8), *codes, pack(word.astype(np.uint64), bits).tobytes()])


class Level:
    """A mapped level: children of contexts, by successor search."""

    def __init__(self, data: np.ndarray):
        self.n, contexts, self.bits, pointers = data[:32].view("<i8").tolist()
        self.pointers = Monotone.decode(data[32 : 32 + pointers])
        at = 32 + pointers + (-pointers % 8)
        self.left, self.p = data[at : at + 2 * contexts].view("<u2"), data[at + 2 * contexts : at + 2 * contexts + self.n]
        self.ids = data[at + 2 * contexts + self.n :]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of each (context, word), -1 where there is none; contexts ascend."""
        out = np.full(len(context), -1, np.int64)
        if not len(context):
            return out
        new = np.r_[True, context[1:] != context[:-1]]
        some, group = context[new], np.cumsum(new) - 1
        lo, hi = self.pointers.at(some)[group], self.pointers.at(some + 1)[group]
        only = np.flatnonzero(hi - lo == 1)  # most contexts have one child
        same = only[unpack(self.ids, self.bits, lo[only]) == word[only]]
        out[same] = lo[same]
        # Ids are ranks of hashes, so a context's children lie evenly: look where a word
        # should be, and halve now and then in case it isn't so.
        live = np.flatnonzero(hi - lo > 1)
        lo, hi, want = lo[live], hi[live], word[live]
        below, above, turn = np.zeros(len(live), np.int64), np.full(len(live), 1 << self.bits, np.int64), 0
        while len(live):
            turn += 1
            if turn % 4:
                mid = lo + ((hi - lo) * ((want - below) / (above - below))).astype(np.int64)
                np.minimum(mid, hi - 1, out=mid)
            else:
                mid = (lo + hi) >> 1
            got = unpack(self.ids, self.bits, mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            less = got < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            below, above = np.where(less, got + 1, below), np.where(less, above, got)
            go = np.flatnonzero(~hit & (lo < hi) & (want >= below) & (want < above))
            live, lo, hi, want, below, above = live[go], lo[go], hi[go], want[go], below[go], above[go]
        return out


@lru_cache(maxsize=4096)
def _mapped(inner: str) -> np.ndarray:
    with pa.memory_map(inner) as source:
        return np.frombuffer(source.read_buffer(), np.uint8)


@lru_cache(maxsize=16)
def _fetched(path: str) -> np.ndarray:
    store, inner = file_system(path)
    with store.open_input_file(inner) as source:
        return np.frombuffer(source.read_buffer(), np.uint8)


def mapped(path: str) -> np.ndarray:
    """A file as bytes: mapped where it is on a mounted file system, else read (and a few are kept)."""
    store, inner = file_system(path)
    return _mapped(inner) if isinstance(store, pa.fs.LocalFileSystem) else _fetched(path)


def _write(path: str, data: bytes) -> str:
    """A file with a name of its own, so that attempts don't meet."""
    store, base = file_system(path)
    store.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return f"{path}/{name}"


def distinct(context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct pairs: contexts, words, which of them each pair is, and how often each occurs."""
    if len(context) and int(context.max()).bit_length() + bits < 63:
        pair, back, n = np.unique(context << bits | word, return_inverse=True, return_counts=True)
        return pair >> bits, pair & ((1 << bits) - 1), back, n
    by = np.lexsort((word, context))
    c, w = context[by], word[by]
    new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])] if len(by) else np.zeros(0, bool)
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new) - 1
    return c[new], w[new], back, np.bincount(back, minlength=int(new.sum()))


def cut_points(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where to cut a line of nodes so that what is between two cuts counts about ``most`` at most.

    Node, part and parts of each cut: a node that counts more by itself is cut in parts.
    """
    big = counts > most
    before = np.cumsum(np.where(big, 0, counts)) - np.where(big, 0, counts)
    turn = before // most
    cut = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]) | big[1:] | big[:-1]])
    parts = np.where(big[cut], -(-counts[cut] // most), 1)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(cut, parts), part, np.repeat(parts, parts)


@dataclass
class Order:
    """An order's shards: shard s has the pairs from (context[s], word[s]) up to the next one's."""

    context: np.ndarray
    word: np.ndarray
    total: np.ndarray  # of the context, where it is cut into several shards, else 0
    contexts: int  # nodes of the order below
    files: list[str | None] = field(default_factory=list)
    first: np.ndarray | None = None  # number of each shard's first node, and of all nodes
    whole: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))  # contexts that are cut, what they leave

    def __post_init__(self):
        self.some, rank = np.unique(self.context, return_inverse=True)
        self.line = (rank * 2 + 1) << 32 | self.word

    def shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.searchsorted(self.some, context)
        same = self.some[np.minimum(rank, len(self.some) - 1)] == context
        return np.searchsorted(self.line, np.where(same, (rank * 2 + 1) << 32 | word, (rank * 2) << 32), side="right") - 1

    def size(self, shard: int) -> int:
        """How many contexts a shard has."""
        if shard + 1 == len(self.context):
            return self.contexts - int(self.context[shard])
        return int(self.context[shard + 1] - self.context[shard]) + int(self.word[shard + 1] > 0)


@dataclass
class Trie:
    """What is broadcast: file names and first ids of shards, and totals."""

    words: list[tuple[int, str, int]] = field(default_factory=list)  # first hash, file, first id
    orders: list[Order] = field(default_factory=list)  # from 2
    tokens: int = 0
    vocabulary: int = 0

    @property
    def bits(self) -> int:
        """Of a word; the vocabulary's size itself stands for an unknown one."""
        return max(1, self.vocabulary.bit_length())

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if unknown) and counts of hashes."""
        some, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int64)
        starts = np.array([w[0] for w in self.words], np.uint64)
        edges = [*np.searchsorted(some, starts).tolist(), len(some)]
        for k, (_, file, first) in enumerate(self.words):
            mine = np.arange(edges[k], edges[k + 1])
            if not len(mine):
                continue
            data = mapped(file)
            n = int(data[:8].view("<i8")[0])
            own, count = data[8 : 8 + 8 * n].view("<u8"), data[8 + 8 * n : 8 + 16 * n].view("<i8")
            at = np.minimum(np.searchsorted(own, some[mine]), n - 1)
            hit = own[at] == some[mine]
            ids[mine[hit]], counts[mine[hit]] = at[hit] + first, count[at[hit]]
        return ids[back], counts[back]

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; 0 for -1."""
        some, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(some), np.int64)
        edges = np.searchsorted(some, [*(w[2] for w in self.words), self.vocabulary])
        for k in np.flatnonzero(np.diff(edges)).tolist():
            data = mapped(self.words[k][1])
            n = int(data[:8].view("<i8")[0])
            out[edges[k] : edges[k + 1]] = data[8 + 8 * n : 8 + 16 * n].view("<i8")[some[edges[k] : edges[k + 1]] - self.words[k][2]]
        return out[back]

    def look_up(self, order: Order, context: np.ndarray, word: np.ndarray, scores: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Node (-1 where absent), discounted probability (0 there) and what the context leaves to the lower order (1 without one)."""
        node = np.full(len(context), -1, np.int64)
        p, left = (np.zeros(len(context)), np.ones(len(context))) if scores else (None, None)
        able = np.flatnonzero(context >= 0 if scores else (context >= 0) & (word >= 0))
        if not len(able):
            return node, p, left
        c, w, back, _ = distinct(context[able], np.where(word[able] < 0, self.vocabulary, word[able]), self.bits)
        shard = order.shard(c, w)
        nodes, ps, lefts = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.ones(len(c))
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(c)], strict=True):
            s = int(shard[a])
            if order.files[s] is None:
                continue
            level, local = Level(mapped(order.files[s])), c[a:z] - order.context[s]
            own = level.find(local, w[a:z])
            hit = own >= 0
            nodes[a:z] = np.where(hit, own + order.first[s], -1)
            if scores:
                ps[a:z][hit] = _P[level.p[own[hit]]]
                lefts[a:z] = _W[level.left[local]]
        node[able] = nodes[back]
        if scores:
            if len(order.whole[0]):
                at = np.minimum(np.searchsorted(order.whole[0], c), len(order.whole[0]) - 1)
                lefts = np.where(order.whole[0][at] == c, order.whole[1][at], lefts)
            p[able], left[able] = ps[back], lefts[back]
        return node, p, left

    def walk(self, ids: np.ndarray, before: np.ndarray, order: int, scores: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """``look_up`` of the n-grams that end at each token, for orders 2 to ``order``.

        ``before`` is how many tokens of the same text stand before each token.
        """
        node = ids
        for k in range(2, order + 1):
            context = np.r_[-1, node[:-1]]
            context[before < k - 1] = -1
            node, p, left = self.look_up(self.orders[k - 2], context, ids, scores)
            yield node, p, left

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.vocabulary + 1)))

    def log_probabilities(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the tokens before it."""
        out = 10.0 ** self.unigram(self.counts_of(ids))
        for _, p, left in self.walk(ids, before, len(self.orders) + 1, True):
            out = p + left * out
        return np.log10(out)


# Building


def _tokens(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi, hashes of their tokens with the end token, offsets of the texts in them."""
    for lo, hi, raw, offsets in W.text_chunks(batch.column(column)):
        h, _, _, first = W.words(raw, offsets)
        at = first + np.arange(len(first))
        out = np.empty(len(h) + hi - lo, np.uint64)
        out[at[1:] - 1] = END
        mask = np.ones(len(out), bool)
        mask[at[1:] - 1] = False
        out[mask] = h
        yield lo, hi, out, at


def count_words(docs: DataFrame) -> DataFrame:
    """h, n of the tokens of (train, text) rows that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.gathered(batches, 4000):
            train = batch.filter(batch.column(0))
            parts = [h for _, _, h, _ in _tokens(train, 1)]
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.mapInArrow(W.lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


_CUTS = "cut array<struct<node:long,part:long,parts:long,total:long>>"


def _cuts(counts: np.ndarray, most: int) -> list[dict]:
    node, part, parts = cut_points(counts, most)
    total = np.where(parts > 1, counts[node], 0)
    return [{"node": a, "part": b, "parts": c, "total": d} for a, b, c, d in zip(node.tolist(), part.tolist(), parts.tolist(), total.tolist(), strict=True)]


def _next_order(listed: list, first: list[int], nodes: int, vocabulary: int) -> Order:
    """The shards of the next order from the cuts that the shards of this one listed."""
    cuts = [(a + c.node, c.part * vocabulary // c.parts, c.total) for r, a in zip(listed, first, strict=True) for c in r.cut]
    columns = [np.array(x, np.int64) for x in zip(*cuts, strict=True)] if cuts else [np.zeros(1, np.int64)] * 3
    return Order(*columns, nodes)


def _write_words(counts: DataFrame, directory: str, shards: int, most: int) -> list:
    """part, first hash, file, words, tokens and cuts of each shard of level one, in order."""
    # Unsigned order of the hash: its leading bits choose the shard.
    bits = max(1, (shards - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        parts, h, n = (np.concatenate(x) for x in zip(*got, strict=True))
        h = h.view(np.uint64)
        by = np.argsort(h)
        parts, h, n = parts[by], h[by], n[by]
        for p in np.unique(parts).tolist():
            own, count = h[parts == p], n[parts == p]
            file = _write(directory, np.array([len(own)], "<i8").tobytes() + own.tobytes() + count.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": p, "low": int(own[0]) - 2**63, "file": file, "words": len(own), "tokens": int(count.sum()), "cut": _cuts(count, most)}])

    dealt = counts.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("part"), "h", "n").repartition("part")
    table = materialize(dealt.mapInArrow(W.lean(run), f"part long, low long, file string, words long, tokens long, {_CUTS}"), "words")
    listed = table.orderBy("part").collect()  # a row a shard
    drop(table)
    return listed


def _ids_table(docs: DataFrame, trie) -> DataFrame:
    """id, train, base, known, and ids (32-bit, little-endian; -1 for an unknown word) of the tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value
        for batch in W.slices(batches):
            for lo, hi, h, at in _tokens(batch, 2):
                ids, counts = own.word_ids(h)
                base = np.add.reduceat(own.unigram(counts), at[:-1])
                known = np.add.reduceat((counts > 0).astype(np.int64), at[:-1])
                blobs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(base), pa.array(known), blobs], names=["id", "train", "base", "known", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(W.lean(run), f"id {kind}, train boolean, base double, known long, ids binary")


def _flat(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo..hi of 32-bit ids, the ids end to end, offsets, and how many tokens of the text stand before each."""
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    values = np.frombuffer(data, "<i4", count=int(offsets[-1])) if data is not None else np.zeros(0, "<i4")
    lo = 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1))
        at = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        ids = values[offsets[lo] : offsets[hi]].astype(np.int64)
        yield lo, hi, ids, at, np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
        lo = hi


_BLOB = 4096


def _blob(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and their counts: differences, byte by byte of all, which compresses well."""
    steps = np.diff(keys, prepend=0).astype("<u8")
    return b"".join(x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (steps, n.astype("<u4")))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    n = len(raw) // 12
    keys, counts = raw[: 8 * n].reshape(8, n), raw[8 * n :].reshape(4, n)
    return np.cumsum(np.ascontiguousarray(keys.T).view("<u8").ravel().astype(np.int64)), np.ascontiguousarray(counts.T).view("<u4").ravel().astype(np.int64)


def count_ngrams(ids: DataFrame, trie, order: int) -> DataFrame:
    """shard, blob of the distinct n-grams of each batch of training texts; a key is the context's place in the shard and the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value
        level = own.orders[order - 2]
        for batch in W.gathered(batches, 4000):
            for _, _, tokens, _, before in _flat(batch.column(0), 2_000_000):
                nodes = tokens
                for nodes, _, _ in own.walk(tokens, before, order - 1, False):
                    pass
                at = np.flatnonzero(before >= order - 1)
                context, word, _, n = distinct(nodes[at - 1], tokens[at], own.bits)
                if not len(n):
                    continue
                shard = level.shard(context, word)
                keys = (context - level.context[shard]) << 32 | word
                edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                spans = [(int(shard[a]), b, min(b + _BLOB, z)) for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(n)], strict=True) for b in range(a, z, _BLOB)]
                for lo in range(0, len(spans), 200):
                    part = spans[lo : lo + 200]
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in part], pa.int32()), pa.array([_blob(keys[a:z], n[a:z]) for _, a, z in part], pa.binary())], names=["shard", "blob"])

    return ids.where("train").select("ids").mapInArrow(W.lean(run), "shard int, blob binary")


def _write_order(blobs: DataFrame, directory: str, trie, order: int, discount: float, most: int) -> list:
    """shard, file, nodes and cuts of each shard that has nodes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value
        level = own.orders[order - 2]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[new], np.add.reduceat(n[by], new)

        def flush(shard: int) -> pa.RecordBatch:
            keys, n = merge()
            held.clear()
            context, word = keys >> 32, keys & 0xFFFFFFFF
            size = level.size(shard)
            total, kinds = np.bincount(context, weights=n, minlength=size), np.bincount(context, minlength=size)
            if level.total[shard]:  # the only context of this shard has others too
                total[:] = level.total[shard]
            left = np.where(kinds > 0, discount * kinds / np.maximum(total, 1), 1.0)
            file = _write(directory, level_bytes(context, word, (n - discount) / total[context], left, own.bits))
            return pa.RecordBatch.from_pylist([{"shard": shard, "file": file, "nodes": len(n), "cut": _cuts(n, most)}])

        now, rows = None, 0
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and shard != now:
                    yield flush(now)
                    rows = 0
                now = shard
                held.append(_unblob(blob.as_buffer()))
                rows += len(held[-1][0])
                if rows > 4 * most:  # what repeats in the batches of a large input meets early
                    held[:] = [merge()]
                    rows = len(held[0][0])
        if held:
            yield flush(now)

    dealt = blobs.repartition("shard").sortWithinPartitions("shard")
    table = materialize(dealt.mapInArrow(W.lean(run), f"shard long, file string, nodes long, {_CUTS}"), f"order{order}")
    listed = table.orderBy("shard").collect()  # a row a shard
    drop(table)
    return listed


def build(spark: SparkSession, docs: DataFrame, order: int, discount: float, shard_words: int, shard_tokens: int) -> tuple[Trie, DataFrame, str]:
    """The trie of the (id, train, text) rows that train, the table of all rows' token ids, and the folder of the trie's files."""
    directory = new_dir(spark, "trie")
    counts = materialize(count_words(docs.select("train", "text")), "counts")
    trie = Trie()
    trie.vocabulary, trie.tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if trie.vocabulary >= 2**31:
        raise ValueError("word ids have 32 bits: too many distinct words")
    most = max(1, min(shard_tokens, trie.tokens // _LEAST_SHARDS))
    listed = _write_words(counts, directory, max(_LEAST_SHARDS, -(-trie.vocabulary // shard_words)), most)
    drop(counts)
    first = np.cumsum([0, *(r.words for r in listed)]).tolist()
    trie.words = [(r.low + 2**63, r.file, a) for r, a in zip(listed, first, strict=False)]
    ids = materialize(_ids_table(docs, spark.sparkContext.broadcast(trie)), "ids", dictionary=False)
    for k in range(2, order + 1):
        level = _next_order(listed, first[:-1], first[-1], trie.vocabulary)
        trie.orders.append(level)
        shared = spark.sparkContext.broadcast(trie)
        listed = _write_order(count_ngrams(ids, shared, k), directory, shared, k, discount, most)
        nodes = np.zeros(len(level.context), np.int64)
        level.files = [None] * len(nodes)
        for r in listed:
            level.files[r.shard], nodes[r.shard] = r.file, r.nodes
        level.first = np.r_[0, np.cumsum(nodes)]
        cut = np.flatnonzero(level.total > 0)
        some, back = np.unique(level.context[cut], return_inverse=True)
        if len(some):
            kinds, total = np.bincount(back, weights=nodes[cut]), np.zeros(len(some))
            total[back] = level.total[cut]
            level.whole = some, discount * kinds / total
        first = [*level.first[[r.shard for r in listed]].tolist(), int(level.first[-1])]
    return trie, ids, directory


#: So that a small corpus is dealt too.
_LEAST_SHARDS = 64


def lm_scores(
    spark: SparkSession, docs: DataFrame, held: Column, order: int = 3, discount: float = 0.75, shard_words: int = 200_000, shard_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: all texts, learnt from those where ``held`` is not true.

    Any ``order`` from 1 up.
    """
    rows = docs.select(F.col(id_col).alias("id"), (~F.coalesce(held, F.lit(False))).alias("train"), F.col(text_col).alias("text"))
    trie, ids, _ = build(spark, rows, order, discount, shard_words, shard_tokens)
    shared = spark.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in W.gathered(batches, 4000):
            for lo, hi, tokens, at, before in _flat(batch.column(4), 1_000_000):
                score = np.add.reduceat(own.log_probabilities(tokens, before), at[:-1])
                columns = [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(at)), batch.column(3)[lo:hi], batch.column(2)[lo:hi], pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "train", "n_tokens", "known", "base", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = ids.select("id", "train", "base", "known", "ids").mapInArrow(W.lean(run), f"id {kind}, train boolean, n_tokens long, known long, base double, score double")
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(trie.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
