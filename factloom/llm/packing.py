"""Filling containers of fixed capacity: conflict-constrained best-fit.

Texts are measured in tokens map-side and their sizes are written; full parts of long texts fill
a container each and stay where they are. The rest is spread by row over hash shards of bounded
size, which are packed independently. Texts with copies come first, then the others, each in order of
falling size; open containers are kept
by residual, and the successor search from an item's size upwards takes the tightest container
that is compatible. Containers carry a bitmap of their sources and one of the clusters of equal
texts they hold: copies of one text never share a container, nor do sources declared apart.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of the rank file's tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path).encode_ordinary
        task, rows = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(3).to_pylist()]
            names = [f"{task}-{rows + i}" for i in range(len(sizes))]
            rows += len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "source", "cluster", "tokens", "row"])

    return run


def measured(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, cluster, tokens, row``; a cluster is the hash of a text but for case and
    blanks, ``row`` a name of the row that no other has (to be written before it is relied on)."""
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), cluster.alias("cluster"), F.col("text").cast("string"))
    return rows.mapInArrow(_measure(path), "doc_id bigint, source string, cluster bigint, tokens bigint, row string")


class BestFit:
    """Containers of one shard."""

    def __init__(self, capacity: int):
        self.capacity, self.residuals = capacity, 0
        self.open: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.n = 0

    def _put(self, residual: int, marks: tuple[int, int], container: int) -> None:
        self.open.setdefault(residual, {}).setdefault(marks, []).append(container)
        self.residuals |= 1 << residual

    def add(self, size: int, source: int, apart: int, cluster: int) -> int:
        """The container of an item with the bits of its source, of the sources it must stay
        apart from, and of its cluster (0: no copies)."""
        left = self.residuals >> size
        base = size
        while left:
            step = (left & -left).bit_length() - 1
            base += step
            bins = self.open[base]
            for marks, containers in bins.items():
                if not (marks[0] & apart or marks[1] & cluster):
                    container = containers.pop()
                    if not containers:
                        del bins[marks]
                        if not bins:
                            del self.open[base]
                            self.residuals ^= 1 << base
                    if base > size:
                        self._put(base - size, (marks[0] | source, marks[1] | cluster), container)
                    return container
            left >>= step + 1
            base += 1
        self.n += 1
        if self.capacity > size:
            self._put(self.capacity - size, (source, cluster), self.n - 1)
        return self.n - 1


def _pack(capacity: int, apart: Sequence[tuple[str, str]]):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        cols = {c: t.column(c).to_pylist() for c in ("doc_id", "part", "size", "source", "cluster")}
        n = len(cols["size"])
        seen: dict[int, int] = {}
        for c in cols["cluster"]:
            seen[c] = seen.get(c, 0) + 1
        bits: dict[int, int] = {}
        for c, k in seen.items():
            if k > 1 and c is not None:
                bits[c] = 1 << len(bits)
        names = sorted({s for s in cols["source"] if s is not None} | {x for p in apart for x in p})
        flag = {s: 1 << i for i, s in enumerate(names)} | {None: 0}
        away = {s: 0 for s in flag}
        for a, b in apart:
            away[a] |= flag[b]
            away[b] |= flag[a]
        # texts with copies first: late, when few containers are open, they would open new ones
        order = sorted(range(n), key=lambda i: (cols["cluster"][i] not in bits, -cols["size"][i], cols["doc_id"][i] is None, cols["doc_id"][i] or 0, cols["part"][i]))
        bins, where = BestFit(capacity), [0] * n
        for i in order:
            where[i] = bins.add(cols["size"][i], flag[cols["source"][i]], away[cols["source"][i]], bits.get(cols["cluster"][i], 0))
        return pa.table({"doc_id": t.column("doc_id"), "part": t.column("part"), "container_id": pa.array([f"{shard}-{w}" for w in where])})

    return run


def containers(documents: DataFrame, capacity: int = 2_048, path: str = VOCABULARY, apart: Sequence[tuple[str, str]] = (), shard_items: int = 20_000) -> DataFrame:
    """``doc_id, part, n_parts, first_token, n_tokens, container_id``: every document in containers.

    A text is divided only if it is longer than ``capacity``: into full parts, each of which
    fills a container, and a rest that is packed like a text. Shards hold about ``shard_items``
    texts, by a hash of the row, so that neither null nor repeated ids meet in one; the loss
    through shards is a few containers in thousands. ``path`` names the rank file of the
    tokenizer, which every worker has to find there. ``apart`` names pairs of sources that never
    share a container (default: none).

    Defined results: a null or empty text has 0 tokens and a null container; equal texts (but
    for case and blanks) get different containers, also where that costs space; repeated ids
    are packed as often as they occur; an empty table gives no rows.
    """
    # read twice, and its row names must not change between
    m = written(measured(documents, path), "sizes")
    shards = max(1, -(-m.count() // shard_items))
    tokens, part = F.col("tokens"), F.col("part")
    n_parts = F.greatest(F.ceil(tokens / capacity), F.lit(1)).cast("int")
    n_full = F.floor(tokens / capacity).cast("int")
    full = m.filter(tokens >= capacity).select("doc_id", "row", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(0), n_full - 1)).alias("part"))
    full = full.select("doc_id", "part", "n_parts", (part.cast("bigint") * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"), F.concat_ws("-", F.lit("full"), "row", "part").alias("container_id"))
    rest = m.filter((tokens == 0) | (tokens % capacity > 0)).select("doc_id", n_full.alias("part"), n_parts.alias("n_parts"), (tokens % capacity).cast("int").alias("size"), "source", "cluster", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    packed = rest.groupBy("shard").applyInArrow(_rows(capacity, apart), "doc_id bigint, part int, n_parts int, first_token bigint, n_tokens int, container_id string")
    return full.unionByName(packed)


def _rows(capacity: int, apart: Sequence[tuple[str, str]]):
    pack = _pack(capacity, apart)

    def run(t: pa.Table) -> pa.Table:
        there = pc.greater(t.column("size"), 0)
        where = np.full(t.num_rows, None, object)
        if pc.any(there).as_py():
            where[there.to_numpy()] = pack(t.filter(there)).column("container_id").to_pylist()
        first = pc.multiply(t.column("part").cast(pa.int64()), capacity)
        return pa.table({"doc_id": t.column("doc_id"), "part": t.column("part"), "n_parts": t.column("n_parts"), "first_token": first, "n_tokens": t.column("size"), "container_id": pa.array(where, pa.string())})

    return run


def fill(packed: DataFrame, capacity: int = 2_048) -> DataFrame:
    """``containers, tokens, fullest, fill`` of a result of ``containers``."""
    used = packed.filter(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    n = F.count(F.lit(1))
    return used.agg(n.alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (n * capacity), 6).alias("fill"))


def wholeness(packed: DataFrame, capacity: int = 2_048) -> DataFrame:
    """``doc_id, undivided, gapless, placed``: whether a document has one part unless it is longer
    than a container, whether its parts follow each other without gap, and whether all but empty
    ones are in a container."""
    part, n, size = F.col("part"), F.col("n_parts"), F.col("n_tokens")
    per = packed.groupBy("doc_id").agg(
        F.max("n_parts").alias("n"),
        F.sum("n_tokens").alias("tokens"),
        F.count(F.lit(1)).alias("rows"),
        (F.max("part") + 1).alias("parts"),
        F.bool_and((F.col("first_token") == part * capacity) & ((size == capacity) | (part == n - 1)) & (size <= capacity)).alias("in_order"),
        F.bool_and((size == 0) == F.col("container_id").isNull()).alias("placed"),
    )
    return per.select("doc_id", ((F.col("n") == 1) | (F.col("tokens") > capacity)).alias("undivided"), (F.col("in_order") & (F.col("parts") == F.col("n")) & (F.col("rows") % F.col("n") == 0)).alias("gapless"), "placed")
