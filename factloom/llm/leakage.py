"""Evaluation passages in a corpus, by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``run`` consecutive words of the evaluation items. A shift table
by block of two words tells how far the search may move without missing a pattern; where it
says 0, the suffix bucket of the block lists the places in the items that end with it, by their
prefix (the first two words of the run), and a direct comparison of the run confirms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = re.compile(r"-(?:\r\n|\n|\r)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case, words broken at a line end rejoined."""
    return _WORD.findall(_BREAK.sub("", text).lower())


class Patterns:
    """Shift table and suffix buckets of a set of items."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run, self.ids = run, {}
        self.texts: list[tuple[int, list[int]]] = []
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text or "")]
            if len(w) >= run:
                self.texts.append((item, w))
        self.base = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        # by block and prefix in one number: a place (text and end in one number) or a list of places
        self.bucket: dict[int, int | list[int]] = {}
        for at, (_, w) in enumerate(self.texts):
            # distance from a block to the end of the nearest pattern that holds it
            for end in range(1, len(w)):
                block = w[end - 1] * self.base + w[end]
                nearest = max(0, run - 1 - end)
                self.shift[block] = min(self.shift.get(block, run), nearest)
                if end >= run - 1:
                    key = (block * self.base + w[end - run + 1]) * self.base + w[end - run + 2]
                    there = self.bucket.setdefault(key, place := at << 32 | end)
                    if isinstance(there, list):
                        there.append(place)
                    elif there != place:
                        self.bucket[key] = [there, place]

    def items_in(self, text: str) -> set[int]:
        known, shift, bucket, base, run = self.ids, self.shift, self.bucket, self.base, self.run
        w = [known.get(x, 0) for x in words(text)]
        found: set[int] = set()
        at, n, most = run - 1, len(w), run - 1
        while at < n:
            b = w[at]
            if not b:
                at += run
                continue
            a = w[at - 1]
            if not a:
                at += most
                continue
            block = a * base + b
            step = shift.get(block, most)
            if step:
                at += step
                continue
            here = None
            places = bucket.get((block * base + w[at - run + 1]) * base + w[at - run + 2])
            for place in () if places is None else places if isinstance(places, list) else (places,):
                end = place & 0xFFFFFFFF
                item, p = self.texts[place >> 32]
                if item not in found:
                    here = here or w[at - run + 1 : at + 1]
                    if p[end - run + 1 : end + 1] == here:
                        found.add(item)
            at += 1
        return found


def _search(patterns: Patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    found = patterns.items_in(text)
                    docs += [doc] * len(found)
                    items += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, run: int = 15, block_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id`` for every document that holds at least ``run`` consecutive words of an item.

    The corpus is only scanned, never shuffled. The items' tables are held by every task; items
    of more than ``block_chars`` characters in all are searched in several scans, each with the
    tables of one block of items, so that a task's memory has a bound
    (measured: see README).

    Defined results: null and empty texts hold nothing; an item of fewer than ``run`` words is
    never found; repeated documents or items give repeated rows per document only; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    there = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    total = there.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for block in range(blocks):
        mine = there if blocks == 1 else there.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        patterns = Patterns([tuple(r) for r in mine.collect()], run)
        hits = texts.mapInArrow(_search(patterns), "doc_id bigint, item_id bigint")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint")


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, suite, n_documents``: every test item that leaked, and into how many documents."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents")).join(items.select("item_id", "suite"), "item_id")
