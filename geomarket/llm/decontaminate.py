"""Benchmark passages in documents: found through a broadcast set of hashed word windows, then verified word by word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tasks import field, with_columns
from geomarket.llm.words import ALPHANUMERIC, Chunk, Words, chunks, windows, words

# Benchmark text that is broadcast at once. A larger benchmark is taken in several blocks.
BLOCK_BYTES = 16 << 20
_BITMAP_BITS = 22


class WindowSet:
    """The windows of benchmark items, by width: hashes for the search, words for the proof."""

    def __init__(self, items: Iterable[tuple[str, str]], width: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        hashes: dict[int, list[np.ndarray]] = defaultdict(list)
        for name, text in items:
            chunk = next(chunks(pa.array([text])))
            found = words(chunk, ALPHANUMERIC)
            size = min(width, len(found.start))
            if size:
                first, hashed = windows(found, size)
                hashes[size].append(hashed)
                for k in first.tolist():
                    self.items[spelled(chunk, found, k, size)].add(name)
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in hashes.items()}
        self.bitmaps = {}
        for size, known in self.hashes.items():
            self.bitmaps[size] = np.zeros(1 << _BITMAP_BITS, dtype=bool)
            self.bitmaps[size][known >> np.uint64(64 - _BITMAP_BITS)] = True

    def hits(self, chunk: Chunk, found: Words) -> Iterable[tuple[int, int, set[str]]]:
        """Verified windows: first word, number of words, items."""
        for size, known in self.hashes.items():
            first, hashed = windows(found, size)
            maybe = np.flatnonzero(self.bitmaps[size][hashed >> np.uint64(64 - _BITMAP_BITS)])
            at = np.minimum(np.searchsorted(known, hashed[maybe]), len(known) - 1)
            for k in first[maybe[known[at] == hashed[maybe]]].tolist():
                items = self.items.get(spelled(chunk, found, k, size))
                if items:
                    yield k, size, items


def spelled(chunk: Chunk, found: Words, first: int, size: int) -> bytes:
    """The words of a window in lower case; no word holds a space."""
    part = range(first, first + size)
    return b" ".join(chunk.data[found.start[k]:found.end[k]].tobytes().lower() for k in part)


def scan(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """Add ``n_words``, ``hit_words`` (places of hit words, ascending) and ``item_ids`` (sorted as strings).

    A null or empty text has no words and no hits; an item without words has no window;
    an item without an id is named by the empty string. Repeated items count once,
    repeated rows are judged each. Columns of the three names are replaced.
    """
    held = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    size = held.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    context = docs.sparkSession.sparkContext
    found = docs.withColumn("hit_words", F.array().cast("array<int>")).withColumn(
        "item_ids", F.array().cast("array<string>"))
    for number in range(blocks):
        block = held.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == number)
        rows = [(r.name_, r.words) for r in block.withColumnRenamed("name", "name_").collect()]
        found = found.withColumnsRenamed({"hit_words": "hit_words_before", "item_ids": "item_ids_before"})
        found = _scan_block(found, context.broadcast(rows), width, text).drop("hit_words_before", "item_ids_before")
    return found


def _scan_block(docs: DataFrame, rows, width: int, text: str) -> DataFrame:
    made: list[WindowSet] = []

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not made:
            made.append(WindowSet(rows.value, width))
        known = made[0]
        names = batch.schema.names
        hit = batch.column(names.index("hit_words_before")).to_pylist()
        item_ids = batch.column(names.index("item_ids_before")).to_pylist()
        n_words = np.zeros(len(batch), dtype=np.int64)
        for chunk in chunks(batch.column(names.index(text))):
            found = words(chunk, ALPHANUMERIC)
            counts = np.bincount(found.row, minlength=chunk.rows)
            n_words[chunk.first:chunk.first + chunk.rows] = counts
            begins = np.cumsum(counts) - counts
            places, named = defaultdict(set), defaultdict(set)
            for first, size, items in known.hits(chunk, found):
                row = int(found.row[first])
                places[row].update(range(first - int(begins[row]), first - int(begins[row]) + size))
                named[row].update(items)
            for row in places:
                hit[chunk.first + row] = sorted(places[row].union(hit[chunk.first + row]))
                item_ids[chunk.first + row] = sorted(named[row].union(item_ids[chunk.first + row]))
        return {"n_words": pa.array(n_words), "hit_words": pa.array(hit, pa.list_(pa.int32())),
                "item_ids": pa.array(item_ids, pa.list_(pa.string()))}

    return with_columns(docs, compute, [field("n_words", "long"), field("hit_words", "ints"),
                                        field("item_ids", "strings")])


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    mine = docs.select(F.struct("*").alias("document"), F.col("text").alias("text"))
    kept = scan(mine, items, width).where(F.size("hit_words") == 0)
    return kept.select([F.col("document").getField(c).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """All documents, with each run of hit words and what stands between them cut out of the text."""
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names = batch.schema.names
        texts, hits = batch.column(names.index("text")), batch.column(names.index("hit_words")).to_pylist()
        clean = texts.to_pylist()
        for chunk in chunks(texts):
            found = words(chunk, ALPHANUMERIC)
            begins = np.searchsorted(found.row, np.arange(chunk.rows))
            for row in range(chunk.rows):
                if not hits[chunk.first + row]:
                    continue
                places = np.array(hits[chunk.first + row])
                parts, at = [], int(chunk.offsets[row])
                for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    parts.append(chunk.data[at:found.start[begins[row] + run[0]]].tobytes())
                    at = int(found.end[begins[row] + run[-1]])
                parts.append(chunk.data[at:chunk.offsets[row + 1]].tobytes())
                clean[chunk.first + row] = b"".join(parts).decode()
        return {"clean_text": pa.array(clean, pa.string())}

    mine = docs.select(F.struct("*").alias("document"), F.col("text").alias("text"))
    done = with_columns(scan(mine, items, width), compute, [field("clean_text", "string")])
    return done.select([
        F.col("clean_text").alias(c) if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns])


def judge_documents(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), items, width)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
