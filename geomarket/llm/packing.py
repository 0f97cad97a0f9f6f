"""Packing documents into as few token sequences of a fixed length as possible.

A configuration is a multiset of lengths that fits a sequence. The fractional cover of
the length histogram by configurations is found by multiplicative weights: lengths that
are covered too little gain price, and the best configuration at the current prices is
a knapsack, solved by dynamic programming. Uses are rounded down to whole sequences,
the next round covers what is left, and what the rounds leave is filled best fit
first. The histogram has at most as many entries as a sequence has tokens and the plan
so many configurations for each of them, so only small tables reach the driver, whatever
the number of documents. Spark numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomarket.llm.tables import written
from geomarket.llm.tasks import fields, process_state, rows_from
from geomarket.llm.words import Chunk, byte_class, chunks

CAPACITY = 4096
# Rounds of the cover, a knapsack each, and how fast prices fall with what is covered.
ROUNDS, RATE = 24, 1.0
# Different words whose ids a worker keeps, at most; more only saves time.
REMEMBERED = 200_000
# Bytes of text whose words are looked up together.
TOGETHER = 3 << 20
# Words that the tokenizer gets in one call.
BLOCK = 5_000
# Pieces of one length that are numbered in one task.
NUMBERED = 100_000


# Tokens ---------------------------------------------------------------------------------------

# Without the characters of special tokens.
_MARK = byte_class(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")
# Words that normalising leaves as they are.
_SMALL_WORD = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
# Marks at the end of a chunk that are split off together, at most.
_MARKS = 16


class Pieces(NamedTuple):
    """What stands between spaces, marks after its last letter being a piece of their own."""

    kind: pa.Array  # the different pieces; a word of letters with its A-Z in lower case
    which: np.ndarray  # the kind of each piece
    first: np.ndarray  # of each text its first piece, and the number of pieces


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are A-Z or a-z."""
    return (data | np.uint8(0x20)) - np.uint8(97) < 26


def _ends_in_letter(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the last character is a letter below U+0250 whose small form is one letter."""
    last, before = data[end - 1], data[np.maximum(end - 2, 0)]
    two = (end - start >= 2) & (before >= 0xC3) & (before <= 0xC8) & (last >= 0x80) & (last < 0xC0)
    sign = (before == 0xC3) & ((last == 0x97) | (last == 0xB7))
    dotted = (before == 0xC4) & (last == 0xB0)
    return _letters(last) | (two & ~sign & ~dotted)


def _piece_of(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, at.astype(edges.dtype), side="right") - 1


def split(chunk: Chunk) -> Pieces:
    """The pieces of the texts; a line break parts words just as a space does."""
    data, offsets = chunk.data, chunk.offsets
    inside = (data != 0x20) & (data != 0x0A)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    begins = inside & ~before
    start, end = np.flatnonzero(begins).astype(np.int32), np.flatnonzero(inside & ~after).astype(np.int32) + 1
    del before, after
    cut = end.copy()
    marked = np.arange(len(end), dtype=np.int32)
    for _ in range(_MARKS):
        marked = marked[_MARK[data[cut[marked] - 1]]]
        cut[marked] -= 1
        marked = marked[cut[marked] > start[marked]]
    some = np.flatnonzero((cut > start) & (cut < end))
    some = some[_ends_in_letter(data, start[some], cut[some])]
    begins[cut[some]] = True
    del start, end, cut, marked, some
    # Without the spaces the pieces follow each other, as the strings of an Arrow array do.
    begin, kept = np.flatnonzero(begins), data[inside]
    edges = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    plain = np.ones(len(begin), dtype=bool)
    plain[_piece_of(edges, np.flatnonzero(~_letters(kept) & (kept < 0x80)))] = False
    upper = np.flatnonzero(kept - np.uint8(65) < 26)
    kept[upper[plain[_piece_of(edges, upper)]]] += np.uint8(32)
    encoded = pa.StringArray.from_buffers(
        len(begin), pa.py_buffer(edges), pa.py_buffer(kept)).dictionary_encode()
    return Pieces(encoded.dictionary, encoded.indices.to_numpy(), np.searchsorted(begin, offsets))


class ChunkTokenizer:
    """Ids of texts, put together from the ids of what stands between spaces; each different word is encoded once.

    Only for tokenizers that never look across a space, as ``__init__`` tests on examples.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that normalising and splitting leave as they are; a mark ends each word.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Arrow arrays take a small part of what a dictionary of as many strings takes.
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        probe = "Ab cd, é 12!\nEf <|endoftext|> 's x, Yz?! é... a'll İ. ñ'!"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        if b"".join(self.ids([probe])) != np.array(whole, dtype="<u4").tobytes():
            raise ValueError("this tokenizer looks across spaces")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, from one call for all: offsets tell whose an id is."""
        encoded = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4")
        offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        starts = np.cumsum([0] + [len(c) + 1 for c in chunks])
        cuts = (4 * np.searchsorted(offsets, starts)).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _encode_words(self, chosen: pa.Array) -> pa.Array:
        """The same for words of small letters."""
        listed = pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen)
        joined = pc.binary_join(listed, " ")[0].as_py()
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.append(0, 4 * np.flatnonzero(self.ends_word[ids]) + 4).astype(np.int64)
        if len(cuts) != len(chosen) + 1:
            return pa.array(self._encode(chosen.to_pylist()), pa.large_binary())
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(chosen), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def _encode_others(self, pieces: list[str]) -> pa.Array:
        """The same for pieces of any kind; of words in capitals the small form is encoded."""
        forms = []
        for piece in pieces:
            # Letters below U+0250 have one small form.
            word = piece.lower()
            forms.append(word if word.isalpha() and max(word) < "\u0250" else piece)
        chosen, known = list(dict.fromkeys(forms)), {}
        for k in range(0, len(chosen), BLOCK):
            known.update(zip(chosen[k:k + BLOCK], self._encode(chosen[k:k + BLOCK]), strict=True))
        return pa.array([known[form] for form in forms], pa.large_binary())

    def _learned(self, new: pa.Array) -> pa.Array:
        """The ids of pieces that are not remembered."""
        small = pc.match_substring_regex(new, _SMALL_WORD).to_numpy(zero_copy_only=False)
        words, others = np.flatnonzero(small), np.flatnonzero(~small)
        made = [self._encode_words(new.take(pa.array(words[k:k + BLOCK]))) for k in range(0, len(words), BLOCK)]
        made.append(self._encode_others(new.take(pa.array(others)).to_pylist()))
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate([words, others]))))

    def chunk_ids(self, chunk: Chunk) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        kind, which, first = split(chunk)
        known = pc.index_in(kind, value_set=self.known)
        missing = known.is_null().to_numpy(zero_copy_only=False)
        place = known.fill_null(0).to_numpy().copy()
        place[missing] = len(self.known) + np.arange(missing.sum())
        ids = pa.concat_arrays([self.known_ids, self._learned(kind.filter(pa.array(missing)))])
        joined = ids.take(pa.array(place[which]))
        self._remember(kind, ids, place)
        _, ends, data = joined.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[first].tolist() if len(joined) else [0] * len(first)
        return [bytes(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def _remember(self, kind: pa.Array, ids: pa.Array, place: np.ndarray) -> None:
        """Keep the pieces seen just now, then those remembered before, the latest first."""
        unseen = np.ones(len(self.known), dtype=bool)
        unseen[place[place < len(unseen)]] = False
        rest = np.flatnonzero(unseen)[:max(0, REMEMBERED - len(kind))]
        self.known = pa.concat_arrays([kind[:REMEMBERED], self.known.take(pa.array(rest))])
        self.known_ids = ids.take(pa.array(np.concatenate([place[:REMEMBERED], rest])))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The same for a list of texts."""
        return [ids for chunk in chunks(pa.array(texts, pa.large_string()), TOGETHER) for ids in self.chunk_ids(chunk)]


def tokenizer(path: str) -> ChunkTokenizer:
    state = process_state("chunk_tokenizers")
    if path not in state:
        state[path] = ChunkTokenizer(path)
    return state[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], dtype="<u4").tobytes()
    out = fields(doc_id="long", piece="int", start="long", length="long", ids_crc32="long")

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk in chunks(batch.column(1), TOGETHER):
                keys = batch.column(0).slice(chunk.first, chunk.rows).to_pylist()
                rows = []
                for key, ids in zip(keys, tokenizer(path).chunk_ids(chunk), strict=True):
                    ids += end
                    for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start:start + 4 * capacity]
                        rows.append((key, number, start // 4, len(part) // 4, zlib.crc32(part)))
                yield dict(zip([f.name for f in out], map(list, zip(*rows, strict=True)), strict=True))

    return rows_from(docs.select("doc_id", "text"), produce, out)


# The plan, on the histogram -------------------------------------------------------------------

def best_configurations(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each length the dearest multiset that holds it and fits, as uses by position in ``lengths``.

    One unbounded knapsack gives the best filling of every room, thus also of the room
    that is left beside each length. Among equals the longest pieces come first.
    """
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    backward, dear = lengths[::-1], prices[::-1]
    for room in range(int(lengths[0]), capacity + 1):
        skipped = len(lengths) - fitting[room]
        worth = value[room - backward[skipped:]] + dear[skipped:]
        best = int(worth.argmax())
        value[room], choice[room] = value[room - 1], -1
        if worth[best] > value[room]:
            value[room], choice[room] = worth[best], fitting[room] - 1 - best
    sizes, chosen = lengths.tolist(), choice.tolist()
    found = []
    for own, size in enumerate(sizes):
        used, room = {own: 1}, capacity - size
        while room > 0:
            if chosen[room] < 0:
                room -= 1
            else:
                used[chosen[room]] = used.get(chosen[room], 0) + 1
                room -= sizes[chosen[room]]
        found.append(used)
    return found


class Plan(NamedTuple):
    """Runs of equal sequences: which lengths each holds, and how often each run is repeated."""

    uses: list[dict[int, int]]
    repeats: list[int]


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """Whole uses of configurations, by multiplicative weights; lowers ``counts`` by what they hold.

    A length's weight falls with the share of it that is covered, so the next knapsack
    prefers what is covered least. Each use takes at most half of its scarcest length.
    """
    wanted = counts.astype(float)
    for _ in range(ROUNDS):
        has = np.flatnonzero(counts > 0)
        if not len(has):
            return
        covered = 1 - counts[has] / wanted[has]
        prices = lengths[has] / capacity * np.exp(-RATE * covered)
        for used in best_configurations(lengths[has], prices, capacity)[::-1]:
            some, each = has[list(used)], np.array(list(used.values()))
            times = int((counts[some] / each).min() / 2)
            if times:
                counts[some] -= times * each
                yield times, dict(zip(lengths[some].tolist(), each.tolist(), strict=True))


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    """Longest first, each where the least room remains; equal sequences are filled together.

    A length changes at most two runs of sequences in part, so the work depends on the
    number of lengths, not of pieces.
    """
    runs: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    has_runs = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, times: int, used: dict[int, int]) -> None:
        if times:
            runs[room].append((times, used))
            has_runs[room] = True

    for length, count in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        while count:
            room = int(has_runs[length:].argmax()) + length
            if has_runs[room]:
                times, used = runs[room].pop()
                has_runs[room] = bool(runs[room])
            else:
                room, times, used = capacity, -(-count // (capacity // length)), {}
            each = room // length
            whole = min(times, count // each)
            put(room - each * length, whole, {**used, length: each})
            count -= whole * each
            times -= whole
            if times and count:  # fewer than fill one more sequence
                put(room - count * length, 1, {**used, length: count})
                times, count = times - 1, 0
            put(room, times, used)
    found = [run for same in runs for run in same]
    return Plan([used for _, used in found], [times for times, _ in found])


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Sequences that hold every length as often as it is counted; ``lengths`` ascend and differ."""
    left = counts.astype(np.int64).copy()
    uses, repeats = [], []
    full = lengths == capacity
    if full.any() and left[full][0]:
        uses.append({capacity: 1})
        repeats.append(int(left[full][0]))
        left[full] = 0
    for times, used in cover(lengths, left, capacity):
        uses.append(used)
        repeats.append(times)
    rest = best_fit(lengths, left, capacity)
    return Plan(uses + rest.uses, repeats + rest.repeats)


def plan_rows(made: Plan) -> pd.DataFrame:
    """One row for each length in each run: which ranks of the length it takes, and where they go."""
    rows, sequence, taken = [], 0, {}
    for used, times in zip(made.uses, made.repeats, strict=True):
        offset = 0
        for length, each in sorted(used.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, first + times * each, each, sequence, offset))
            taken[length] = first + times * each
            offset += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "stop", "each", "sequence", "at"], dtype="int64")


# The job --------------------------------------------------------------------------------------

def numbered(rows: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, in tasks of a bounded size whatever the lengths."""
    most = rows.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    parts = most // NUMBERED + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    by_part = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1)
    return ranked.join(starts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop(
        "part", "base", "nth")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its sequence and place.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is the end token alone; repeated rows are packed each; other columns are ignored.
    An empty table gives no rows.
    """
    # A batch gives one run of texts, also when its last row goes beyond the bound.
    rows = written(pieces(docs, path, capacity, end_id), "pieces", arrow_bytes=TOGETHER * 15 // 16)
    histogram = rows.groupBy("length").count().orderBy("length").toPandas()
    made = plan_rows(plan(histogram["length"].to_numpy(), histogram["count"].to_numpy(), capacity))
    table = rows.sparkSession.createDataFrame(
        made, "length long, first long, stop long, each long, sequence long, at long")
    ranked = numbered(rows)
    # Ranks are cut into slices so that a length with many runs is not compared with all of them.
    width = F.lit(max(1, int(histogram["count"].max() // 4096)) if len(histogram) else 1)
    table = table.withColumn("slice", F.explode(F.sequence(F.floor(F.col("first") / width),
                                                           F.floor((F.col("stop") - 1) / width))))
    ranked = ranked.withColumn("slice", F.floor(F.col("rank") / width))
    # At most ROUNDS runs for each length, and what is filled best fit.
    placed = ranked.join(F.broadcast(table), ["length", "slice"]).where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"))
