import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geomarket.llm import packing
from geomarket.llm.tables import ARROW_BYTES

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["a", "B", "é", " ", "  ", "\n", "'s", "12", ".", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "梦", "Σ", "İ", "\x1c",
     "́", " ", "ﬁ", "word"]), max_size=15).map("".join), max_size=5))
def test_ids_are_the_tokenizers(texts):
    plain = Tokenizer.from_file(PATH)
    found = packing.tokenizer(PATH).ids(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["Ab", "É", "ß", "İ", "×", "ǅ", "ɐ", "é", "'", "'S", "!", "***", ".,", "|>", "<|endoftext", " ", "\n", "\t", "7",
     "\u0301", "\u0338", "Zz", "$" * 20, "\u0130"]), max_size=8).map("".join), max_size=6))
def test_pieces_forgotten_and_split_give_the_same_ids(texts):
    plain = Tokenizer.from_file(PATH)
    kept, packing.REMEMBERED, packing.TOGETHER = (packing.REMEMBERED, packing.TOGETHER), 3, 8
    try:
        made = packing.tokenizer(PATH)
        for _ in range(2):
            assert [np.frombuffer(f, "<u4").tolist() for f in made.ids(texts)] == [
                plain.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(made.known) == len(made.known_ids) and (len(made.known) <= 3 or not any(texts))
    finally:
        packing.REMEMBERED, packing.TOGETHER = kept


def test_remembered_words_take_little_memory():
    made = packing.ChunkTokenizer(PATH)
    words = ["".join("abcdefghij"[int(d)] for d in f"{k:07d}") for k in range(50_000)]
    made.ids([" ".join(words)])
    assert len(made.known) >= 50_000
    assert made.known.nbytes + made.known_ids.nbytes < sum(map(sys.getsizeof, words))
    learned = []
    made._learned = lambda new, learn=made._learned: learned.extend(new.to_pylist()) or learn(new)
    made.ids([" ".join(words)])
    assert not learned


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1))
def test_plan_holds_every_piece_once(histogram):
    lengths = np.array(sorted(histogram))
    made = packing.plan(lengths, np.array([histogram[k] for k in lengths]), 40)
    held = Counter()
    for used, times in zip(made.uses, made.repeats, strict=True):
        assert times > 0 and sum(length * n for length, n in used.items()) <= 40
        held.update({length: n * times for length, n in used.items()})
    assert held == histogram
    rows = packing.plan_rows(made)
    assert (rows.groupby("length")["stop"].max().to_dict()) == histogram


def test_plan_is_close_to_the_bound_at_any_scale():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True)
    for times in (1, 100_000):
        made = packing.plan(lengths, counts * times)
        bound = -(-int((lengths * counts * times).sum()) // 4096)
        assert sum(made.repeats) <= 1.002 * bound + 1
        assert len(made.repeats) < 60_000


def check(rows, docs, capacity):
    plain, expected = Tokenizer.from_file(PATH), Counter()
    for doc in docs:
        ids = [*plain.encode(doc.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], "<u4")
            expected[doc.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // capacity) * 1.02 + 1


def test_documents_are_packed(small_docs):
    check(packing.pack(small_docs, PATH).collect(), small_docs.collect(), 4096)


def test_workers_get_batches_of_bounded_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} " * 100) for k in range(2_000)], "doc_id long, text string")
    cut, limit = packing.chunks, 1 << 16

    def bounded(column, together):
        if together == limit and column.nbytes > limit:
            raise ValueError(f"a batch of {column.nbytes} bytes")
        return cut(column, together)

    monkeypatch.setattr(packing, "TOGETHER", limit)
    monkeypatch.setattr(packing, "chunks", bounded)
    before = spark.conf.get(ARROW_BYTES)
    check(packing.pack(docs, PATH).collect(), docs.collect(), 4096)
    assert spark.conf.get(ARROW_BYTES) == before


def test_odd_rows_and_hot_lengths(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 2)
    check(packing.pack(odd_docs, PATH, capacity=64).collect(), odd_docs.collect(), 64)
    assert packing.pack(no_docs, PATH).count() == 0
