"""Exact token counts at every prefix of a text.

Prefix dynamic programming: the last token of the encoding of each prefix is the one
vocabulary piece that ends there and stays apart from the last token before it. The
token table of a prefix thus follows from shorter prefixes, and questions of budget
and truncation need no encoding anew. Pieces hold a word boundary only in front, so
words are independent: the table of a text is the sum over its words, and the words
that a batch has for the first time get their tables together, one character at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tasks import fields, process_state, with_columns
from geomarket.llm.words import mix

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
# Words a worker remembers; others are computed when met, so the bound only costs time.
REMEMBERED = 800_000
# Words of one block of tables, and the longest word in it; longer ones are done one by one.
BLOCK_WORDS, BLOCK_LENGTH = 50_000, 40
_BITMAP = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C13


class _Substrings:
    """Hashes of substrings of words laid end to end."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        factor = np.full(len(codes) + 1, _MULTIPLIER, dtype=np.uint64)
        factor[:1] = 1
        up = np.cumprod(factor)
        factor[1:] = pow(_MULTIPLIER, -1, 1 << 64)
        self.down = np.cumprod(factor)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * up[:-1], out=self.sums[1:])
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(raw + np.uint64(1) * np.asarray(length).astype(np.uint64))


class PrefixCounter:
    """Token counts of a sentencepiece model of pairwise merges with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.score = {p: -model.get_score(model.piece_to_id(p)) for p in self.pieces}
        if "\n" in self.score or any(
                SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.pieces):
            raise ValueError("the words of this vocabulary are not independent")
        self.longest = max(map(len, self.pieces))
        self.inner = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        strings = _Substrings(self.pieces)
        hashes = strings(strings.start, strings.length)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.bitmap = np.zeros(_BITMAP, dtype=bool)
        self.bitmap[hashes & np.uint64(_BITMAP - 1)] = True
        # Pairs of pieces by left id * 2 ** 20 + right id, and whether they stay apart.
        self.pairs, self.apart = np.zeros(1, dtype=np.int64) - 1, np.zeros(1, dtype=bool)
        self.totals: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                value = score.get(parts[k] + parts[k + 1])
                if value is not None and (best is None or value < best):
                    best, at = value, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the encoding of two pieces together is these two pieces."""
        unknown = len(self.pieces)
        keys = left * (1 << 20) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        new = np.unique(keys[(self.pairs[at] != keys) & (left < unknown) & (right < unknown)])
        if len(new):
            found = np.zeros(len(new), dtype=bool)
            for i, key in enumerate(new.tolist()):
                pair = [self.pieces[key >> 20], self.pieces[key & ((1 << 20) - 1)]]
                found[i] = pair[0][-1] + pair[1][0] not in self.inner or self.merged(pair[0] + pair[1]) == pair
            to = np.searchsorted(self.pairs, new)
            self.pairs, self.apart = np.insert(self.pairs, to, new), np.insert(self.apart, to, found)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.apart[at], True)

    def _piece_at(self, strings: _Substrings, length: int) -> np.ndarray:
        """Id of the piece of a length that begins at each character, or -1."""
        n = len(strings.sums) - 1
        found = np.full(n, -1, dtype=np.int32)
        if n >= length:
            hashes = strings(np.arange(n - length + 1), length)
            maybe = np.flatnonzero(self.bitmap[hashes & np.uint64(_BITMAP - 1)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[maybe]
            found[maybe[hit]] = self.ids[at[hit]]
        return found

    def tables(self, words: list[str]) -> np.ndarray:
        """A column for each word: token counts of its prefixes, from the empty prefix on."""
        by_length = np.argsort(np.fromiter(map(len, words), np.int64, len(words)))[::-1]
        ordered = [words[k] for k in by_length.tolist()]
        strings = _Substrings(ordered)
        most = len(ordered[0]) if ordered else 0
        pieces = [self._piece_at(strings, n) for n in range(1, min(most, self.longest) + 1)]
        unknown = len(self.pieces)
        last = np.zeros((most + 1, len(ordered)), dtype=np.int64)
        counts = np.zeros((most + 1, len(ordered)), dtype=np.int64)
        for i in range(1, most + 1):
            open_words = np.arange(np.searchsorted(-strings.length, -i, side="right"))
            for n in range(min(i, len(pieces)), 0, -1):
                piece = pieces[n - 1][strings.start[open_words] + i - n]
                has = piece >= 0
                word, piece = open_words[has], piece[has].astype(np.int64)
                if n < i:
                    ok = self._stay_apart(last[i - n, word], piece)
                    word, piece = word[ok], piece[ok]
                last[i, word] = piece
                counts[i, word] = counts[i - n, word] + 1
                open_words = open_words[counts[i, open_words] == 0]
                if not len(open_words):
                    break
            if len(open_words):  # a character outside the vocabulary: as many tokens as it has bytes
                last[i, open_words] = unknown
                size = [len(ordered[k][i - 1].encode()) for k in open_words.tolist()]
                counts[i, open_words] = counts[i - 1, open_words] + np.array(size)
        made = np.empty_like(counts)
        made[:, by_length] = counts
        return made

    def prefixes(self, word: str) -> list[int]:
        """The same for one word of any length."""
        last, counts, score = [""], [0], self.score
        known: dict[tuple[str, str], bool] = {}
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                piece = word[j:i]
                if piece not in score:
                    continue
                if j and (last[j], piece) not in known:
                    known[last[j], piece] = self.merged(last[j] + piece) == [last[j], piece]
                if not j or known[last[j], piece]:
                    last.append(piece)
                    counts.append(counts[j] + 1)
                    break
            else:
                last.append(word[i - 1])
                counts.append(counts[i - 1] + len(word[i - 1].encode()))
        return counts

    def learn(self, words: set[str]) -> None:
        """Remember the totals of words met for the first time."""
        new = [w for w in words if w not in self.totals]
        if len(self.totals) + len(new) > REMEMBERED:
            self.totals.clear()
            new = list(words)
        short = [w for w in new if len(w) <= BLOCK_LENGTH]
        for k in range(0, len(short), BLOCK_WORDS):
            block = short[k:k + BLOCK_WORDS]
            table = self.tables(block)
            totals = table[np.fromiter(map(len, block), np.int64, len(block)), np.arange(len(block))]
            self.totals.update(zip(block, totals.tolist(), strict=True))
        for word in new:
            if len(word) > BLOCK_LENGTH:
                self.totals[word] = self.prefixes(word)[-1]

    @staticmethod
    def split(text: str) -> list[str]:
        """The independent words of a text, with the boundary that the model puts in front."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] in " \n" or text[-1] == " " or " \n" in text:
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        # A line break ends a word; the next word begins with it and has no boundary.
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n")).split(" ")

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts = [self.split(t) for t in texts]
        totals = []
        for k in range(0, len(parts), 500):
            some = parts[k:k + 500]
            self.learn(set().union(*some))
            known = self.totals
            totals += [sum([known[w] for w in words]) for words in some]
        return totals

    def table(self, text: str) -> np.ndarray:
        """Tokens at every prefix of a text, by characters: entry i counts ``text[:i]``."""
        parts, base = [np.zeros(1, dtype=np.int64)], 0
        for k, word in enumerate(_WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []):
            counts = np.asarray(self.prefixes(word), dtype=np.int64)
            parts.append(base + counts[1 if k else 2:])  # the first boundary is no character of the text
            base += int(counts[-1])
        return np.concatenate(parts)


def counter(model_file: str) -> PrefixCounter:
    state = process_state("prefix_counters")
    if model_file not in state:
        state[model_file] = PrefixCounter(model_file)
    return state[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``over_limit`` to each row; a null or empty text has no tokens.

    Rows are independent: repeated rows, ties and other columns change nothing, and
    columns of these two names are replaced.
    """
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(batch.schema.names.index(text))
        n: list[int] = []
        for k in range(0, len(texts), 2000):
            n += counter(model_file).count([t or "" for t in texts.slice(k, 2000).to_pylist()])
        n = np.array(n, dtype=np.int64)
        return {"n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return with_columns(docs, compute, fields(n_tokens="long", over_limit="boolean"))


def fitting_prefix(docs: DataFrame, model_file: str, budget: int, text: str = "text") -> DataFrame:
    """Add ``fitting_chars``: characters of the longest prefix of at most ``budget`` tokens."""
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        tokens = counter(model_file)
        texts = batch.column(batch.schema.names.index(text)).to_pylist()
        fits = [int(np.flatnonzero(tokens.table(t or "") <= budget)[-1]) for t in texts]
        return {"fitting_chars": pa.array(fits, pa.int64())}

    return with_columns(docs, compute, fields(fitting_chars="long"))


def count_documents(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", "text", n_bytes)
    return token_counts(rows, model_file, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")
