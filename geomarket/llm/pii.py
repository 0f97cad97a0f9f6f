"""Personal data: fixed patterns, and terms that reveal the entities which the patterns find.

A term reveals an entity when their pointwise mutual information over lines of the corpus
comes close to the entity's own information: PMI(t, e) >= IC(e) - BITS, which is to say
that at least a share 2 ** -BITS of the lines with the term hold the entity. Equal lines
count once where they hold an entity, else copies would make all their words revealing.
Terms that exceed the threshold are generalised wherever they occur, those that exceed a
higher one are removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomarket.llm.tables import collected_bits, maybe_in, maybe_rows, written
from geomarket.llm.tasks import arrow_schema, fields, give_back, rows_from, with_columns
from geomarket.llm.words import ALPHANUMERIC, Chunk, chunks, words

KINDS = ("email", "ip", "card", "phone", "term")
# Lines that must hold both a term and an entity, and bits by which a term may miss the entity's information.
SUPPORT, BITS, BITS_REMOVED = 3, 1.0, 0.15
# Bytes of a term at least.
TERM_BYTES = 4
# Rows of lines with a term or an entity that a task hands on at once.
BLOCK_ROWS = 100_000
# Texts that are strings in a task at once.
SLICE = 256
PLACEHOLDERS = {kind: f"[{kind.upper()}]" for kind in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS_AND_DOTS = re.compile(r"[0-9][0-9.]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BREAK = re.compile("\n")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", domain.end() if domain else at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS_AND_DOTS.finditer(text):
        if run.group().count(".") < 3:
            continue
        for dotted in _DOTTED.finditer(run.group()):
            parts = dotted.group().split(".")
            place = run.start() + dotted.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    start = place + sum(map(len, parts[:k])) + k
                    yield start, start + sum(map(len, four)) + 3


def _passes_luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 12:
            digits = _NO_DIGIT.sub("", found.group())
            if 12 <= len(digits) <= 19 and _passes_luhn(digits):
                yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, place of the kind in ``KINDS`` and end of each match, ordered; offsets count code points."""
    found = []
    for kind, search in enumerate((_emails, _addresses, _cards, _phones)):
        found += [(start, kind, end) for start, end in search(text)]
    return sorted(found)


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64(text.encode()).digest(), "big", signed=True)


def _entity(kind: int, value: str) -> int:
    return _hash(f"{kind}:{value.lower() if kind < 2 else _NO_DIGIT.sub('', value)}")


def _entity_lines(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, set[int]]]:
    """Each line that holds an entity, with the entities blanked out."""
    at = 0
    for line_start, line_end in _lines_around(text, spans):
        parts, here, entities = [], line_start, set()
        while at < len(spans) and spans[at][0] < line_end:
            start, kind, end = spans[at]
            parts += [text[here:max(here, start)], " "]
            here = max(here, end)
            entities.add(_entity(kind, text[start:end]))
            at += 1
        yield "".join(parts) + text[here:line_end], entities


def _lines_around(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    done = -1
    for start, _, _ in spans:
        if start >= done:
            begin = text.rfind("\n", 0, start) + 1
            done = text.find("\n", start)
            done = len(text) if done < 0 else done
            yield begin, done


# Corpus statistics ----------------------------------------------------------------------------

def _terms(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Start, end, row and hash of the words that may be terms."""
    found = words(chunk, ALPHANUMERIC)
    long = found.end - found.start >= TERM_BYTES
    return tuple(column[long] for column in found)


def _first_pass(docs: DataFrame) -> DataFrame:
    """Three sorts of rows: base spans of each text, and the terms and the entities of each line that holds an entity."""
    out = fields(sort="int", key="long", doc="string", base="string", counts="ints", line="long", entity="long", term="long")

    def held(sort: int, line: np.ndarray, name: str, values: np.ndarray) -> Iterator[dict]:
        for k in range(0, len(line), BLOCK_ROWS):
            n = len(line[k:k + BLOCK_ROWS])
            made = {f.name: pa.nulls(n, t) for f, t in zip(out, arrow_schema(out).types, strict=True)}
            yield made | {"sort": pa.array(np.full(n, sort, np.int32)), "line": pa.array(line[k:k + BLOCK_ROWS]),
                          name: pa.array(values[k:k + BLOCK_ROWS])}

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                some = batch.slice(k, SLICE)
                keys, docs, texts = (c.to_pylist() for c in some.columns)
                base, counts, lines = [], [], []
                for text in texts:
                    spans = base_spans(text)
                    base.append(",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans))
                    counts.append([sum(1 for s in spans if s[1] == kind) for kind in range(4)])
                    lines += _entity_lines(text, spans)
                n = len(texts)
                yield {"sort": pa.array(np.zeros(n, np.int32)), "key": keys, "doc": docs, "base": base,
                       "counts": counts, "line": pa.nulls(n, pa.int64()), "entity": pa.nulls(n, pa.int64()),
                       "term": pa.nulls(n, pa.int64())}
                hashes = np.array([_hash(line) for line, _ in lines], dtype=np.int64)
                for chunk in chunks(pa.array([line for line, _ in lines], pa.string())):
                    _, _, row, hashed = _terms(chunk)
                    pairs = np.unique(np.stack([row, hashed.view(np.int64)], axis=1), axis=0)
                    yield from held(1, hashes[chunk.first + pairs[:, 0]], "term", pairs[:, 1])
                entities = [(line, entity) for line, (_, found) in zip(hashes.tolist(), lines, strict=True) for entity in found]
                if entities:
                    line, entity = np.array(entities, dtype=np.int64).T
                    yield from held(2, line, "entity", entity)

    return written(rows_from(docs, produce, out), "personal-data", by=["sort"])


def _lines_without(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many lines without an entity each of the terms stands."""
    bits = docs.sparkSession.sparkContext.broadcast(collected_bits(terms, F.col("term")))

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0

        def counted() -> dict:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return {"term": pa.array(term.view(np.int64)), "n": pa.array(n)}

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                start, _, row, hashed = _terms(chunk)
                some = maybe_in(bits.value, hashed)
                start, hashed = start[some], hashed[some]
                if not len(start):
                    continue
                # Lines are numbered through the chunk; a text begins a line of its own.
                breaks = np.flatnonzero(chunk.data == 10)
                line = np.searchsorted(breaks, start) + row[some]
                with_entity = []
                for r in range(chunk.rows):
                    text = chunk.data[chunk.offsets[r]:chunk.offsets[r + 1]].tobytes().decode()
                    spans = [s[0] for s in base_spans(text)]
                    if spans:
                        first = int(np.searchsorted(breaks, chunk.offsets[r])) + r
                        inside = [m.start() for m in _BREAK.finditer(text)]
                        with_entity.append(first + np.searchsorted(inside, spans))
                other = ~np.isin(line, np.concatenate(with_entity)) if with_entity else np.ones(len(line), bool)
                once = np.unique(np.stack([line[other].astype(np.uint64), hashed[other]], axis=1), axis=0)[:, 1]
                held.append(once)
                size += len(once)
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = rows_from(docs.select("text"), produce, fields(term="long", n="long"))
    return found.groupBy("term").agg(F.sum("n").alias("n_without"))


def _classes(held: DataFrame, name: str) -> DataFrame:
    """Terms or entities of ``SUPPORT`` lines or more: name, how many lines, and a hash of the set of lines."""
    lines = F.count("*").alias("n")
    return written(held.groupBy(name).agg(
        lines, F.bit_xor("line").alias("one"), F.bit_xor(F.xxhash64("line")).alias("other")).where(
        F.col("n") >= SUPPORT).select(name, "n", F.xxhash64("n", "one", "other").alias("class")), f"{name}-classes")


def revealing_terms(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``term``, ``missed_bits``: terms that reveal some entity, and by how many bits they miss its information.

    Only terms and entities with enough lines are paired, and those that stand in the very
    same lines are paired as one: a line that lists very many of both makes no pair for each two.
    """
    sides = {}
    for sort, name in ((1, "term"), (2, "entity")):
        held = contexts.where(F.col("sort") == sort).select("line", name).distinct()
        classes = _classes(held, name)
        members = classes.groupBy("class").agg(F.min(name).alias(name), F.first("n").alias(f"n_{name}"))
        sides[name] = classes, held.join(members, name).select("line", F.col("class").alias(f"{name}_class"), f"n_{name}")
    terms, term_lines = sides["term"]
    # No more lines can hold both than hold the entity.
    both = term_lines.join(sides["entity"][1], "line").where(F.col("n_entity") * 2.0 ** BITS >= F.col("n_term"))
    pairs = both.groupBy("term_class", "entity_class").agg(F.count("*").alias("n_both")).where(
        F.col("n_both") >= SUPPORT).groupBy("term_class").agg(F.max("n_both").alias("n_both"))
    # Terms that already miss too much among the lines with entities need no count elsewhere.
    near = written(terms.join(pairs, F.col("class") == F.col("term_class")).select(
        "term", "n_both", F.col("n").alias("n_with")).where(F.log2(F.col("n_with") / F.col("n_both")) <= BITS), "near-terms")
    found = near.join(_lines_without(docs, near), "term", "left")
    missed = F.log2((F.col("n_with") + F.coalesce("n_without", F.lit(0))) / F.col("n_both"))
    return written(found.select("term", missed.alias("missed_bits")).where(F.col("missed_bits") <= BITS), "revealing")


def _term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Where revealing terms stand, in code points: key, spans."""
    bits = docs.sparkSession.sparkContext.broadcast(collected_bits(terms, F.col("term")))

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for chunk in chunks(batch.column(1)):
                start, end, row, hashed = (c for c in _terms(chunk))
                some = maybe_in(bits.value, hashed)
                start, end, row, hashed = start[some], end[some], row[some], hashed[some]
                points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                begin = points[chunk.offsets[row]]
                yield {"key": pa.array(keys[chunk.first + row]), "term": pa.array(hashed.view(np.int64)),
                       "start": pa.array(points[start] - begin), "end": pa.array(points[end] - begin)}

    found = rows_from(docs.select("key", "text"), produce, fields(key="long", term="long", start="long", end="long"))
    return found.join(terms, "term").groupBy("key").agg(
        F.collect_set(F.struct("start", "end", "missed_bits")).alias("terms"))


def _identity(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("string").alias("doc"),
            F.coalesce("text", F.lit("")).alias("text")]


def _analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans by row, and places of revealing terms by text."""
    mine = docs.select(*_identity(docs))
    first = _first_pass(mine)
    terms = revealing_terms(mine, first.where("sort > 0"))
    return first.where("sort = 0"), written(_term_places(mine, terms), "term-places")


def _outside(base: list[tuple[int, int, int]], terms: list[dict]) -> list[dict]:
    """The terms that overlap no base span."""
    starts, ends = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    kept = []
    for term in terms:
        before = bisect_left(starts, term["end"])  # spans that begin before the term ends
        if not before or ends[before - 1] <= term["start"]:
            kept.append(term)
    return kept


def _joined(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    names, spans = batch.schema.names, []
    for base, terms in zip(batch.column(names.index("base")).to_pylist(),
                           batch.column(names.index("terms")).to_pylist(), strict=True):
        if terms:
            parsed = [(int(s), KINDS.index(k), int(e)) for k, s, e in (p.split(":") for p in base.split(",") if p)]
            extra = [(t["start"], KINDS.index("term"), t["end"]) for t in _outside(parsed, terms)]
            base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(parsed + extra))
        spans.append(base)
    return {"spans": pa.array(spans, pa.string())}


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    A null or empty text has no spans; repeated rows get equal spans; an empty table gives
    no rows. Spans of different kinds may overlap, those of one kind never do, and a term
    overlaps none of the others.
    """
    base, places = _analysed(docs)
    found = with_columns(base.join(places, "key", "left").select("doc", "base", "counts", "terms"), _joined,
                         fields(spans="string"))
    counts = [F.col("counts")[k].cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    n_term = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    return found.select(
        F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *counts,
        F.sha2("base", 256).alias("base_sha256"), "spans",
        (n_term - F.aggregate("counts", F.lit(0), lambda a, b: a + b)).cast("long").alias("n_term"))


def _masked(text: str, terms: list[dict]) -> str:
    base = base_spans(text)
    spans = [(s, e, PLACEHOLDERS[KINDS[k]]) for s, k, e in base]
    spans += [(t["start"], t["end"], "" if t["missed_bits"] <= BITS_REMOVED else PLACEHOLDERS["term"])
              for t in _outside(base, terms)]
    parts, at = [], 0
    for start, end, shown in sorted(spans):
        if end > at:  # of overlapping spans the first names the whole
            parts += [text[at:start], shown] if start >= at else []
            at = end
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The same rows with personal data replaced by placeholders, and ``n_chars``, if there, brought up to date.

    A null text stays null. A task holds one copy of a batch's texts, and ``SLICE`` of them as strings.
    """
    _, places = _analysed(docs)
    others = [c for c in docs.columns if c != "text"]
    mine = docs.select(F.struct(*others).alias("document"), *_identity(docs)[:1], F.col("text"))
    bits = collected_bits(places, F.col("key"))
    # Texts without a revealing term are not shuffled.
    nothing = F.lit(None).cast(places.schema["terms"].dataType).alias("terms")
    wanted = ["document", "text", "terms"]
    rows = maybe_rows(mine, F.col("key"), bits).join(places, "key", "left").select(wanted).unionByName(
        maybe_rows(mine, F.col("key"), ~bits).select("document", "text", nothing))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [None if t is None else _masked(t, s or [])
                         for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["document", "clean"])
        give_back()

    done = rows.mapInArrow(clean, T.StructType([rows.schema["document"], T.StructField("clean", T.StringType())]))
    changed = {"text": F.col("clean"), "n_chars": F.char_length("clean")}
    kinds = dict(docs.dtypes)
    return done.select([
        changed[c].cast(kinds[c]).alias(c) if c in changed else F.col("document").getField(c).alias(c) for c in docs.columns])
