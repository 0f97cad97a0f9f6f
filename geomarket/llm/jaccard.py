"""Documents whose sets of word shingles have a high Jaccard similarity, exactly, and their groups.

Two sets above the threshold share a token in their prefixes under every global token
order. The first order, rarest tokens first as far as counts tell, makes the candidates;
two more orders must agree before the sets themselves are compared. Equal sets are one
node. To keep a large group of near copies from being paired all with all, each prefix
token first links its documents to the one in which it stands foremost; only pairs that
these links leave in different groups are then compared, and each is met at the first
token the two share, not at every one. A bitmap of each set, the parity of its tokens by
hash, bounds the difference of two sets from below and rules out most pairs before they
leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomarket.llm.graph import components
from geomarket.llm.tables import collected_bits, freed, maybe_in, maybe_rows, written
from geomarket.llm.tasks import fields, rows_from, with_columns
from geomarket.llm.words import NOT_SPACE, Chunk, chunks, mix, windows, words

# Tokens whose counts the first order knows, at most: all that occur in more documents than some bound.
KNOWN_TOKENS = 1 << 19
# Least count in one task's block of tokens, and in all, for a token to be known as frequent.
LEAST_IN_BLOCK, LEAST_COUNT, BLOCK_TOKENS = 3, 24, 2_000_000
# Bitmaps of 64 bits for each set.
_MAPS = [f"map{k}" for k in range(4)]
_SEEDS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_COUNT_BITS = 20
# Tokens before a prefix token that its row carries, to tell whether a pair has met already.
_BEFORE = 4


class Similarity(NamedTuple):
    """Linked when ``above`` * union <= ``below`` * intersection, in whole numbers."""

    above: int
    below: int
    width: int  # words of a shingle

    def overlap(self, a: str, b: str) -> str:
        """SQL for the least intersection of two linked sets of these sizes."""
        total = self.above + self.below
        return f"(({self.above} * ({a} + {b}) + {total - 1}) div {total})"

    def probe(self, n: np.ndarray) -> np.ndarray:
        """Prefix in which a set shares a token with every linked set that is no larger."""
        return np.where(n > 0, n - (self.above * n + self.below - 1) // self.below + 1, 0)

    def difference(self, a: str, b: str) -> str:
        """SQL for the largest symmetric difference of two linked sets of these sizes."""
        return f"({a} + {b} - 2 * {self.overlap(a, b)})"

    def index(self, n: str) -> str:
        """SQL for the prefix in which it shares one with every linked set that is no smaller."""
        return f"({n} - {self.overlap(n, n)} + 1)"


class Sets(NamedTuple):
    row: np.ndarray  # ascending
    token: np.ndarray  # ascending within a row, without repeats
    size: np.ndarray  # by row
    node: np.ndarray  # hash of the whole set, by row


def _row_by_row(row: np.ndarray, value: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """Order by row, then value; equal tokens in any order, others of equal value in that of their places.

    One key holds the row and the leading bits of the value; only if that mixes up tokens are both compared.
    """
    bits = max(1, int(rows).bit_length())
    key = (row.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))
    order = np.argsort(key)
    key, token = key[order], token[order]
    if ((key[1:] == key[:-1]) & (token[1:] != token[:-1])).any():
        return np.lexsort((value, row))
    return order


def shingle_sets(chunk: Chunk, width: int) -> Sets:
    """The set of each text: shingles of ``width`` words, or all words if there are fewer."""
    found = words(chunk, NOT_SPACE)
    counts = np.bincount(found.row, minlength=chunk.rows)
    rows, tokens = [], []
    for size in range(1, width + 1):
        first, hashed = windows(found, size)
        if size < width:
            short = counts[found.row[first]] == size
            first, hashed = first[short], hashed[short]
        rows.append(found.row[first])
        tokens.append(hashed)
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = _row_by_row(row, token, token, chunk.rows)
    row, token = row[order], token[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[fresh], token[fresh]
    size = np.bincount(row, minlength=chunk.rows)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + _SEEDS[0]))])
    ends = np.cumsum(size)
    return Sets(row, token, size, mix(sums[ends] - sums[ends - size] + size.astype(np.uint64)))


def bitmaps(sets: Sets) -> list[np.ndarray]:
    """The parity of the number of tokens in each of 256 buckets, as longs by row."""
    full = np.flatnonzero(sets.size)
    begin = (np.cumsum(sets.size) - sets.size)[full]
    bit = np.uint64(1) << ((sets.token >> np.uint64(56)) & np.uint64(63))
    word = sets.token >> np.uint64(62)
    maps = []
    for k in range(len(_MAPS)):
        made = np.zeros(len(sets.size), dtype=np.uint64)
        if len(full):
            made[full] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin)
        maps.append(made)
    return maps


class Order:
    """A global order of tokens: by known count, then by a hash of its own."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, seed: np.uint64):
        self.known, self.counts, self.seed = known, counts, seed

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        rank = mix(tokens ^ self.seed) >> np.uint64(_COUNT_BITS)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
            count = np.where(self.known[at] == tokens, self.counts[at], 0).astype(np.uint64)
            rank |= count << np.uint64(64 - _COUNT_BITS)
        return rank

    def prefixes(self, sets: Sets, length: np.ndarray) -> np.ndarray:
        """The first tokens of each set in this order, set after set."""
        order = _row_by_row(sets.row, self.rank(sets.token), sets.token, len(sets.size))
        begin = np.cumsum(sets.size) - sets.size
        place = np.arange(len(order)) - begin[sets.row]
        return sets.token[order][place < length[sets.row]]


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def _lists(values: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold and their counts, at most ``KNOWN_TOKENS`` of them."""
    def counted(held: list[np.ndarray]) -> dict:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        some = count >= LEAST_IN_BLOCK
        return {"token": pa.array(_signed(token[some])), "n": pa.array(count[some])}

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(shingle_sets(chunk, width).token)
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    counts = rows_from(docs.select("text"), produce, fields(token="long", n="long")).groupBy("token").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = written(counts, "frequent-shingles")
    total, least = 0, LEAST_COUNT
    for power, tokens in sorted(counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect(), reverse=True):
        if total + tokens > KNOWN_TOKENS:
            least = 2 ** (power + 1)
            break
        total += tokens
    known = counts.where(F.col("n") >= least).toArrow()
    token = known["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(known["n"].to_numpy()[order], (1 << _COUNT_BITS) - 1)


def _prefix_table(docs: DataFrame, similarity: Similarity, orders) -> DataFrame:
    """Per row its set's size and node; per node and task, the prefixes in the three orders and the last rank in the first."""
    out = fields(doc_id="long", n="long", node="long", first="longs", second="ints", third="ints", reach="long",
                 **dict.fromkeys(_MAPS, "long"))

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made = [Order(*orders.value, seed) for seed in _SEEDS]
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets = shingle_sets(chunk, similarity.width)
                new = np.zeros(chunk.rows, dtype=bool)
                for row, node in enumerate(sets.node.tolist()):
                    if sets.size[row] and node not in seen:
                        new[row] = True
                        if len(seen) < 1_000_000:  # only saves rows
                            seen.add(node)
                length = similarity.probe(sets.size) * new
                first, second, third = (order.prefixes(sets, length) for order in made)
                reach = np.zeros(chunk.rows, dtype=np.uint64)
                reach[length > 0] = made[0].rank(first[np.cumsum(length)[length > 0] - 1]) >> np.uint64(1)
                short = lambda tokens: (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield {"doc_id": batch.column(0).slice(chunk.first, chunk.rows), "n": pa.array(sets.size),
                       "node": pa.array(_signed(sets.node), mask=sets.size == 0), "first": _lists(_signed(first), length),
                       "second": _lists(short(second), length), "third": _lists(short(third), length), "reach": pa.array(_signed(reach)),
                       **{name: pa.array(_signed(made)) for name, made in zip(_MAPS, bitmaps(sets), strict=True)}}

    return rows_from(docs.select(F.col("doc_id").cast("long"), "text"), produce, out)


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The whole sets of the given nodes, found again in the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(collected_bits(nodes, F.col("node")))

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets = shingle_sets(chunk, width)
                wanted = maybe_in(bits.value, sets.node) & (sets.size > 0)
                for row in np.flatnonzero(wanted).tolist():
                    node = int(sets.node[row])
                    wanted[row] = node not in seen
                    if len(seen) < 1_000_000:
                        seen.add(node)
                kept = np.flatnonzero(wanted)
                if len(kept):
                    yield {"node": pa.array(_signed(sets.node[kept])),
                           "tokens": _lists(_signed(sets.token[wanted[sets.row]]), sets.size[kept])}

    found = rows_from(docs.select("text"), produce, fields(node="long", tokens="longs"))
    return written(found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def _linked(docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a the larger set) that the other orders let through and whose sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    signs = written(prefixes.join(ends, "node", "left_semi").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n", "second", "third")]), "orders")
    one, other = (signs.select(*[F.col(c).alias(f"{c}_{side}") for c in signs.columns]) for side in "ab")
    both = pairs.withColumnsRenamed({"a": "node_a", "b": "node_b"}).join(one, "node_a").join(other, "node_b")
    for order in ("second", "third"):
        both = both.where(F.expr(f"arrays_overlap({order}_a, slice({order}_b, 1, cast({similarity.index('n_b')} as int)))"))
    likely = written(both.select("node_a", "node_b", "n_a", "n_b"), "likely")
    freed(signs)
    sets = _full_sets(docs, likely.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct(),
                      similarity.width)
    one, other = (sets.select(F.col("node").alias(f"node_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    checked = likely.join(one, "node_a").join(other, "node_b").where(shared >= F.expr(similarity.overlap("n_a", "n_b")))
    linked = written(checked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "linked")
    freed(likely, sets)
    return linked


def _near_enough(similarity: Similarity, big: str, small: str) -> Column:
    """Sizes and places of a shared prefix token still allow a link; strings are column prefixes."""
    sizes = f"{similarity.below} * {small}n >= {similarity.above} * {big}n"
    rest = f"least({big}n - {big}pos, {small}n - {small}pos) >= {similarity.overlap(big + 'n', small + 'n')}"
    return F.expr(f"({sizes}) and ({rest})")


def _alike(similarity: Similarity, a: str, b: str) -> Column:
    """The bitmaps differ in no more places than linked sets of these sizes can differ in tokens."""
    differing = " + ".join(f"bit_count({a}{m} ^ {b}{m})" for m in _MAPS)
    return F.expr(f"{differing} <= {similarity.difference(a + 'n', b + 'n')}")


def _not_lone(similarity: Similarity, a: str, b: str) -> Column:
    """Prefix tokens that no other set has in its prefix leave room for a link.

    Of two prefixes, the one that ends first in the order has no such token in common with
    the other set: the other's prefix holds all its tokens up to there. Unlike the bitmaps
    this rules out as much in large sets as in small ones.
    """
    need = similarity.overlap(a + "n", b + "n")
    return F.expr(f"case when {a}reach < {b}reach then {a}n - {a}lone >= {need} "
                  f"when {b}reach < {a}reach then {b}n - {b}lone >= {need} else true end")


def _with_before(rows: DataFrame) -> DataFrame:
    """Each row of a prefix token with the tokens of the same set that come last before it."""
    last = Window.partitionBy("node").orderBy("pos").rowsBetween(-_BEFORE, -1)
    return rows.withColumn("before", F.collect_list("token").over(last))


def _met(rows: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of nodes of different groups that share a token and may be linked; hardly one comes twice.

    A pair that shares one of the tokens before has met there: whatever lets a pair through
    at a token lets it through at an earlier one. At the first that the two share, no
    earlier one can be shared, so no pair is lost.
    """
    kept = ("node", "n", "pos", "root", "reach", "lone", "before", *_MAPS)
    big = rows.select("token", *[F.col(c).alias(f"a_{c}") for c in kept])
    small = rows.where("indexed").select("token", *[F.col(c).alias(f"b_{c}") for c in kept])
    return big.join(small, "token").where("a_root <> b_root and (a_n > b_n or a_n = b_n and a_node > b_node)").where(
        _near_enough(similarity, "a_", "b_") & _not_lone(similarity, "a_", "b_") & _alike(similarity, "a_", "b_")).where(
        ~F.arrays_overlap("a_before", "b_before")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def links(docs: DataFrame, prefixes: DataFrame, similarity: Similarity) -> DataFrame:
    """Links between nodes whose components are those of all links; deletes ``prefixes``, the largest table."""
    rows = prefixes.where(F.size("first") > 0).select("node", "n", F.posexplode("first").alias("pos", "token"))
    rows = rows.withColumn("indexed", F.expr(f"pos < {similarity.index('n')}"))
    hubs = rows.groupBy("token").agg(
        F.min("node").alias("least"), F.max("node").alias("most"),
        F.min(F.when(F.col("indexed"), F.struct("pos", "n", "node"))).alias("hub"))
    hubs = written(hubs.where("least <> most").select("token", "hub"), "shared-tokens")
    bits = collected_bits(hubs, F.col("token"))
    shared = written(maybe_rows(rows, F.col("token"), bits).join(hubs, "token"), "shared-rows")
    freed(hubs)
    # Of a set without a shared token no pair is made. The first order is in the rows now.
    others = written(maybe_rows(prefixes.where(F.size("first") > 0).select("node", "n", "second", "third"), F.col("node"),
                                collected_bits(shared, F.col("node"))), "other-orders")

    star = shared.where("node <> hub.node").select(
        "node", "n", "pos", "indexed", F.col("hub.node").alias("h_node"), F.col("hub.n").alias("h_n"),
        F.col("hub.pos").alias("h_pos"))
    larger = star.where("n >= h_n").where(_near_enough(similarity, "", "h_")).select(
        F.col("node").alias("a"), F.col("h_node").alias("b"))
    smaller = star.where("n < h_n and indexed").where(_near_enough(similarity, "h_", "")).select(
        F.col("h_node").alias("a"), F.col("node").alias("b"))
    maps = written(prefixes.where(F.size("first") > 0).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n", "reach", *_MAPS)], F.first(F.size("first")).alias("length")).join(
        shared.select("node", "token").distinct().groupBy("node").agg(F.count("*").alias("n_shared")), "node", "left").select(
        "node", "n", "reach", *_MAPS, (F.col("length") - F.coalesce("n_shared", F.lit(0))).alias("lone")), "bitmaps")
    freed(prefixes)
    one, other = (maps.select(*[F.col(c).alias(f"{s}_{c}") for c in maps.columns]) for s in "ab")
    first_pairs = larger.union(smaller).distinct()
    first_pairs = first_pairs.join(one, F.col("a") == F.col("a_node")).join(other, F.col("b") == F.col("b_node"))
    first_pairs = written(first_pairs.where(
        _not_lone(similarity, "a_", "b_") & _alike(similarity, "a_", "b_")).select("a", "b"), "star-pairs")
    first_links = _linked(docs, first_pairs, others, similarity)

    groups = written(components(first_links), "groups")
    grouped = shared.where("hub is not null").drop("hub").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = grouped.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where(
        "least <> most").select("token")
    grouped = _with_before(grouped.join(mixed, "token", "left_semi").distinct())
    grouped = written(grouped.join(maps.drop("n"), "node"), "mixed-tokens")
    pairs = _met(grouped, similarity).distinct()
    tried = first_pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    second_pairs = written(pairs.withColumns({"x": F.greatest("a", "b"), "y": F.least("a", "b")}).join(
        tried, ["x", "y"], "left_anti").select("a", "b"), "second-pairs")
    freed(shared, maps, first_pairs, groups, grouped)
    found = first_links.union(_linked(docs, second_pairs, others, similarity))
    freed(others, second_pairs)
    return found


NEAR = Similarity(above=90, below=100, width=3)


def _reduced(similarity: Similarity) -> Similarity:
    divisor = int(np.gcd(similarity.above, similarity.below))
    return similarity._replace(above=similarity.above // divisor, below=similarity.below // divisor)


def _components(docs: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame]:
    """The set's size and node by row; and by node its smallest id and the root of its component."""
    orders = docs.sparkSession.sparkContext.broadcast(_frequent(docs, similarity.width))
    prefixes = written(_prefix_table(docs, similarity, orders), "prefixes")
    sets = written(prefixes.select("doc_id", "n", "node"), "nodes")
    roots = components(links(docs, prefixes, similarity))
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sets, written(rooted, "components")


def near_duplicates(docs: DataFrame, similarity: Similarity = NEAR) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    A null or empty text, or one of white space, has no shingles and is linked with
    nothing: its component is its own id. Equal sets are linked whatever their rows;
    a row without an id belongs to the component of its set, whose id is the smallest
    id in it, or null if none has one. An empty table gives no rows.
    """
    sets, rooted = _components(docs, _reduced(similarity))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = written(rooted.join(by_root, "root").select("node", "component_id"), "component-ids")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(labelled, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_nodes(docs: DataFrame, width: int) -> DataFrame:
    """Each row as ``document``, with the node of its text; null without shingles."""
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        nodes = [pa.array([], pa.int64())]
        for chunk in chunks(batch.column(batch.schema.names.index("text"))):
            sets = shingle_sets(chunk, width)
            nodes.append(pa.array(_signed(sets.node), mask=sets.size == 0))
        return {"node": pa.concat_arrays(nodes)}

    mine = docs.select(F.struct("*").alias("document"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    return with_columns(mine, compute, fields(node="long")).drop("text")


def one_of_each(docs: DataFrame, similarity: Similarity = NEAR) -> DataFrame:
    """The documents without their near duplicates: of each component the row with the smallest id stays.

    Rows without shingles all stay. If several rows carry the smallest id, or no row of
    the component has one, one of them stays.
    """
    similarity = _reduced(similarity)
    _, rooted = _components(docs, similarity)
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("kept")).select(
        F.col("kept.node").alias("kept_node"), F.col("kept.least").alias("kept_id"))
    # By node and id together, so that the many rows of one text are not brought into one task.
    rows = _with_nodes(docs, similarity.width).join(
        kept, (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id")), "left")
    # Rows without shingles all stay, so they need not meet.
    spread = F.when(F.col("node").isNull(), F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("node", "id", "spread").orderBy(F.lit(1)))
    stay = rows.where("kept_node is not null or node is null").withColumn("spread", spread).withColumn("nth", nth).where(
        "nth = 1")
    return stay.select([F.col("document").getField(c).alias(c) for c in docs.columns])
