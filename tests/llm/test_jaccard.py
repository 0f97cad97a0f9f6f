import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geomarket.llm import graph, jaccard, tables
from geomarket.llm.words import chunks


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[k:k + 3]) for k in range(len(w) - 2)])


def brute(rows, above=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= above * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((doc, len(sets[k]), doc if not sets[k] else min(group, default=None)))
    return Counter(out)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_all_links(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_COUNT", 4)
    monkeypatch.setattr(jaccard, "LEAST_IN_BLOCK", 2)
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [" ".join(rng.choices(vocabulary, k=n)) for n in (150, 100, 90, 60, 30, 4)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for k in range(160):
        kind = rng.random()
        text = edited(rng, rng.choice(bases), rng.randrange(6))
        if kind < 0.2:
            text = " ".join(rng.choices(vocabulary, k=rng.randrange(12)))
        elif kind < 0.35:
            text = passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(9)))
        elif kind < 0.4 and rows:
            text = (rng.choice(rows)[1] or "").upper()
        rows.append((k if rng.random() > 0.05 else None, rng.choice([text, text, text, None, ""]) if kind > 0.9 else text))
    rows += rows[:3]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)


def test_threshold_is_met_exactly(spark):
    base = [f"t{k}" for k in range(21)]  # 19 shingles
    longer = base + ["x", "y"]  # 21 shingles, 19 shared: 0.904
    other = base + ["p", "q", "r"]  # 22: 0.863
    rows = [(1, " ".join(base)), (2, " ".join(longer)), (3, " ".join(other))]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}


def test_linked_sets_share_a_prefix_token_in_every_order():
    rng = random.Random(4)
    similarity = jaccard._reduced(jaccard.NEAR)
    for _ in range(60):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 60))]
        b = a[:rng.randrange(len(a) - 1, len(a) + 1)] + [f"v{k}" for k in range(rng.randrange(2))]
        texts = [" ".join(a), " ".join(b)]
        x, y = (shingles(t) for t in texts)
        if 100 * len(x & y) < 90 * len(x | y):
            continue
        sets = jaccard.shingle_sets(next(chunks(pa.array(texts))), 3)
        length = similarity.probe(sets.size)
        for seed in jaccard._SEEDS:
            known = np.sort(sets.token[::3])
            order = jaccard.Order(np.unique(known), np.arange(len(np.unique(known))) + 1, seed)
            first = order.prefixes(sets, length)
            assert set(first[:length[0]].tolist()) & set(first[length[0]:].tolist())


def test_bitmaps_bound_the_difference():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(40)]
    sets = jaccard.shingle_sets(next(chunks(pa.array(texts))), 3)
    maps = jaccard.bitmaps(sets)
    for a in range(40):
        for b in range(a):
            differing = sum(int(m[a] ^ m[b]).bit_count() for m in maps)
            assert differing <= len(shingles(texts[a]) ^ shingles(texts[b]))


def test_one_of_each(spark, odd_docs, no_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert jaccard.one_of_each(no_docs).count() == 0


def test_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (130, 200)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) == 61 + 51
    assert all(roots[k] == 0 for k in range(61)) and roots[200] == 100 and roots[149] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_sets_with_common_passages(spark):
    """Large texts that share passages, and links among them, with prefixes full of shared and of lone tokens."""
    rng = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(120)] for k in range(12)]
    texts = []
    for d in range(60):
        own = [f"d{d}w{i}" for i in range(rng.randrange(0, 700))]
        text = sum(rng.sample(passages, 5), own)
        texts.append(text)
        for _ in range(rng.randrange(0, 3)):
            near = list(text)
            for _ in range(rng.randrange(0, 20)):
                near[rng.randrange(len(near))] = f"x{rng.random()}"
            texts.append(near[:rng.randrange(len(near) * 17 // 20, len(near) + 1)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert 60 < len({r.component_id for r in found}) < len(rows) - 10


def test_only_scratch_tables_are_freed(spark, tmp_path):
    one, other = (tables.written(spark.range(n), "some") for n in (3, 0))
    tables.freed(one, other)
    for table in (one, other):
        assert not any(pathlib.Path(f.removeprefix("file:")).exists() for f in table.inputFiles())
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="no scratch table"):
        tables.freed(spark.read.parquet(f"{tmp_path}/own"))
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3


def test_disk_is_given_back_early(spark, small_docs, monkeypatch):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    made, plain = [], tables.written

    def shuffled():
        return manager.getAllFiles().mkString(" ").count("shuffle_")

    def there(table):
        return any(pathlib.Path(f.removeprefix("file:")).exists() for f in table.inputFiles())

    def written(df, label):
        # When the texts of the first pairs are compared, the prefixes in the first order are no longer needed.
        if label == "likely":
            assert not any(there(table) for other, table in made if other in ("prefixes", "shared-tokens"))
        before = shuffled()
        made.append((label, plain(df, label)))
        assert shuffled() <= before
        return made[-1][1]

    monkeypatch.setattr(jaccard, "written", written)
    assert jaccard.near_duplicates(small_docs).count() == small_docs.count()
    assert "likely" in dict(made) and {label for label, table in made if there(table)} <= {
        "frequent-shingles", "nodes", "linked", "components", "component-ids"}


def test_order_by_row_and_value():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 9, 500))
    for spread in (3, 1 << 63):
        token = rng.integers(0, spread, 500).astype(np.uint64)
        order = jaccard._row_by_row(row, token, token, 9)
        assert list(zip(row[order], token[order], strict=True)) == sorted(zip(row, token, strict=True))


def test_a_pair_is_met_once_in_the_join(spark, monkeypatch):
    """Near copies that share many prefix tokens, too far apart to be linked by the hubs alone."""
    rng = random.Random(12)
    bases = [[f"b{k}w{i}" for i in range(400)] for k in range(2)]
    rows = [(k, edited(rng, " ".join(rng.choice(bases)), rng.randrange(5, 9))) for k in range(40)]
    plain, met = jaccard._met, []

    def counted(rows, similarity):
        pairs = plain(rows, similarity)
        every = plain(rows.withColumn("before", F.expr("array(node)")), similarity)  # different in all nodes
        met.append((pairs.count(), pairs.distinct().count(), every.count(), every.distinct().count()))
        assert pairs.exceptAll(every).isEmpty() and every.distinct().exceptAll(pairs.distinct()).isEmpty()
        return pairs

    monkeypatch.setattr(jaccard, "_met", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.near_duplicates(docs, jaccard.Similarity(80, 100, 5)).count() == len(rows)
    (once, pairs, every, all_pairs), = met
    assert pairs == all_pairs > 50 and once < 1.5 * pairs and every > 10 * pairs
