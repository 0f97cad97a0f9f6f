import random
import re
from collections import Counter

import corpus_pipeline
from geomarket.llm import jaccard
from geomarket.llm.tables import documents, written


def test_stages_take_effect(spark, small_dir):
    docs = documents(spark, small_dir)
    columns, first = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, small_dir), name)
        if name != "packing":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "near_duplicates":
            assert jaccard.near_duplicates(docs).where("doc_id <> component_id").count() == 0
            first = before.count() - docs.count()
    assert first > 0
    total = Counter()
    for r in docs.collect():
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 4096


def test_stages_take_no_rows(spark, small_dir):
    docs = documents(spark, small_dir).where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small_dir), name)
    assert docs.count() == 0


def test_near_duplicates_are_those_of_five_words(spark, small_dir):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (140, 100, 60, 30)]
    rows = []
    for k in range(80):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(words)))
    rows += [(k, r.text) for k, r in enumerate(documents(spark, small_dir).orderBy("doc_id").collect(), 1000)]
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    between = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                between += 100 * both < 84 * len(sets[a] | sets[b])
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for (doc, _), words, g in zip(rows, sets, group, strict=True):
        first.setdefault(g if words else ("none", doc), doc)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, small_dir).collect()
    assert between and sorted(r.doc_id for r in kept) == sorted(first.values())
