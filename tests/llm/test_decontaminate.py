import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from geomarket.llm import decontaminate


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, width):
    found = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(width, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[k:k + n]:
                        hit.update(range(j, j + n))
                        names.add("" if name is None else str(name))
        found.append((doc, len(w), sorted(hit), sorted(names)))
    return sorted(found, key=str)


TEXT = st.lists(st.sampled_from(["a", "B", "é", "c1", "d-e", "\n", "."]), max_size=14).map(" ".join)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8),
       items=st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=5), blocks=st.booleans())
def test_hits_are_all_windows(spark, docs, items, blocks):
    docs, items = list(enumerate(docs)), [*enumerate(items, 9), (None, "a b"), (9, "c1")]
    before = decontaminate.BLOCK_BYTES
    decontaminate.BLOCK_BYTES = 8 if blocks else before
    try:
        found = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string"), width=3).collect()
    finally:
        decontaminate.BLOCK_BYTES = before
    assert sorted([(r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in found], key=str) == brute(docs, items, 3)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "twice the same row twice the same row twice the"), (2, "no id")],
                                 "item_id long, text string")


def test_odd_rows_keep_their_columns(odd_docs, no_docs, items):
    kept = decontaminate.drop_contaminated(odd_docs, items)
    assert kept.schema == odd_docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6"]
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(odd_docs, items).collect()}
    assert cut[6] == "é梦Ω𝄞 ünï" and cut[2] is None and "twice" not in cut[5] and "id" not in cut[None]
    assert decontaminate.judge_documents(no_docs, items).count() == 0
    assert decontaminate.judge_documents(odd_docs, items.where("false")).where("contaminated").count() == 0
