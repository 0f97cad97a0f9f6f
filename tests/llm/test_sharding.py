import hashlib
from collections import Counter, defaultdict

from geomarket.llm import sharding


def test_shards_are_the_shortest_fitting_prefixes(spark):
    rows = [(k, "x" * (k * 37 % 90)) for k in range(400)]
    found = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=500).collect()
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    sums = defaultdict(int)
    for k, text in rows:
        for depth in range(61):
            sums[bits[k][:depth]] += len(text)
    for r in found:
        depth = next(d for d in range(61) if sums[bits[r.doc_id][:d]] <= 500)
        assert (r.shard, r.shard_depth, r.oversized) == (bits[r.doc_id][:depth], depth, False)
    assert len(found) == 400


def test_repeated_keys_split_on(spark):
    rows = [(7, "x" * 50)] * 200 + [(k, "y" * 10) for k in range(50)] + [(None, "z" * 50)] * 30
    found = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=300).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r.n_bytes
    assert len(found) == len(rows) and max(size.values()) <= 300
    assert sum(r.shard_depth > 60 for r in found) >= 200


def test_odd_rows(odd_docs, no_docs):
    found = sharding.shards(odd_docs, limit=1000).collect()
    assert len(found) == odd_docs.count()
    assert [r.doc_id for r in found if r.oversized] == [3]
    size = Counter()
    for r in found:
        size[r.shard] += r.n_bytes
    assert all(n <= 1000 for s, n in size.items() if s not in {r.shard for r in found if r.oversized})
    assert sharding.shards(no_docs).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 20) for k in range(60)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() >= 4


def test_a_repeated_key_is_written_to_many_shards(spark, tmp_path):
    rows = [(7, "x" * 50, k) for k in range(200)] + [(k, "y" * 10, k) for k in range(50)] + [(None, "z" * 50, 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=300)
    back = spark.read.parquet(str(tmp_path / "out")).selectExpr("doc_id", "text", "n", "_metadata.file_path as path").collect()
    assert Counter((r.doc_id, r.text, r.n) for r in back) == Counter(rows)
    size = Counter()
    for r in back:
        size[r.path.split("/shard=")[1].split("/")[0]] += len(r.text)
    assert "__HIVE_DEFAULT_PARTITION__" not in size and max(size.values()) <= 300
