import hashlib
import zlib
from collections import defaultdict

import pytest

from geomarket.llm import prefix_trie


def plain(rows):
    """All nodes of the tree, one conversation and prefix at a time."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(abs(c) % 5 * (1 if c >= 0 else -1)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, ends = defaultdict(int), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for c, seq in whole.items():
        ends[seq].append(c)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += node not in children
    return sorted((min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), children[node] if node in children else 0,
                   leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
                  for node, who in members.items())


def check(found, rows):
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                  r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)
    assert got == plain(rows)


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(3)
    check(prefix_trie.trie(table).collect(), [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def family_rows():
    """Copies, extensions, long and short conversations, a missing first one, one that holds a third of all turns."""
    rows = []
    for c in range(60):
        n = [1, 2, 9, 12, 20, 8][c % 6]
        if c % 10 == 5:
            continue
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of kind {c % 3 if t > 4 else 0}é") for t in range(n)]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(400)]
    rows += [(600 + k, t, "user", "same") for k in range(50) for t in range(3)]
    return rows


def test_families(spark, settings):
    rows = family_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    settings(shuffle__partitions="13", adaptive__coalescePartitions__enabled="false")
    check(prefix_trie.trie(df.repartition(5)).collect(), rows)


def test_pieces_of_a_list_make_one_digest(spark, monkeypatch, settings):
    settings(shuffle__partitions="7", adaptive__coalescePartitions__enabled="false")
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(5 * k, 0, "user", "same") for k in range(-30, 60)]
    check(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), rows)


@pytest.fixture
def odd_turns(spark):
    rows = [(0, 0, None, None), (0, 1, "user", ""), (0, None, "user", "first"), (1, 0, "", None), (1, 0, "user", "x"),
            (2, 5, "user", "x" * 2_000_000), (2, 5, "user", "x" * 2_000_000), (None, 0, "user", "no conversation"),
            (3, -4, "user", "t"), (3, 4, "user", "u"), (-3, 0, "user", "first"), (-7, 1, "user", "z"), (7, 1, "a", "bc"), (9, 1, "ab", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as place", "2 as row", "3 as key1", "4 as depth", "5 as part", "6 as bytes"), rows


def test_odd_turns(odd_turns):
    df, rows = odd_turns
    # Turns 0 of conversation 1 are tied; either order is a defined result, so only their number counts here.
    found = prefix_trie.trie(df.repartition(3)).collect()
    untied = [r for r in rows if r[0] != 1]
    check(prefix_trie.trie(df.where("conv_id is null or conv_id <> 1")).collect(), untied)
    assert sum(r.n_convs for r in found if r.depth == 0) == len({r[0] for r in rows} - {None})


def test_no_turns(odd_turns):
    assert prefix_trie.trie(odd_turns[0].where("false")).count() == 0


def test_running_sums_over_many_tasks(spark, settings):
    settings(shuffle__partitions="11", adaptive__coalescePartitions__enabled="false")
    rows = [(g, i, (i * 7919 + g) % 101, (1 << 60) + i) for g, n in [(1, 3), (2, 700), (3, 1), (4, 60)] for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long, w long").repartition(6)
    found = sorted(map(tuple, prefix_trie.running(df, "g", ["i"], ["v", "w"]).select("g", "i", "place", "v", "w").collect()))
    expected, state = [], {}
    for g, i, v, w in rows:
        place, a, b = state.get(g, (0, 0, 0))
        state[g] = place + 1, (a + v) % prefix_trie.MODULUS, (b + w) % prefix_trie.MODULUS
        expected.append((g, i, *state[g]))
    assert found == expected
