import math
import re
from collections import Counter

from geomarket.llm import quality


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def measured(rows):
    return sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in rows))


def test_counts(spark, small_docs, odd_docs, no_docs, small_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    more = spark.createDataFrame([(900, "a b\x0bc a b\x0ba b\x0b\n\n\nx\nx \nx"), (901, "é " * 60 + "<#>𝄞")],
                                 "doc_id long, text string")
    docs = small_docs.union(more).selectExpr("*", "'en' as lang").union(odd_docs.select("doc_id", "text", "lang"))
    found = quality.judge_documents(docs, labels).collect()
    assert measured(found) == sorted((str(r.doc_id), *expected(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in found)
    assert quality.judge_documents(no_docs, labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 1000, 0.01), (7, 1000, 0.01), (40, 900, 0.05), (3, 3, 0.5), (300, 100_000, 0.004)]
    for k, n, p in cases:
        found = spark.range(1).selectExpr(f"{k}L as k", f"{n}L as n").select(
            quality._log_binomial_tail("k", "n", p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p)
                 + (n - j) * math.log(1 - p) for j in range(k + 1)]
        top = max(terms)
        assert math.isclose(found, top + math.log(sum(math.exp(t - top) for t in terms)), rel_tol=1e-6, abs_tol=1e-9)


def test_cutoffs_bound_false_rejections(spark):
    # In stratum a the rule tells good from bad; b has too few good documents for any bound.
    rows = [(k, "a", k, False, 0.05 if k < 4000 else 0.5) for k in range(5000)] + [
        (10_000 + k, "b", k, False, 0.05) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, stratum string, text_hash long, base_failed boolean, r double")
    labels = spark.createDataFrame([(k, int(k % 5000 < 3995 or k > 5000)) for k in [*range(5000), *range(10_000, 10_020)]],
                                   "doc_id long, quality int").union(spark.createDataFrame([(4100, 1), (3, 1)], "doc_id long, quality int"))
    chosen = quality.cutoffs(table, labels, rules=["r"]).collect()
    assert [(c.stratum, c.rule, c.cutoff) for c in chosen] == [("a", "r", 0.05)]
    judged = quality.judge(table, spark.createDataFrame(chosen), rules=["r"])
    assert {r.stratum: r["count"] for r in judged.where("kept").groupBy("stratum").count().collect()} == {"a": 4000, "b": 20}


def test_copies_are_no_evidence(spark):
    rows = [(k, "a", 1, False, 0.05) for k in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, stratum string, text_hash long, base_failed boolean, r double")
    labels = table.selectExpr("doc_id", "1 as quality")
    assert quality.cutoffs(table, labels, rules=["r"]).count() == 0


def test_a_few_extreme_good_texts_do_not_lift_a_cutoff(spark):
    # 12 of 6,000 good texts are extreme; 200 bad ones stand in between.
    rows = [(k, "a", k, False, 1.0 if k < 12 else 0.05 if k < 6000 else 0.5) for k in range(6200)]
    table = spark.createDataFrame(rows, "doc_id long, stratum string, text_hash long, base_failed boolean, r double")
    labels = table.selectExpr("doc_id", "int(doc_id < 6000) as quality")
    chosen = quality.cutoffs(table, labels, rules=["r"])
    assert [(c.stratum, c.cutoff) for c in chosen.collect()] == [("a", 0.05)]
    assert quality.judge(table, chosen, rules=["r"]).where("kept").count() == 5988


def test_a_few_hundred_good_texts_give_every_rule_a_cutoff(spark):
    # Four strata of 300 good texts each: seven blocks, so the first two rules may pass over one extreme text.
    rules, rows = quality.RULES, []
    for k in range(1240):
        good, stratum = k < 1200, "abcd"[k % 4]
        values = [0.02 + (0.5 if good and r < 2 and k // 4 == 10 + r else 0.0) for r in range(5)]
        if not good:
            values[(k // 4) % 3] = 0.3
        rows.append((k, stratum, k, False, *values))
    table = spark.createDataFrame(rows, "doc_id long, stratum string, text_hash long, base_failed boolean, "
                                  + ", ".join(f"{r} double" for r in rules))
    chosen = quality.cutoffs(table, table.selectExpr("doc_id", "int(doc_id < 1200) as quality"))
    assert {(c.stratum, c.rule) for c in chosen.collect()} == {(s, r) for s in "abcd" for r in rules}
    kept = quality.judge(table, chosen).where("kept")
    assert kept.where("doc_id >= 1200").count() == 0
    assert min(r["count"] for r in kept.groupBy("stratum").count().collect()) >= 0.95 * 300


def test_blocks_are_bounded_exactly(spark):
    for n, share, level in [(20, 0.05, 0.0125), (85, 0.05, 0.0125), (86, 0.05, 0.0125), (300, 0.05, 0.0125), (5000, 0.01, 0.05)]:
        tails, total = [], 0.0
        for j in range(int(n * share) + 1):
            total += math.comb(n, j) * share ** j * (1 - share) ** (n - j)
            tails.append(total)
        found = spark.range(1).selectExpr(f"{n}L as n", f"ln({level}D) as level").select(quality._blocks("n", share, "level"))
        assert found.first()[0] == sum(t <= level for t in tails)
