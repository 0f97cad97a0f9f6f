import hashlib
import random
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from geomarket.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PARTS = ["a", "B.", "@", "x-1", ".", "..", "1", "255", "256", "0007", " ", "-", "+", "(", ")", "é", "４", "\n", "4111 1111 1111 1111",
         "+1 (743) 555-3824", "1.2.3.4", "me@b.co", "%", "12345678901234567890"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@example("1.2.3.4.5.6.7.8.9")
@example("a@b@c.d.e@f.g")
@example("@a.b x@.c y@d-.e.")
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + "(" * 300_000, "@" * 200_000):
        pii.base_spans(text)


@pytest.fixture
def corpus(spark):
    # "zanzibar" stands only in lines with one address; "common" everywhere; copies of one line count once.
    rows = [(k, f"line {k}x about zanzibar{'' if k else '!'} common and 10.0.0.{k % 2}\nother {k} common words") for k in range(0, 8, 2)]
    rows += [(k, f"nothing here, common text {k}") for k in range(20, 30)]
    rows += [(k, "mail me@here.org copied phrase") for k in range(40, 50)] + [(60, None), (61, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_revealing_terms_are_found(corpus):
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    for r in pii.find_personal_data(corpus).collect():
        text = texts[r.doc_id]
        base = plain(text)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        terms = [m.span() for m in re.finditer("zanzibar|about|line", text) if len(m.group()) >= pii.TERM_BYTES]
        spans = sorted([*base, *[(s, 4, e) for s, e in terms]])
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.n_term == len(terms) and (r.n_ip, r.n_email) == tuple(sum(k == n for _, k, _ in base) for n in (1, 0))


def test_texts_are_sanitised(corpus, odd_docs, no_docs):
    clean = {r.doc_id: r.text for r in pii.sanitise(corpus).collect()}
    assert clean[2] == "  2x  common and [IP]\nother 2 common words".replace("  2x  ", " 2x   ")
    assert clean[41] == "mail [EMAIL] copied phrase" and clean[60] is None and clean[61] == ""
    done = pii.sanitise(odd_docs)
    assert done.schema.simpleString() == odd_docs.schema.simpleString()
    assert sorted(map(str, done.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.sanitise(no_docs).count() == pii.find_personal_data(no_docs).count() == 0
    assert pii.find_personal_data(odd_docs).count() == odd_docs.count()


def listed(texts):
    """Revealing terms by counting every pair, one line for each text."""
    lines = {}
    for text in texts:
        spans = plain(text)
        for start, _, end in reversed(spans):
            text, found = text[:start] + " " + text[end:], text[start:end]
            lines.setdefault(None, set()).add(found)
        entities = lines.pop(None, set())
        lines.setdefault(text, set()).update(entities)
    holds = {line: set(re.findall("[a-z0-9]{4,}", line)) for line in lines}
    with_term = {t: [x for x in holds if t in holds[x]] for x in holds for t in holds[x]}
    out = set()
    for term, where in with_term.items():
        both = max((sum(e in lines[x] for x in where) for x in where for e in lines[x]), default=0)
        if both >= pii.SUPPORT and len(where) <= both * 2 ** pii.BITS:
            out.add(term)
    return out


def test_terms_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for k in range(120):
        some = rng.sample([f"10.0.0.{n}" for n in range(12)], rng.randrange(4))
        texts.append(" ".join([f"n{k}", *rng.sample([f"word{n}" for n in range(60)], 6), *[f"near{e[7:]}x" for e in some[:1]], *some]))
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    terms = set()
    for r in found:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        terms |= {texts[r.doc_id][int(s):int(e)] for kind, s, e in spans if kind == "term"}
    assert terms and terms == listed(texts)


def test_a_long_list_on_one_line_makes_no_pair_for_each_two(spark):
    rows = [(k, f"list{k} " + " ".join(f"name{n} u{n}@host.org" for n in range(400))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = pii._first_pass(docs.select(*pii._identity(docs)))
    assert first.where("sort > 0").count() <= 3 * (400 + 400 + 1)
    found = pii.find_personal_data(docs).collect()
    assert [(r.n_email, r.n_term) for r in found] == [(400, 400)] * 3
