import hashlib
import re

import numpy as np
import pytest
from helpers import EDGES, documents, edges, empty, sample

from txnspark.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            odd, even = digits[-1::-2], digits[-2::-2]
            luhn = (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
            if (kind == "email" or kind == "ip" and all(
                    int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), n, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


HARD = ["a@b.c@d.e", "a@b@c.d x@y", "..a+b%@x-.y.z..", "a@b.c.@d.ef", "@x.y a@.b", "1.2.3.4.5.6.7.8",
        "256.1.1.1 01.002.255.0", "1.2.3 .4", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
        "4111  1111 1111 1111", "+1 (504) 555-8283", "+1 (504) 555-8283 170.106.4.9", "++49 1 2",
        "+4 ((((5 6 7 8 9 0 1 2", "12345678901234567890", "a@b.c" * 5, "é@b.cd 1@2.3",
        "5500000000000004-", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7", "1.1.1.1@2.2.2.2"]


def test_base_spans_equal_the_patterns(spark):
    texts = HARD + [r["text"] for r in sample(spark, 1000).collect()]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("a1.@+- (%5"), 40)) for _ in range(3000)]
    for t in texts:
        found = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(t)]
        assert found == brute(t), t


def check(rows, texts):
    left = list(texts)
    for r in rows:
        options = [t for i, t in left if i == r["doc_id"]]
        t = next(t for t in options if hashlib.sha256(",".join(brute(t)).encode()).hexdigest()
                 == r["base_sha256"])
        left.remove((r["doc_id"], t))
        base = brute(t)
        counts = [sum(s.startswith(k + ":") for s in base) for k, _ in PATTERNS]
        assert counts == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans)
        places = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert places == sorted(places)
    assert not left


def test_whole_table_and_edges(spark):
    given = sample(spark, 1000)
    check(pii.find_personal_data(given).collect(),
          [(r["doc_id"], r["text"]) for r in given.collect()])
    check(pii.find_personal_data(edges(spark)).collect(), [(i, t) for i, t, *_ in EDGES])
    assert pii.find_personal_data(empty(spark)).collect() == []


def test_the_chain_finds_what_the_patterns_miss_and_leaves_clean_texts(spark):
    missed = ["please call (504) 555-2283 tonight", "phone: 555-010-7781 or write",
              "mail jörg@muster.example now", "card 4111.1111.1111.1111 was stolen",
              "call +1 (843) 555-7672 170.106.4.9 at once"]
    clean = ["Version 2.0. of 3. parts in 1998.", "token = \"e93ae105146691ae697923a219be4d\" ok",
             "12 of 30 pages, 4.5% of 1,200", "sum 99887766554433221", "see you at 10:30 on 4/5/21",
             "order 55120931 shipped", "@home by 9"]
    rows = [(i, t, "en", "s") for i, t in enumerate(missed + clean)]
    table = sample(spark, 300).union(documents(spark, [(r[0] + 5000, *r[1:]) for r in rows]))
    found = {r["doc_id"] - 5000: r["spans"] for r in pii.find_personal_data(table).collect()}
    for i in range(len(missed)):
        assert found[i], missed[i]
    assert [c for i, c in enumerate(clean) if found[len(missed) + i]] == []


def test_viterbi_is_the_best_path():
    from itertools import product
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=(20, 4, 5)), rng.normal(size=(5, 5))
    states, margin = pii.viterbi(e, trans)
    for i in range(20):
        price = {p: sum(e[i, t, s] for t, s in enumerate(p)) + sum(
            trans[a, b] for a, b in zip(p, p[1:])) for p in product(range(5), repeat=4)}
        best = max(price, key=price.get)
        assert tuple(states[i]) == best
        assert margin[i] == pytest.approx(price[best] - price[(0,) * 4])


def test_training_lowers_the_loss_and_separates():
    runs = pii._example_runs()
    weights, trans = pii.fit(runs)
    right = total = 0
    for features, gold, _ in runs:
        states, _ = pii.viterbi(pii._emissions(weights, [features]), trans)
        right += (states[0] == np.array(gold)).sum()
        total += len(gold)
    assert right / total > 0.97


def test_long_runs_stay_linear():
    text = "1" * 200_000 + " " + "@" * 20_000 + " " + "a" * 200_000 + " " + "1.1." * 20_000
    assert pii.base_spans(text) is not None
    assert len(list(pii.candidate_runs(text))) == 2
