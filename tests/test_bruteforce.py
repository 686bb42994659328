"""Randomized checks against brute-force Python versions of the semantics
(per key: sort, take the first n_a - n_b rows; sums per key)."""

import random
from collections import defaultdict
from decimal import Decimal

from tallyspark.operators import reconcile as rec


def _ledgers(seed, n_a=400, n_b=300, keys=12):
    rnd = random.Random(seed)
    # one key gets most rows, to exercise the hot-key path
    pick = lambda: "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(keys)}"
    a = [(pick(), Decimal(rnd.randrange(1, 5)), i) for i in range(n_a)]
    b = [(pick(), Decimal(rnd.randrange(1, 5)), i) for i in range(n_b)]
    rnd.shuffle(a)
    rnd.shuffle(b)
    return a, b


def _expected_multiset(a, b):
    ga, gb = defaultdict(list), defaultdict(list)
    for r in a:
        ga[(r[0], r[1])].append(r)
    for r in b:
        gb[(r[0], r[1])].append(r)
    out = []
    for key in set(ga) | set(gb):
        ra, rb = sorted(ga[key], key=lambda r: r[2]), sorted(gb[key], key=lambda r: r[2])
        out += [("only_a",) + r for r in ra[: max(0, len(ra) - len(rb))]]
        out += [("only_b",) + r for r in rb[: max(0, len(rb) - len(ra))]]
    return sorted(out)


def test_multiset_diff_bruteforce(spark):
    for seed in range(3):
        a, b = _ledgers(seed)
        da = spark.createDataFrame(a, "k string, amt decimal(18,2), d int")
        db = spark.createDataFrame(b, "k string, amt decimal(18,2), d int")
        exp = _expected_multiset(a, b)
        got = sorted((r.outcome, r.k, r.amt, r.d) for r in rec.multiset_diff(da, db, ["k", "amt"], ["d"], ["d"]).collect())
        assert got == exp, seed


def test_reconcile_sums_bruteforce(spark):
    a, b = _ledgers(7)
    a = [("" if r[2] % 13 == 0 else r[0], r[1], r[2]) for r in a]
    da = spark.createDataFrame(a, "k string, amt decimal(18,2), d int")
    db = spark.createDataFrame(b, "k string, amt decimal(18,2), d int")
    sa, sb = defaultdict(lambda: [0, Decimal(0)]), defaultdict(lambda: [0, Decimal(0)])
    for k, amt, _ in a:
        if k != "":
            sa[k][0] += 1
            sa[k][1] += amt
    for k, amt, _ in b:
        sb[k][0] += 1
        sb[k][1] += amt
    exp = {}
    for k in set(sa) | set(sb):
        (na, xa), (nb, xb) = sa[k], sb[k]
        if na != nb or abs(xa - xb) > Decimal("0.01"):
            exp[k] = ("only_a" if nb == 0 else "only_b" if na == 0 else "both_differ", na - nb, xa - xb)
    empty = [r for r in a if r[0] == ""]
    exp[""] = ("only_a_empty_id", len(empty), sum(r[1] for r in empty))
    got = {r.k: (r.outcome, r.delta_rows, r.delta_sum) for r in rec.reconcile_sums(da, db, "k", "k").collect()}
    assert got == exp
