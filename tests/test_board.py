"""The board against the reference rule in plain Python: every option of a requirement, then the best."""

from fractions import Fraction
from itertools import combinations

from lotloom.operators import matching
from lotloom.plans.registry import QUERIES
from lotloom.sources.tables import lots, requirements

from .test_core import market


def all_options(wanted, limit, supply):
    """(score, rank, filled, suppliers used, margin, newest) of each option; supply: (price, supplier, quantity, country, seen_at), cheapest first."""

    def made(kind, places):
        left, cost, used = wanted, 0, []
        for p in places:
            take = min(left, supply[p][2])
            if take:
                left, cost = left - take, cost + take * supply[p][0]
                used.append(p)
        filled, who = wanted - left, {supply[p][1] for p in used}
        score = Fraction(limit * filled - cost) * Fraction(95, 100) ** (len(who) - 1)
        score *= Fraction(9, 10) if len({supply[p][3] for p in used} - {None, ""}) > 1 else 1
        score *= Fraction(85, 100) if left else 1
        return score, [-kind, *[-p for p in places]], filled, who, limit * filled - cost, max(supply[p][4] for p in used)

    out = [made(0, (p,)) for p in range(len(supply))]
    if all(x[2] < wanted for x in supply):
        seen = []
        for size in (2, 3):
            for group in combinations(range(min(8, len(supply))), size):
                if sum(supply[p][2] for p in group) >= wanted and not any(set(s) <= set(group) for s in seen):
                    seen.append(group)
                    out.append(made(size - 1, group))
        chosen, met, left = [], set(), wanted
        for p, x in enumerate(supply):
            if left > 0 and (x[1] in met or len(met) < 3):
                chosen, left = [*chosen, p], left - min(left, x[2])
                met.add(x[1])
        if len(chosen) > 1:
            out.append(made(3, tuple(chosen)))
    return out


def expected(req, sup, supplier=None):
    out, by_part = {}, {}
    for x in sup:
        by_part.setdefault(x["part"], []).append((x["price_cents"], x["supplier"], x["quantity"], x["country"], x["seen_at"]))
    for r in req:
        supply = sorted(x for x in by_part.get(r["part"], []) if x[1] != r["buyer"] and x[2] > 0)
        options = [o for o in all_options(r["wanted"], r["limit_cents"], supply) if supplier is None or supplier in o[3]]
        if options:
            best = max(options, key=lambda o: o[:2])
            out[r["buyer"], r["part"]] = (best[2], len(best[3]), best[4], best[2] < r["wanted"], best[5])
    return out


def best(frame):
    return {(r.buyer, r.part): (r.filled, r.suppliers, r.total_margin, r.short, r.seen_at) for r in frame.collect()}


def test_best_option_of_a_supplier(spark):
    for seed in (1, 2):
        req, sup, *_ = market(spark, seed)
        more = spark.createDataFrame([(s, p, "Z", 3, 60, "2024-01-03") for s in (6, 7) for p in range(6)], sup.schema)  # more lots of one supplier
        sup = sup.unionByName(more)
        rows = [x.asDict() for x in req.collect()], [x.asDict() for x in sup.collect()]
        for supplier in (None, 6, 19):
            assert best(matching.best_option(req, sup, supplier)) == expected(*rows, supplier)


def test_supplier_beyond_the_pool_can_help(spark):
    req = spark.createDataFrame([(1, 1, 50, 100, "b", "c", "2024-01-01")], market(spark)[0].schema)
    sup = spark.createDataFrame([(s, 1, "X", 2, 10 + s, "2024-01-02") for s in range(10, 18)] + [(99, 1, "X", 50, 80, "2024-01-02")], market(spark)[1].schema)
    assert [(r.supplier, r.filled) for r in matching.best_option(req, sup, 99).selectExpr("99 as supplier", "filled").collect()] == [(99, 50)]


def test_unknown_prices(spark):
    req = spark.createDataFrame([(1, 1, 50, None, "b", "c", "2024-01-01"), (1, 2, 50, 100, "b", "c", "2024-01-01")], market(spark)[0].schema)
    sup = spark.createDataFrame([(10, 1, "X", 50, None, "2024-01-02"), (11, 1, "X", 45, 90, "2024-01-02"), (12, 2, "X", 50, None, "2024-01-02"), (13, 2, "X", 5, 99, "2024-01-02")], market(spark)[1].schema)
    assert {(r.part, r.filled, r.total_margin) for r in matching.best_option(req, sup).collect()} == {(1, 45, None), (2, 5, 5)}


def test_supplier_filter_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [[x.asDict() for x in f(spark, sf_dir).collect()] for f in (requirements, lots)]
    got = {(r.buyer, r.part): (r.filled, r.suppliers) for r in QUERIES["board_supplier_filter"](spark, sf_dir).collect()}
    assert got == {k: v[:2] for k, v in expected(*rows, 7).items()}


def test_board_takes_lots_beyond_the_pool(spark):
    req = spark.createDataFrame([(1, 1, 50, 100, "b", "c", "2024-01-01"), (1, 2, 5, 100, "b", "c", "2024-01-01")], market(spark)[0].schema)
    sup = spark.createDataFrame([(s, 1, "X", 2, 10 + s, "2024-01-02") for s in range(10, 18)] + [(99, 1, "X", 50, 80, "2024-01-03")], market(spark)[1].schema)
    rows = {r.part: (r.state, r.filled, r.suppliers, r.total_margin, r.matched_at) for r in matching.board(req, sup).collect()}
    assert rows == {1: ("filled", 50, 1, 1000, "2024-01-03"), 2: ("no_supply", 0, 0, None, None)}


def test_board_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    req, sup = ([x.asDict() for x in f(spark, sf_dir).collect()] for f in (requirements, lots))
    want = expected(req, sup)
    rows = QUERIES["board_rows"](spark, sf_dir).collect()
    assert len(rows) == len(req)
    for r in rows:
        filled, suppliers, margin, short, _ = want.get((r.buyer, r.part), (0, 0, None, False, None))
        state = "no_supply" if (r.buyer, r.part) not in want else "short" if short else "filled"
        assert (r.state, r.filled, r.suppliers, r.total_margin) == (state, filled, suppliers, margin)
