"""Summaries and bare prices against the rules in plain Python."""

import random
from collections import defaultdict

from lotloom.operators import sheets

ROW = "message int, grid string, id int, description_key string, capacity_gb int, price_cents long, currency string, availability string, grade string, colour string, quantity int"


def plain(rows):
    """(covered ids, ids of summary sheets)"""
    grids, covered, summary = defaultdict(list), set(), set()
    for r in rows:
        grids[r[0], r[1]].append(r)
    key = lambda r: (r[3] or "", r[4], r[5], (r[6] or "").upper(), r[7] or "", (r[8] or "").upper())
    for (message, grid), members in grids.items():
        if any(r[9] for r in members):
            continue
        detail = defaultdict(list)
        for (m, g), others in grids.items():
            if m == message and g != grid and any(r[9] for r in others):
                for o in others:
                    detail[key(o)].append(o[10])
        mine = [r[2] for r in members if (q := detail.get(key(r))) is not None and (r[10] is None or (known := [x for x in q if x is not None]) and sum(known) == r[10])]
        covered |= set(mine)
        if len(mine) >= 3 and len(mine) >= 0.6 * len(members):
            summary |= {r[2] for r in members}
    return covered, summary


def test_summaries_of_chance_are_the_rule(spark):
    rng = random.Random(6)
    rows = []
    for message in range(30):
        for grid in range(rng.randint(1, 4)):
            coloured = rng.random() < 0.5
            for _ in range(rng.randint(1, 8)):
                rows.append((message, f"g{grid}", len(rows), rng.choice(["a", "b", None]), rng.choice([64, None]), rng.choice([100, 100, None]), rng.choice(["EUR", "eur"]), rng.choice([None, ""]), None, rng.choice(["Red", "", None]) if coloured else rng.choice(["", None]), rng.choice([None, 1, 2, 3])))
    for k in range(4):  # four products by colour and in all, and a line of the latter that is nowhere else
        rows += [(99, "by colour", len(rows) + n, f"p{k}", 64, 100, "EUR", None, "A", c, 2 + n) for n, c in enumerate(("Red", "Blue"))]
        rows.append((99, "in all", len(rows), f"p{k}", 64, 100, "eur", "", "a", None, 5))
    rows.append((99, "in all", len(rows), "else", 64, 100, "eur", "", "a", None, 5))
    frame = spark.createDataFrame(rows, ROW)
    got = sheets.summary_coverage(frame, "message", "grid").collect()
    covered, summary = plain(rows)
    assert {r.id for r in got if r.covered} == covered and {r.id for r in got if r.summary} == summary and covered & summary and covered - summary and summary - covered
    assert {r.id for r in sheets.without_summaries(frame, "message", "grid").collect()} == {r[2] for r in rows} - (covered & summary)
    assert sheets.without_summaries(frame.limit(0), "message", "grid").count() == 0


def test_bare_prices(spark):
    whole = lambda rates: [(k, f"{b}", [(code, f"{b * rate:.2f}") for code, rate in rates]) for k, b in enumerate((985, 120, 77.5))]
    cases = {
        "band": ([(n, p, o) for n, p, o in whole([("EUR", 1.19), ("USD", 1.35)])], ("band", "GBP", None)),
        "equal": (whole([("USD", 1.1), ("EUR", 1.0)]), ("equal", "EUR", None)),
        "ambiguous": (whole([("USD", 1.22)]), ("switched", "USD", 0)),
        "one row": (whole([("EUR", 1.19)])[:1], ("switched", "EUR", 0)),
        "scattered": ([(0, "100", [("EUR", "119")]), (1, "100", [("EUR", "150")])], ("switched", "EUR", 0)),
        "no other fits": (whole([("EUR", 9.0), ("USD", 1.35)]), ("switched", "EUR", 0)),
        "late rows": ([*whole([("EUR", 1.19)]), *((80 + k, "100", [("EUR", "900")]) for k in range(5))], ("band", "GBP", None)),
        "blanks": ([*whole([("EUR", 1.19)]), (5, "", [("EUR", "3")]), (6, None, [("EUR", None)]), (7, "call", [("EUR", "call")])], ("band", "GBP", None)),
    }
    rows = [(name, *r) for name, (some, _) in cases.items() for r in some]
    cells = spark.createDataFrame(rows, "grid string, n int, price string, others array<struct<code: string, price: string>>")
    assert {r.grid: (r.how, r.currency, r.column) for r in sheets.bare_currency(cells, "grid").collect()} == {name: want for name, (_, want) in cases.items()}
    got = {(r.grid, r.n): (r.amount, r.currency) for r in sheets.priced(cells, "grid").collect()}
    assert got["ambiguous", 0] == (1201.7, "USD") and got["band", 1] == (120.0, "GBP") and got["blanks", 6] == (None, "GBP")
