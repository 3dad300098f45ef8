"""The trading-list operators: rules by table, brute force for joins, and the queries against their SQL."""

import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lotloom.functions import decisions
from lotloom.functions import normalise as n
from lotloom.operators import extract, matching, reconcile
from lotloom.plans.registry import ORACLE_SQL, QUERIES
from lotloom.sources import grids
from lotloom.streaming import board


def values(spark, texts, function):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", function(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.k)]


def test_prices(spark):
    cases = {"1,234.50": 1234.5, "1.234,50": 1234.5, "109,50": 109.5, "1.079": 1079.0, "12,500": 12500.0, "15.4705199": 15.4705199, "€ 95": 95.0, "1.234.567": 1234567.0, "4006381333931": None, "call": None, "": None, None: None}
    assert values(spark, list(cases), n.parse_price) == list(cases.values())
    assert values(spark, ["1.079", "1,079", "12"], lambda c: n.parse_price(c, "dot")) == [1.079, 1079.0, 12.0]
    assert values(spark, ["1.079", "1,079"], lambda c: n.parse_price(c, "comma")) == [1079.0, 1.079]
    marked = {"A57 5G 8/128GB *288* Navy *259€*": 259.0, "STICK 840414699953 €24,50": 24.5, "200x 95,- EUR": 95.0, "no price 128": None, None: None}
    assert values(spark, list(marked), n.find_price) == list(marked.values())


def test_quantities_and_codes(spark):
    cases = {"qty: 40": 40, "Quantity 12": 12, "128GB 30 pcs": 30, "40x iPhone": 40, "(MX/A) 200x 95": 200, "iPhone x40": 40, "Moto X30 Pro": None, "25": 25, "1,000": 1000, "1.5k": 1500, "200x": 200, "50+": 50, ">50": 50, "min 50": 50, "0": None, "999999": None, "128GB": None, None: None}
    assert values(spark, list(cases), n.quantity) == list(cases.values())
    codes = {"4006381333931": "4006381333931", "840414699953": "0840414699953", "04006381333931": "4006381333931", "12345678": "12345678", "1234567": None, "ean 4006381333931": None, None: None}
    assert values(spark, list(codes), n.ean) == list(codes.values())


def test_money_words(spark):
    assert values(spark, ["12 USD", "€12", "12 dirhams", "12$", "x", None, "AED or USD"], lambda c: n.currency(c, "CAD")) == ["USD", "EUR", "AED", "CAD", None, None, "AED"]
    assert values(spark, ["per lot, each", "2 each", "2"], n.price_basis) == ["per_lot", "per_unit", "unknown"]
    assert values(spark, ["exw dubai", "DDPX", None], n.incoterm) == ["EXW", None, None]
    assert values(spark, ["ex vat", "incl. VAT", "+ VAT incl", ""], n.vat_included) == [False, True, False, None]


def test_sides(spark):
    cases = [("WTB list", "", "buy", 0.95), ("WTS price list", "we buy", "sell", 0.95), ("Acme Offer", "", "sell", 0.9), ("Acme Request", "", "buy", 0.9), ("WTS / WTB", "we buy we buy for sale", "buy", 0.6), ("hello", "for sale", "sell", 0.7), ("", None, None, 0.0), (None, "rfq rfq wts", "buy", 0.6)]
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, s string, b string").select("k", n.classify_side(F.col("s"), F.col("b")).alias("v")).orderBy("k").collect()
    assert [(r.v.side, r.v.confidence) for r in rows] == [c[2:] for c in cases]


def test_tables_nested_in_layout():
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    inner = "<table>" + row("a", "b&amp;") * 4 + "</table>"
    assert grids.html_tables("<table>" + row("Dear") + row(inner) * 1 + row("x") + row("y") + "</table>") == [("table 2", [["a", "b&"]] * 4)]
    small = "<table>" + row("in", "ner") + "</table>"
    assert grids.html_tables("<table>" + row("x", "text " + small) + row("y", " ") * 3 + "</table>")[0][1][0] == ["x", "text in ner"]
    assert grids.html_tables("<table>" + row(small) * 4 + "</table>") == [("table 1", [["in", "ner"]] * 4)]
    assert grids.html_tables(None) == grids.html_tables("<table><tr><td>a") == []


def test_workbooks(spark):
    made = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Model</t></si><si><t>Qty</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/><row r="3"><c r="A3" t="inlineStr"><is><t>Phone</t></is></c><c r="C3"><v>50.0</v></c></row></sheetData></worksheet>')
    frame = spark.createDataFrame([(1, bytearray(made.getvalue())), (2, bytearray(b"junk")), (3, None)], "id int, data binary")
    assert sorted((r.id, r.source, r.row_idx, r.cells) for r in grids.xlsx_grids(frame, "id", "data").collect()) == [(1, "!S", 0, ["Model", "", "Qty"]), (1, "!S", 1, ["Phone", "", "50"])]


def test_extract_rows(spark):
    cells = [["Hello", ""], ["Marke", "Modell", "Menge", "Preis"], ["Phones", ""], ["A", "One 5G", "10", "€1.079"], ["A", "Two", "", ""], ["Marke", "Modell", "Menge", "Preis"], ["Tablets"], ["B", "Three", "", "95 USD"], ["", "TOTAL", "10", "5"]]
    frame = spark.createDataFrame([("k", "s", i, c) for i, c in enumerate(cells)] + [("none", "s", 0, ["x", "y"])], "key string, source string, row_idx int, cells array<string>")
    got = sorted((r.description, r.quantity, r.price, r.currency, r.section, r.source_ref) for r in extract.extract_rows(frame).collect())
    assert got == [("One 5G", 10, 1079.0, "EUR", "Phones", "s row 4"), ("Three", None, 95.0, "USD", "Tablets", "s row 8")]


def market(spark, seed=1):
    rng = random.Random(seed)
    req = [(b, p, rng.randint(1, 60), rng.randint(50, 150), "b", "c", "2024-01-01") for b in range(12) for p in range(6) if rng.random() < 0.6]
    sup = [(s, p, rng.choice("XY"), rng.randint(0, 30), rng.randint(40, 140), "2024-01-02") for s in range(5, 20) for p in range(6) if rng.random() < 0.5]
    return spark.createDataFrame(req, "buyer long, part long, wanted long, limit_cents long, brand string, category string, asked_at string"), spark.createDataFrame(sup, "supplier long, part long, country string, quantity long, price_cents long, seen_at string"), req, sup


def test_fills_and_combinations_by_brute_force(spark):
    frame_r, frame_s, req, sup = market(spark)
    fills = {(r.buyer, r.part): (r.filled, r.cost) for r in matching.fills(frame_r, frame_s).collect()}
    sweeps = {(r.buyer, r.part): (r.filled, r.legs) for r in matching.sweep(frame_r, frame_s).collect()}
    pairs = {(r.buyer, r.part, r.supplier_a, r.supplier_b) for r in matching.pairs(frame_r, frame_s).collect()}
    triples = {(r.buyer, r.part, r.supplier_a, r.supplier_b, r.supplier_c) for r in matching.triples(frame_r, frame_s).collect()}
    want_p, want_t = set(), set()
    for b, p, wanted, *_ in req:
        lots = sorted((c, s, q) for s, x, _, q, c, _ in sup if x == p and s != b and q > 0)
        left, cost = wanted, 0
        for c, _, q in lots:
            take = min(left, q)
            left, cost = left - take, cost + take * c
        assert fills.get((b, p)) == ((wanted - left, cost) if lots else None)
        left, legs = wanted, 0
        for _, _, q in lots[:3]:
            legs += left > 0
            left -= min(left, q)
        assert sweeps.get((b, p)) == ((wanted - left, legs) if legs >= 2 else None)
        if lots and max(q for *_, q in lots) < wanted:
            pool = lots[:8]
            two = {(i, j) for i in range(len(pool)) for j in range(i + 1, len(pool)) if pool[i][2] + pool[j][2] >= wanted}
            want_p |= {(b, p, pool[i][1], pool[j][1]) for i, j in two}
            want_t |= {(b, p, pool[i][1], pool[j][1], pool[k][1]) for i in range(len(pool)) for j in range(i + 1, len(pool)) for k in range(j + 1, len(pool)) if pool[i][2] + pool[j][2] + pool[k][2] >= wanted and not {(i, j), (i, k), (j, k)} & two}
    assert pairs == want_p and triples == want_t


def test_refreshed_board_equals_full_rebuild(spark):
    rng = random.Random(7)
    frame_r, frame_s, req, sup = market(spark, 7)
    stored = matching.board(frame_r, frame_s)
    for _ in range(3):
        touched = {rng.randrange(6) for _ in range(2)}
        sup = [r for r in sup if r[1] not in touched or rng.random() < 0.7] + [(50 + rng.randrange(99), p, "Z", rng.randint(1, 40), 45, "2024-02-01") for p in touched]
        new = spark.createDataFrame(sup, frame_s.schema)
        got = board.refreshed(stored, frame_r, new, spark.createDataFrame([(p,) for p in touched], "part long"))
        full = matching.board(frame_r, new)
        assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))
        assert board.changes(stored, got).where(~F.col("part").isin(list(touched))).count() == 0
        stored = spark.createDataFrame(got.collect(), got.schema)


def test_reconcile_guards(spark):
    old = spark.createDataFrame([(1, p, 5, 100) for p in range(10)] + [(2, p, 5, 100) for p in range(4)], "supplier long, part long, quantity long, price_cents long")
    new = spark.createDataFrame([(1, 0, 5, 100), (1, 1, 6, 100), (1, 2, 5, 600), (2, 0, 5, None), (2, 1, 5, 100), (2, 9, 1, 1)], old.schema)
    kinds = {(r.supplier, r.part): (r.kind, r.needs_review) for r in reconcile.actions(old, new).collect()}
    assert kinds[1, 0] == ("refresh", False) and kinds[1, 1] == ("update", False) and kinds[1, 2] == ("update", True)
    assert kinds[1, 5] == ("keep", False), "three rows of ten close nothing"
    assert kinds[2, 2] == ("close", False) and kinds[2, 9] == ("insert", False) and kinds[2, 0] == ("update", False)
    assert not reconcile.actions(old, new, None).where("kind = 'close'").count()
    assert not reconcile.actions(old, new, False).where("kind = 'close'").count()
    assert {(r.field, r.old, r.new) for r in reconcile.field_changes(reconcile.actions(old, new)).collect() if r.part == 2} == {("price", "100", "600"), ("status", "live", "sold")}
    assert {r.kind for r in reconcile.actions(old, old).collect()} == {"refresh"}


def test_decisions(spark):
    rows = spark.createDataFrame([(0, 10, True, False, False), (3, None, True, False, True), (3, 4, True, False, False), (3, 20, False, False, False), (30, 40, False, True, False), (30, 40, False, False, False), (5, None, False, False, False)], "n int, typical int, c boolean, p boolean, w boolean")
    got = [r[0] for r in rows.select(decisions.completeness(*map(F.col, rows.columns))).collect()]
    assert got == [None, None, True, None, False, True, None]
    v = spark.createDataFrame([("applied", 10, 0, 10, 0), ("failed", 10, 0, 10, 0), ("applied", 10, 3, 10, 0), ("applied", 5, 0, 10, 0), ("applied", 8, 0, 10, 0), ("applied", 10, 1, None, 0), ("applied", 10, 0, None, 1)], "s string, n int, f int, b int, w int")
    assert [r[0] for r in v.select(decisions.verdict(*map(F.col, v.columns))).collect()] == ["healthy", "suspect", "suspect", "suspect", "check", "check", "check"]


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, t string")
    first.write.parquet(source)
    for more in ([(2, "b"), (3, "c")], []):
        stream = spark.readStream.schema(first.schema).parquet(source)
        board.replay(stream, ["id", "t"], out, state).awaitTermination()
        if more:
            spark.createDataFrame(more, first.schema).write.mode("append").parquet(source)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("name", ["match_best_single", "board_tiles", "reconcile_actions", "list_fingerprint", "identity_key", "extract_rows"])
def test_queries_agree_with_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cur.fetchall()))


def test_lots_are_ordered_once_for_each_product(spark):
    frame_r = spark.createDataFrame([(1, 5, 10, 100), (2, 5, 3, 100), (3, 5, 50, None), (9, 6, 4, 80)], "buyer long, part long, wanted long, limit_cents long")
    frame_s = spark.createDataFrame([(1, 5, 4, 60, "A", 1), (2, 5, 8, 90, "B", 2), (4, 5, 6, None, "A", 3), (9, 6, 4, 10, "A", 1)], "supplier long, part long, quantity long, price_cents long, country string, seen_at int")
    for f in (matching.best_single, matching.fills, matching.sweep, matching.pairs, matching.triples):
        plan = f(frame_r, frame_s)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort [" not in plan and "buyer#" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    best = {r.buyer: (r.supplier, r.take, r.score) for r in matching.best_single(frame_r, frame_s).collect()}
    assert best == {1: (2, 8, 6800), 2: (1, 3, 12000), 3: (4, 6, None)}
    fills = {r.buyer: (r.filled, r.suppliers, r.cost, r.countries, r.seen_at) for r in matching.fills(frame_r, frame_s).collect()}
    assert fills == {1: (10, 2, 720, 2, 3), 2: (3, 1, 180, 1, 1), 3: (18, 3, 960, 2, 3)}
    assert {r.buyer: r.filled for r in matching.fills(frame_r, frame_s, 1).collect()} == {1: 8, 2: 3, 3: 4}
