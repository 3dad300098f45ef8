"""Operators of senders, lists, headers, deals and keyed tables on small tables, odd rows too."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotloom.operators import attribution, deals, extract, lists, senders, sinks


def test_mapped_columns(spark):
    heads = [
        (["Model", "Qty", "Price", "Euro", "USD$", "Incoming"], {"description": 0, "quantity": 1, "price": 2}, {"EUR": 3, "USD": 4}, None, False),
        (["Part No", "EAN", "Preis €", "Memory", "Color"], {"code": 0, "ean": 1, "price": 2, "capacity": 3, "colour": 4}, {}, "EUR", True),
        (["Item no", "Model", "Price", "All prices in GBP"], {"code": 0, "description": 1, "price": 2}, {"GBP": 3}, None, False),
        (["Model", "Qty", "Price", "(EUR)"], {"description": 0, "quantity": 1, "price": 2}, {"EUR": 3}, None, False),
        ([], {}, {}, None, False),
    ]
    frame = spark.createDataFrame([(k, h[0]) for k, h in enumerate(heads)], "k int, cells array<string>")
    for row in frame.orderBy("k").select("k", extract.mapped_columns(F.col("cells")).alias("m")).collect():
        want = heads[row.k]
        assert (row.m.fields, row.m.other_prices, row.m.currency, row.m.code_is_part_number) == want[1:], want


def test_extraction_carries_availability_and_columns(spark):
    cells = [["Model", "Qty", "Price EUR", "Memory", "Grade", "Part No"], ["Incoming - ETA 7-15 days"], ["Galaxy A", "5", "100", "128", "A", "P1"], ["In stock"], ["Galaxy B", "6", "90", "", "", ""], ["total", "11", "", "", "", ""]]
    grid = spark.createDataFrame([(1, "Lists_plain", k, c) for k, c in enumerate(cells)], "key int, source string, row_idx int, cells array<string>")
    got = {r.description: r for r in extract.extract_rows(grid).collect()}
    assert set(got) == {"Galaxy A", "Galaxy B"}
    a, b = got["Galaxy A"], got["Galaxy B"]
    assert (a.availability, a.availability_note, a.currency, a.capacity, a.part_number, a.grade) == ("incoming", "ETA 7-15 days", "EUR", "128", "P1", "A")
    assert (b.availability, b.availability_note, b.part_number) == (None, None, None)
    titled = extract.extract_rows(grid.where("row_idx <> 1 and row_idx <> 3").withColumn("source", F.lit("pre-order sheet"))).collect()
    assert {r.availability for r in titled} == {"incoming"} and extract.extract_rows(grid.limit(0)).count() == 0


@pytest.mark.parametrize(("subject", "company"), [("New Way  - Request", "New Way"), ("FW: Reline Offer", "Reline"), ("offer", None), ("12 offer", None), ("hello there", None), (None, None)])
def test_company_in_subject(spark, subject, company):
    assert spark.createDataFrame([(subject,)], "s string").select(senders.company_in_subject(F.col("s"))).first()[0] == company


def test_gate_and_message_ids(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([(1, "a@x.example", " Subject ", at, "body "), (2, "a@x.example", "subject", at, " body"), (3, "a@x.example", "subject", at, "other text"), (4, None, None, None, None)], "k int, s string, t string, at timestamp, b string")
    ids = {r.k: r.id for r in rows.select("k", attribution.message_id(F.col("s"), F.col("t"), F.col("at"), F.col("b")).alias("id")).collect()}
    assert ids[1] == ids[2] != ids[3] and ids[4]
    assert [r[0] for r in rows.select(attribution.kept_by_gate(F.lit("Angebot"), F.col("b"), F.lit(None).cast("boolean"))).collect()] == [True] * 4


def test_lateness_of_lists(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    arriving = spark.createDataFrame([(1, 7, "sell", t(1, 9), ["phone", "tablet"]), (2, 7, "sell", t(3, 9), [""]), (3, 8, "sell", t(1, 9), ["phone"])], "id int, sender int, side string, at timestamp, habits array<string>")
    applied = spark.createDataFrame([(7, "sell", t(2, 8), True, ["phone"]), (7, "sell", t(1, 12), True, ["tablet"]), (7, "buy", t(5, 1), True, None), (7, "sell", t(4, 1), None, None)], "sender int, side string, at timestamp, whole boolean, categories array<string>")
    got = {r.id: (r.superseded, r.behind, r.late) for r in lists.lateness(arriving, applied).collect()}
    assert got == {1: (["phone"], True, True), 2: ([], True, True), 3: ([], False, False)}
    kept = spark.createDataFrame([("phone", ["phone"], ["phone"]), ("phone", ["phone"], []), ("tv", ["phone"], ["phone"]), (None, ["phone", "tablet"], ["phone"]), (None, [""], [""])], "c string, h array<string>, s array<string>")
    assert [r[0] for r in kept.select(lists.keeps_row(F.col("c"), F.col("h"), F.col("s"))).collect()] == [False, True, False, True, False]


def test_notes_read_back_and_other_text_does_not(spark):
    texts = ["decision: add (rules) -- a · b || ; then more", "decision: replace (rules, confirmed by the checker) -- a ||", "applied", None, "decision: add -- x"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(lists.parsed_note(F.col("t"))).collect()]
    assert [g and (g.action, g.decided_by, g.reasons, g.rest) for g in got] == [("add", "rules", ["a", "b"], "then more"), ("replace", "rules, confirmed by the checker", ["a"], ""), None, None, None]


def test_held_lists(spark):
    schema = "supplier int, part int, quantity int, price_cents int"
    held = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 6, 10), (1, 3, 1, 1)], schema)
    live = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 5, 10), (1, 4, 2, 2)], schema)
    of = lambda answer, chosen=None: {(r.part, r.kind) for r in lists.held_settled(held, live, ["supplier", "part"], answer, chosen).collect()}
    assert of("same") == {(1, "refresh"), (2, "refresh")} and of("new") == {(1, "refresh"), (2, "update"), (3, "insert"), (4, "close")}
    assert of("partial", held.where("part >= 2")) == {(2, "update"), (3, "insert")} and of("partial", held.limit(0)) == set()
    with pytest.raises(ValueError):
        of("other")


def test_each_held_list_has_its_own_guard(spark):
    """Supplier 1 sends 1 row beside 10 live lots and closes none; supplier 2 sends 9 beside 2; supplier 3 holds nothing and keeps all."""
    schema = "supplier int, part int, quantity int, price_cents int"
    held = spark.createDataFrame([(1, 0, 5, 10), *((2, k, 5, 10) for k in range(9))], schema)
    live = spark.createDataFrame([*((1, k, 5, 10) for k in range(10)), (2, 0, 5, 10), (2, 99, 5, 10), (3, 1, 5, 10)], schema)
    got = {(r.supplier, r.part) for r in lists.held_settled(held, live, ["supplier", "part"], "new", of=["supplier"]).where("kind = 'close'").collect()}
    assert got == {(2, 99)}


def test_deals(spark):
    legs = spark.createDataFrame([(1, "buy", 2, 10), (1, "sell", 2, 15), (2, "buy", 1, 1), (3, "buy", 1, None), (3, "sell", 1, 5)], "deal int, side string, quantity int, price_cents int")
    assert {(r.deal, r.margin) for r in deals.margins(legs, "deal").collect()} == {(1, 10), (2, None), (3, None)}
    asks = spark.createDataFrame([(0, 5, 0), (5, None, 3), (5, None, 0), (5, 9, 5), (4, 9, 5), (4, 9, 0)], "w int, lot int, e int")
    got = [tuple(r.v) for r in asks.select(deals.allocation(F.col("w"), F.col("lot"), F.col("e")).alias("v")).collect()]
    assert got == [(False, None, None), (True, None, "committed elsewhere"), (True, None, "no stated quantity"), (False, 4, None), (True, 0, "committed elsewhere"), (True, 5, None)]
    ages = spark.createDataFrame([(dt.datetime(2024, 1, 9, h),) for h in (1, 5)], "t timestamp")
    assert [r[0] for r in ages.select(deals.freshness(F.col("t"), F.lit("2024-01-10 02:00:00").cast("timestamp"))).collect()] == ["recent", "today"]


def test_keyed_tables(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("z", None), ("s", "s")], "from_key string, to_key string")
    assert {tuple(r) for r in sinks.effective_aliases(edges).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("p", "p"), ("q", "q"), ("s", "s")}  # keys on a circle stay themselves
    assert sinks.effective_aliases(edges.limit(0)).count() == 0
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in sinks.appended_once(table, spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "y")}
    offers = spark.createDataFrame([(1, "e1", "live"), (2, "e0", "sold"), (3, "e0", "sold"), (4, "e0", "live")], "offer_id int, source_email_id string, status string")
    log = spark.createDataFrame([(2, "e1", "status", "live", "sold"), (3, "e9", "status", "live", "sold"), (4, "e1", "price", "1", "2")], "offer_id int, email_id string, field string, old string, new string")
    assert {(r.offer_id, r.status) for r in sinks.rejected(offers, log, "e1").collect()} == {(1, "withdrawn"), (2, "live"), (3, "sold"), (4, "live")}
    seen = sinks.touched(offers.withColumn("seen", F.lit(0)), spark.createDataFrame([(1,), (2,), (1,)], "offer_id int"), ["offer_id"], "seen", F.lit(9))
    assert {(r.offer_id, r.seen) for r in seen.collect()} == {(1, 9), (2, 0), (3, 0), (4, 0)}
