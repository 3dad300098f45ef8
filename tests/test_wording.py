"""Names, colours, grades, quoted history, near misses and the folds."""

from pyspark.sql import functions as F

from lotloom.functions import decisions
from lotloom.functions import wording as w
from lotloom.operators import near, reconcile

from .test_core import values


def test_names(spark):
    rows = spark.createDataFrame([("Smalltronic SpA", "Inesa Smalltronic"), ("Trinity Electronics Poland", "Trinity"), ("International Trading", "International Trading"), (None, "x"), ("Größe GmbH", "größe")], "a string, b string")
    assert [r[0] for r in rows.select(w.company_matches(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]


def test_colours_grades_markets(spark):
    cases = {"space grey": "Space Gray", "Titanium-Blue": "Blue Titanium", "dark GREY": "Dark Gray", "prod red": "Product Red", "": None, "mint": "Mint", None: None}
    assert values(spark, list(cases), w.colour) == list(cases.values())
    assert values(spark, ["A+ grade", "(b)", "GRADE  A +", "14 day", "", None], w.grade) == ["A+", "B", "A+", None, None, None]
    rows = spark.createDataFrame([("LL/A", "US"), ("HN/A", "INDIA"), ("ZD/A", "LL/A"), ("NON-EU", "ZD/A"), ("NON-EU", "US"), (None, "EU")], "a string, b string")
    assert [r[0] for r in rows.select(w.regions_conflict(F.col("a"), F.col("b"))).collect()] == [False, False, True, True, False, False]


def test_quoted_history(spark):
    cases = {
        "hi\nS25 €500\n\nOn Tue, A wrote:\n> old €1": "hi\nS25 €500",
        "see\nOn Tue, A wrote:\nS25 €500\nS24 €400": "see\nOn Tue, A wrote:\nS25 €500\nS24 €400",
        "see\n-- Original Message --\n-- Forwarded message --\nx": "see\n-- Original Message --\n-- Forwarded message --\nx",
        "a\n> b\n> c\n> d": "a", "plain > text": "plain > text", "": "", None: None,
    }
    assert values(spark, list(cases), w.without_quoted_history) == list(cases.values())


def test_near_misses(spark):
    rows = spark.createDataFrame(
        [("apple:iphone 15", "apple:iphone 15", 128, 128, "Black", "black"), ("apple:iphone 15", "apple:iphone 15", 128, None, "Black", "Blue"), ("samsung:s25", "samsung:s25 ultra", 128, 128, None, "Blue"), ("samsung:s25", "samsung:s25 ultra", 128, 256, "Red", "Blue"), ("samsung:s25", "apple:s25", 1, 1, None, None), ("samsung:s25", "samsung:s25 5g", 1, 2, None, None)],
        "r string, s string, r_capacity int, s_capacity int, r_colour string, s_colour string",
    )
    tokens = lambda c: F.split(F.element_at(F.split(c, ":"), 2), " ")
    rows = rows.withColumn("relation", near.model_relation(F.col("r"), F.col("s"), tokens("r"), tokens("s")))
    assert [r.relation for r in rows.collect()] == ["same", "same", "close", "close", None, None]
    assert sorted((r.s, [d.name for d in r.differences]) for r in near.near_misses(rows).collect()) == [("apple:iphone 15", ["capacity", "colour"]), ("samsung:s25 ultra", [])]


def test_scores_and_folds(spark):
    s = near.score(*[F.col(c) for c in "m f w n c x u".split()])
    rows = spark.createDataFrame([(1000.0, 10, 10, 1, False, False, False), (1000.0, 5, 10, 3, True, True, False), (None, 5, 10, 1, False, True, True)], "m double, f int, w int, n int, c boolean, x boolean, u boolean")
    assert [round(r[0], 6) for r in rows.select(s).collect()] == [1000.0, round(1000 * 0.95**2 * 0.9 * 0.85 * 0.5, 6), round(-1 + 0.9 * 0.5 * 0.5 * 0.8, 6)]
    options = spark.createDataFrame([([(k, [s]) for k, s in enumerate([1, 1, 2, 1, 1, 1, 3, 2, 3])],)], "o array<struct<k:int,suppliers:array<bigint>>>")
    assert [o.k for o in options.select(near.stored_options(F.col("o")).alias("v")).first().v] == [0, 1, 2, 3, 4, 6]
    lines = spark.createDataFrame([("a", 1, "s", 3, 615), ("a", 2, "s", 4, 615), ("a", 3, "s", 7, 615), ("b", 1, "", 3, 5), ("b", 2, "", 4, 5), ("c", 1, "s", 3, 5), ("c", 2, "s", 4, 6), ("d", 1, None, None, None)], "id string, position int, batch string, quantity int, price_cents long")
    assert sorted(tuple(r) for r in near.once(lines, ["id"]).collect()) == [("a", 7, 615, 1, 1), ("b", 3, 5, 0, 1), ("c", 3, 5, 0, 1), ("d", None, None, 0, 0)]


def test_brands(spark):
    cases = {"Galaxy Watch Ultra (SM-L705F)": "Samsung", "Watch Ultra 3 LTE": "Apple", "A576 5G DS": "Samsung", "M404 printer": None, "Mot. Edge": "Motorola", "WH-1000XM5": "Sony", "Ultra Flair 64GB": "SanDisk", None: None}
    assert values(spark, list(cases), w.brand) == list(cases.values())


def test_scope(spark):
    rows = [(i, c, e) for e, cs in {"one": ["phone"] * 30 + ["tablet"] * 3 + ["cable"] + [None], "two": ["tv"] * 5, "three": [None]}.items() for i, c in enumerate(cs, {"one": 0, "two": 100, "three": 200}[e])]
    live = spark.createDataFrame(rows, "id int, category string, email string")
    got = lambda *a: {r.id for r in reconcile.list_scope(live, *a).collect()}
    assert got(["phone"]) == set(range(35)) and got(["tv"]) == set(range(100, 105)) and got([None]) == {34, 200}
    assert got(["phone"], ["tablet"]) == set(range(30)) | {33, 34} and got([None], [None]) == set() and got(["cable"]) == set()


def test_confidence(spark):
    rows = spark.createDataFrame([("S25 Ultra", True, 1.0, False, "EUR", False, 5, False, "sell"), ("one two three", False, None, None, None, None, None, None, "sell"), ("x", False, 1.0, True, None, False, 5, True, "buy"), (" ", True, 1.0, False, "EUR", True, 1, False, "sell")], "d string, k boolean, p double, a boolean, c string, s boolean, q int, v boolean, side string")
    assert [r[0] for r in rows.select(decisions.confidence(*map(F.col, rows.columns))).collect()] == [
        {"description": 1.0, "price": 1.0, "currency": 1.0, "quantity": 1.0, "overall": 1.0},
        {"description": 0.7, "price": 0.5, "quantity": 0.85, "overall": 0.5},
        {"description": 0.4, "price": 0.45, "currency": 0.3, "quantity": 0.6, "overall": 0.3},
        {"description": 0.0, "price": 1.0, "currency": 0.75, "quantity": 1.0, "overall": 0.0},
    ]


def test_near_misses_of_parts_by_class(spark, tmp_path):
    from lotloom.plans.queries import match_near_miss

    words = [("Red x", 1), ("red y", 1), ("blue x", 1), ("blue", 2), ("blue", 2), (None, 1), ("red", None)]
    parts = [(k, "b", "t", size, name) for k, (name, size) in enumerate(words)] + [(90, None, "t", 1, "red"), (91, "c", "t", 1, "red")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = match_near_miss(spark, str(tmp_path)).collect()
    of = {x.r: x.s for x in rows if x.kind == "member"}
    pairs = {(x.r, x.s): x.differences for x in rows if x.kind == "pair"}
    assert of == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 91: 91}
    for r, (name, size) in enumerate(words):
        for s, (other, there) in enumerate(words):
            colour = name is not None and other is not None and name.lower().split()[0] != other.lower().split()[0]
            assert pairs.get((of[r], of[s]), "") == ",".join(["capacity"] * (size != there) + ["colour"] * colour)


def test_near_misses_are_all_pairs_of_parts(spark, tmp_path, monkeypatch):
    from lotloom.plans import queries

    monkeypatch.setattr(queries, "CLASS_ROW", 3)
    parts = [(k, "b", "t", k % 3 or None, (None, "red x", "Red y", "blue")[k % 4]) for k in range(30)] + [(90, "b", "t", 1, "red"), (90, "b", "t", 2, "red"), (91, "c", "t", 1, "red")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((x.r, x.s, x.differences) for x in queries.match_near_miss(spark, str(tmp_path)).collect() if x.kind == "pair")
    want = []
    for r, brand, _, size, name in parts:
        for s, other_brand, _, there, other in parts:
            colour = name is not None and other is not None and name.lower().split()[0] != other.lower().split()[0]
            if brand == other_brand and r != s and (size != there or colour):
                want.append((r, s, ",".join(["capacity"] * (size != there) + ["colour"] * colour)))
    assert got == sorted(want)
