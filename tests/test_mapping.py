"""Answers about unnamed columns, held against the cells."""

from lotloom.operators import mapping

GRID = "key string, source string, row_idx int, cells array<string>"


def made(spark, tables):
    return spark.createDataFrame([(key, "s", k, cells) for key, rows in tables.items() for k, cells in enumerate(rows)], GRID)


ROWS = [["n/a", "Nokia C1 128GB", "12.50", "3"], ["", "", "", ""], ["call", "Nokia C2 128GB", "13,50", "4"], ["tba", "Nokia C3 128GB", "on request", "5"]]


def test_what_is_asked(spark):
    grid = made(spark, {"x": [["Zaa", " ZBB", "c", None], *ROWS], "y": [["zaa", "zbb ", "C", ""], *ROWS], "bare": ROWS, "read": [["Zaa"], *ROWS], "thin": [["q"], ["r"]]})
    heads = spark.createDataFrame([("read", "s")], "key string, source string")
    tables = mapping.unread(grid, heads)
    got = {r.key: (r.head, r.signature, r.width, len(r.sample)) for r in tables.collect()}
    assert got == {"x": (0, "4:zaa|zbb|c|", 4, 3), "y": (0, "4:zaa|zbb|c|", 4, 3), "bare": (-1, "4:", 4, 3)}
    known = spark.createDataFrame([("4:", None)], "signature string, fields map<string,int>")
    assert [r.signature for r in mapping.to_ask(tables, known).collect()] == ["4:zaa|zbb|c|"]


def test_answers_are_held_against_cells(spark):
    answers = {
        "all": ([("description", 1), ("price", 2), ("quantity", 3), ("brand", 0)], "accepted", {"description": 1, "price": 2, "quantity": 3, "brand": 0}), "barcode": ([("description", 1), ("price", 2), ("ean", 3)], "half", {"description": 1, "price": 2}),
        "twice": ([("description", 1), ("price", 1), ("price", 2), ("nonsense", 3), ("quantity", 9), ("quantity", -1)], "accepted", {"description": 1, "price": 2}), "words": ([("description", 1), ("price", 0)], "refused", None),
        "no price": ([("description", 1), ("quantity", 3)], "accepted", {"description": 1, "quantity": 3}), "one fact": ([("description", 1)], "refused", None), "codes": ([("description", 0), ("price", 2)], "refused", None), "empty": ([], "refused", None),
    }
    grid = made(spark, {name: [[name, "Z", "c", ""], *ROWS] for name in answers})
    tables = mapping.unread(grid, spark.createDataFrame([], "key string, source string"))
    rows = spark.createDataFrame([(f"4:{name}|z|c|", [{"field": f, "at": at} for f, at in claims]) for name, (claims, _, _) in answers.items()], "signature string, answer array<struct<field: string, at: int>>")
    verdicts = mapping.judged(tables, rows)
    assert {r.key: (r.verdict, r.fields) for r in verdicts.collect()} == {name: x[1:] for name, x in answers.items()}
    known = spark.createDataFrame([("4:all|z|c|", {"description": 7})], "signature string, fields map<string,int>")
    kept = {r.signature: r.fields for r in mapping.remembered(known, verdicts).collect()}
    assert len(kept) == len(answers) and kept["4:all|z|c|"] == {"description": 7} and kept["4:words|z|c|"] is None
