"""Offers and requests in running text, line by line."""

from lotloom.operators import prose


def rows(spark, frame):
    return [tuple(r)[1:] for r in sorted(frame.collect(), key=lambda r: (r[0], r[1], str(r)))]


def messages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, body string")


def test_requests(spark):
    body = "Dell\nOnePlus\nNord CE6 128GB\n16 128gb\nApple\n16 128gb mix\n16 colours 7\n2           Google Pixel 10\n2 Pixel 9\nab\n0 units of iPad 9\n200000 units of iPad 10\n" + "word " * 14 + "iphone\nthank you\niPhone 12"
    got = rows(spark, prose.requests(messages(spark, body, None, "", "Thanks\niPhone 13", "regardless iPhone 14\nBR\niPad"), ["id"], "body").drop("source_ref"))
    assert got == [
        (3, "OnePlus Nord CE6 128GB", None, "OnePlus"), (4, "OnePlus 16 128gb", 16, "OnePlus"), (6, "Apple iPhone 16 128gb mix", None, "Apple"), (8, "Google Pixel 10", 2, "Google"), (9, "2 Pixel 9", None, "Google"),
        (11, "iPad 9", None, "Apple"), (12, "iPad 10", None, "Apple"), (1, "regardless iPhone 14", None, "Apple"),
    ]


def test_offers(spark):
    body = "*12* *€ 9* Nokia 3310\n*x* *288* *5* Galaxy S23 €1.234,50 each\nGalaxy S24 with 12 lines and no money\n€5\n*€45*  \nRedmi 12 4/128 - 99,5 EUR DAP"
    got = rows(spark, prose.offers(messages(spark, body, None, ""), ["id"], "body").select("id", "number", "description", "quantity", "price", "currency", "incoterm", "price_basis"))
    assert got[0] == (1, "Nokia 3310", 12, 9.0, "EUR", None, "unknown") and got[1] == (2, "Galaxy S23 each", 288, 1234.5, "EUR", None, "per_unit")
    assert got[2][0] == 6 and got[2][3:] == (99.5, "EUR", "DAP", "unknown") and len(got) == 3


def test_long_message_and_other_columns(spark):
    many = spark.createDataFrame([(1, "\n".join(f"iPhone {11 + k % 6} 128GB x{1 + k % 9}" for k in range(3000)), "a")], "id int, body string, line string")
    assert prose.requests(many, ["id"], "body").count() == 3000 and prose.offers(many, ["id"], "body").count() == 0
    assert prose.requests(many.limit(0), ["id"], "body").count() == 0


def test_names_product(spark):
    frame = spark.createDataFrame([(1, "hi", "the lift is out of order"), (2, "Stock of iPad", None), (3, None, "5 pcs Xperia 1"), (4, None, "anything for €500 here"), (5, "", "")], "id int, subject string, body string")
    assert {r.id: r.names_product for r in prose.named_any(frame, ["id"], "subject", "body").collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
