"""What keeps the queries' cost in step with their tables: few shuffles, work over all tasks, lines read once."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotloom.functions import models
from lotloom.functions import normalise as n
from lotloom.operators import extract, market, matching, relation
from lotloom.plans import lines as product_plans
from lotloom.plans import market as plans
from lotloom.plans import rules
from lotloom.sources import tables
from lotloom.sources.shared import stored
from lotloom.sources.tables import lots, requirements
from lotloom.streaming import lists, refresh

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_board_is_one_shuffle_of_lots_and_requirements(spark, small_batches):
    demand = [(n, f"p{n % 3}", n % 4, 10 + 7 * (n % 5), 100, None, "2024-01-01") for n in range(60)]
    supply = [(f"p{n % 3}", None, n, n % 5, 3 + n % 11, 50 + n % 17, "DE", "2024-01-02") for n in range(90)]
    d = spark.createDataFrame(demand, "id int, want string, buyer long, wanted long, limit_cents long, currency string, asked_at string")
    s = spark.createDataFrame(supply, "want string, currency string, lot int, supplier long, quantity long, price_cents long, country string, seen_at string").selectExpr("*", "'exact' as kind")
    rows = market.filled(d, s, ["id"])
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    cut = sorted(map(str, rows.collect()))  # the lots of a product and its requirements lie in several batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(cut) == 60 and cut == sorted(map(str, market.filled(d, s, ["id"]).collect()))


def test_the_plain_board_meets_no_table_twice(spark):
    rows = matching.board(requirements(spark, SMALL), lots(spark, SMALL))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") == 2  # once for lots, once for requirements


def test_lines_of_the_market_are_read_by_all_tasks(spark, monkeypatch):
    files = {}

    def stored(df, name, made=plans.stored):
        out = made(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(plans, "stored", stored)
    plans.relations(plans.demand(spark, SMALL), plans.supply(spark, SMALL), plans.aliases(spark, SMALL))
    assert files["lines"] == int(spark.conf.get("spark.sql.shuffle.partitions"))


class Calls:
    """A state that counts how often it is called."""

    def __init__(self):
        self.calls, self.value, self.keys = 0, None, set()

    def getValueState(self, name, *schemas):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def containsKey(self, key):
        self.calls += 1
        return key in self.keys

    def updateValue(self, key, value):
        self.calls += 1
        self.keys.add(key)


def test_state_is_called_for_a_list_and_not_for_each_lot():
    one, state = lists.reconciler(), Calls()
    one.init(state)
    for turn, n in enumerate((1000, 900)):
        ids, known = np.arange(n), np.ones(n, np.int64)
        row = pd.DataFrame({"list_id": [f"l{turn}"], "at": [turn], "complete": [True], "identity": [ids], "quantity": [ids + turn], "price": [ids], "has_quantity": [known], "has_price": [known]})
        (log,) = one.handleInputRows(("t", 1, "sell"), iter([row, row]), None)  # delivered twice
        assert log["kind"].value_counts().to_dict() == ({"insert": 1000} if turn == 0 else {"update": 900, "close": 100})
    assert state.calls == 2 * 5


def test_lines_that_are_alike_are_read_once(spark):
    rows = spark.createDataFrame([(k, f"Nokia C{k % 3} 128GB Black", f"{k:013d}" if k % 4 else None, "b" if k % 2 else None) for k in range(40)], "p_partkey long, text string, ean_cell string, grade_cell string")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(product_plans.models, "with_product", lambda df, read=models.with_product: seen.append(df.count()) or read(df))
        got = product_plans.read_once(rows).select("p_partkey", "ean", "grade", "identity_key", "match_key").collect()
    assert seen == [6] and sorted(map(str, got)) == sorted(map(str, models.with_product(rows).select("p_partkey", "ean", "grade", "identity_key", "match_key").collect()))


def test_batches_of_the_board_come_from_stored_rows(spark, monkeypatch):
    read, kept = [], []
    monkeypatch.setattr(refresh.Board, "apply", lambda self, needs, lots_, batch: read.extend([*needs.inputFiles(), *lots_.inputFiles()]))
    monkeypatch.setattr(refresh.Board, "board", lambda self: kept.append(1) or plans.demand(spark, SMALL).selectExpr("buyer as id", "null as legs").where("false"))
    monkeypatch.setattr(plans, "legs_text", lambda: F.lit(""))
    with pytest.raises(Exception, match="state"):  # the stand-in for the board has no such column
        plans.stream_board(spark, SMALL)
    assert read and kept and not [f for f in read if f.startswith(f"file://{SMALL}")]


def test_a_batch_moves_no_standing_rows_of_the_board_but_their_hashes(spark, tmp_path, monkeypatch):
    known = spark.createDataFrame([("w1", "h1", "exact")], "want string, have string, kind string")
    held = refresh.Board(spark, f"file://{tmp_path}/board", lambda wants, haves: known.join(wants, "want").join(haves, "have"))
    needs = spark.range(20).selectExpr("id", "id % 3 as buyer", "'w1' as want", "5L as wanted", "300L as limit_cents", "'EUR' as currency", "timestamp '2024-01-01' as asked_at", "false as gone")
    offered = spark.range(9).selectExpr("id as lot", "10 + id as supplier", "'h1' as have", "2L as quantity", "100L + id as price_cents", "'EUR' as currency", "'DE' as country", "timestamp '2024-01-01' as seen_at", "false as gone")
    held.apply(needs, offered, 0)
    read = []
    monkeypatch.setattr(refresh.Board, "newest", lambda self, name, key, schema, below, only=None, made=refresh.Board.newest: read.append((name, schema, only)) or made(self, name, key, schema, below, only))
    assert held.apply(needs.where("id = 4").withColumn("gone", F.lit(True)), offered.where("lot = 2"), 1) == {"full": 0, "scope": 19, "written": 0, "deleted": 1}
    assert all(schema == "id long, hash string, first_matched long" or only is not None for name, schema, only in read if name == "board")
    assert held.board().count() == 19


def test_a_price_cell_is_read_once(spark):
    cell = F.col("id").cast("string")
    plan = lambda c: spark.range(1).select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(n.parse_price(cell)).count("regexp_extract(") == 1
    got = spark.createDataFrame([("1.234,50",), ("1,234.5",), ("1.234",), ("12,5 EUR",), ("1.2.3",), ("4006381333931",), ("x",), (None,)], "t string").select(n.parse_price(F.col("t"))).collect()
    assert [x[0] for x in got] == [1234.5, 1234.5, 1234.0, 12.5, 123.0, None, None, None]


def test_cells_of_one_long_list_are_read_by_all_tasks(spark, monkeypatch):
    files = {}

    def stored(df, name, made=extract.stored):
        out = made(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(extract, "stored", stored)
    rows = [("k", "list", 0, ["Product", "Price"]), *(("k", "list", x, [f"Nokia C{x} 128GB", f"{x}.50"]) for x in range(1, 200))]
    got = extract.extract_rows(spark.createDataFrame(rows, "key string, source string, row_idx int, cells array<string>").coalesce(1)).collect()
    assert len(got) == 199 and files["named"] == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lots_take_tasks_by_their_lines(spark, monkeypatch):
    usual = sorted(map(str, lots(spark, SMALL).collect()))
    monkeypatch.setattr(tables, "LINES_A_TASK", -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 9))
    assert re.search(r"hashpartitioning\(l_suppkey#\d+L?, l_partkey#\d+L?, 9\)", lots(spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(str, lots(spark, SMALL).collect())) == usual


def test_allocation_moves_lines_twice(spark):
    plan = rules.allocation_check(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("lineitem.parquet") == 1  # by deal (orders too), by part


def test_what_lines_say_is_no_broadcast(spark):
    rows = stored(models.with_product(spark.createDataFrame([(k, f"Nokia C{k % 9} {64 * (1 + k % 4)}GB Black") for k in range(60)], "n int, text string")), "lines")
    pairs = relation.met(rows.withColumnRenamed("n", "w"), rows.withColumnRenamed("n", "h"), "w", "h")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3  # keys, wanted lines, offered lines; of hot keys there are few
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "key#" not in x]
    assert pairs.count() == sum(a % 9 == b % 9 for a in range(60) for b in range(60))


def test_lots_and_requirements_of_the_market_move_by_part_and_by_line_alone(spark, monkeypatch):
    read = set()
    monkeypatch.setattr(plans, "relations", lambda demanded, offered, alias, made=plans.relations: read.update([*demanded.inputFiles(), *offered.inputFiles()]) or made(demanded, offered, alias))
    rows = plans.board(spark, SMALL)
    assert {f.rsplit("/", 1)[1] for f in read} == {"part.parquet"}  # lines hang on the parts
    plan = rows._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # beside the parts and the known lines: lots by part, requirements by part, both by line; orders are small here
    assert plan.count("lineitem.parquet") == 2 and sorted(moved) == ["have", "l_partkey", "l_partkey", "p_partkey", "p_partkey", "want"] and not re.search(r"want#\d+,.*hashpartitioning", plan)
    assert dict(rows.dtypes)["legs"].startswith("array") and rows.count() == requirements(spark, SMALL).count()
