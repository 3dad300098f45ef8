"""Lists and boards as streams against the rule in plain Python and full rebuilds."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from lotloom.operators import market
from lotloom.plans.registry import ORACLE_SQL, QUERIES
from lotloom.streaming import lists, refresh

LIST = "tenant string, counterparty long, side string, list_id string, at timestamp, complete boolean, lines array<struct<identity: long, quantity: long, price_cents: long>>"


def plain(rows):
    """(standing lots, log kinds) after lists in the order of the batches, and in each by time."""
    state, newest, met, log = {}, {}, set(), []
    for batch in rows:
        for tenant, who, side, list_id, at, complete, lines in sorted(batch, key=lambda r: (r[4], r[3])):
            sender, first = (tenant, who, side), {}
            if (sender, list_id) in met:
                continue
            met.add((sender, list_id))
            for identity, quantity, price in lines or []:
                first.setdefault(identity, (quantity, price))
            if not first:
                continue
            late, live = at < newest.get(sender, at), [k for k, v in state.items() if k[:3] == sender and v[0]]
            for identity, values in first.items():
                was = state.get((*sender, identity))
                if was is None or not late:
                    log.append((list_id, identity, "insert" if was is None else "reopen" if not was[0] else "refresh" if was[1] == values else "update"))
                    state[*sender, identity] = (True, values)
            if complete and not late and len(first) >= 0.5 * len(live):
                for key in live:
                    if key[3] not in first:
                        state[key] = (False, state[key][1])
                        log.append((list_id, key[3], "close"))
            newest[sender] = max(at, newest.get(sender, at))
    return {(*k, live, *values) for k, (live, values) in state.items()}, sorted(log)


def test_streamed_lists_are_the_rule(spark, tmp_path):
    rng = random.Random(0)
    batches = []
    for b in range(4):
        batch = []
        for k in range(9):
            at = datetime(2024, 1, 10) + timedelta(hours=rng.randint(0, 60) + 20 * b)
            lines = [(rng.randint(1, 6), rng.randint(1, 2), rng.choice([100, None])) for _ in range(rng.choice([0, 1, 3, 4, 7]))]
            batch.append(("t", rng.randint(1, 2), rng.choice(["sell", "sell", "buy"]), f"l{b}-{k}", at, rng.choice([True, True, None, False]), rng.choice([lines, lines, lines, None])))
        batches.append(batch)
    batches.append(batches[1])  # delivered again
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, LIST).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        lists.logged(spark.readStream.schema(LIST).parquet(str(tmp_path / "in" / "*")), out, state).awaitTermination()
    log = spark.read.schema(lists.LOG).parquet(out)
    want, kinds = plain(batches)
    assert {(r.tenant, r.counterparty, r.side, r.identity, r.live, r.quantity, r.price_cents) for r in lists.standing(log).collect()} == want
    assert sorted((r.list_id, r.identity, r.kind) for r in log.collect()) == kinds
    assert {k for _, _, k in kinds} == {"insert", "update", "refresh", "reopen", "close"}


def test_a_list_is_taken_back_from_the_log(spark):
    row = lambda list_id, step, identity, kind, q, p, oq, op: ("t", 1, "sell", list_id, datetime(2024, 1, step), step, identity, kind, q, p, oq, op)
    log = spark.createDataFrame([
        row("a", 1, 1, "insert", 5, 10, None, None), row("a", 1, 2, "insert", 5, 10, None, None), row("a", 1, 3, "insert", 5, 10, None, None), row("a", 1, 4, "insert", 1, 1, None, None), row("a", 1, 6, "insert", 1, 1, None, None),
        row("b", 2, 1, "update", 6, 11, 5, 10), row("b", 2, 2, "close", None, None, 5, 10), row("b", 2, 3, "update", 7, 10, 5, 10), row("b", 2, 5, "insert", 9, 9, None, None), row("b", 2, 4, "refresh", 1, 1, 1, 1), row("b", 2, 6, "close", None, None, 1, 1),
        row("c", 3, 3, "update", 8, 10, 7, 10), row("c", 3, 6, "reopen", 1, 2, 1, 1),
    ], lists.LOG)
    back = lambda name: {(r.identity, r.undo, r.quantity, r.price_cents) for r in lists.taken_back(log, name).collect()}
    assert back("b") == {(1, "restored", 5, 10), (2, "reopened", 5, 10), (5, "withdrawn", None, None)}
    assert back("c") == {(3, "restored", 7, 10), (6, "closed", 1, 1)} and back("a") == {(4, "withdrawn", None, None)}


def test_stored_board_is_a_full_rebuild_after_each_batch(spark, tmp_path):
    rng = random.Random(9)
    known = spark.createDataFrame([(f"w{k}", f"h{k}", "exact") for k in range(5)] + [(f"w{k}", f"h{k + 1}", "near") for k in range(4)], "want string, have string, kind string")
    held = refresh.Board(spark, f"file://{tmp_path}/board", lambda wants, haves: known.join(wants, "want").join(haves, "have"))
    when = datetime(2024, 1, 1)
    needs = {k: (k, rng.randint(1, 6), f"w{rng.randint(0, 5)}", rng.choice([None, 5, 20]), rng.choice([None, 300]), "EUR", when) for k in range(25)}
    lots = {k: (k, rng.randint(1, 6), f"h{rng.randint(0, 5)}", rng.randint(0, 9), rng.choice([None, 100, 200]), "EUR", "DE", when) for k in range(12)}
    need, lot = refresh.REQUIREMENT, refresh.LOT
    empty = lambda schema: spark.createDataFrame([], f"{schema}, gone boolean")

    def rebuilt():
        return sorted(map(str, market.board(spark.createDataFrame(list(needs.values()), need), spark.createDataFrame(list(lots.values()), lot), known, ["id"]).collect()))

    def now():
        return sorted(map(str, held.board().drop("hash", "first_matched").collect()))

    counts = [held.apply(spark.createDataFrame([(*x, False) for x in needs.values()], f"{need}, gone boolean"), spark.createDataFrame([(*x, False) for x in lots.values()], f"{lot}, gone boolean"), 0)]
    assert counts[0]["full"] == 1 and now() == rebuilt()
    lots[2], lots[40] = (2, lots[2][1], lots[2][2], 7, 50, "EUR", "DE", when), (40, 3, "h1", 6, 150, "EUR", "FR", when)
    change = spark.createDataFrame([(*lots[2], False), (*lots[40], False)], f"{lot}, gone boolean")
    counts += [held.apply(empty(need), change, 1), held.apply(empty(need), change, 1)]
    assert counts[1] == counts[2] and 0 < counts[1]["scope"] < 25 and counts[1]["full"] == 0 and now() == rebuilt()
    dead, gone = needs.pop(3), lots.pop(2)
    step = spark.createDataFrame([(dead, None, True, 1), (None, gone, True, 1)], f"requirement struct<{need.replace(' ', ':').replace(',:', ',')}>, lot struct<{lot.replace(' ', ':').replace(',:', ',')}>, gone boolean, at long")
    held.step(step, 2)
    assert now() == rebuilt()
    assert held.apply(empty(need), empty(lot), 3) == {"full": 0, "scope": 0, "written": 0, "deleted": 0}
    held.fingerprint = "other"
    assert held.apply(empty(need), empty(lot), 4) == {"full": 1, "scope": 24, "written": 0, "deleted": 0} and now() == rebuilt()
    first = {r.id: r.first_matched for r in held.board().collect()}
    assert all((first[r.id] is not None) >= (r.state in ("filled", "short")) for r in held.board().collect()) and set(first.values()) <= {None, 0, 1}


def test_copies_of_a_batch_go_with_it(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(refresh, "stored", lambda df, name, stored=refresh.stored: made.append(stored(df, name)) or made[-1])
    held = refresh.Board(spark, f"file://{tmp_path}/board", lambda wants, haves: spark.createDataFrame([("w", "h", "exact")], "want string, have string, kind string"))
    needs = spark.range(5).selectExpr("id", "id as buyer", "'w' as want", "5L as wanted", "300L as limit_cents", "'EUR' as currency", "timestamp '2024-01-01' as asked_at", "false as gone")
    lots = spark.range(4).selectExpr("id as lot", "10 + id as supplier", "'h' as have", "2L as quantity", "100L + id as price_cents", "'EUR' as currency", "'DE' as country", "timestamp '2024-01-01' as seen_at", "false as gone")
    held.apply(needs, lots, 0)
    assert not made  # a single delta is what holds now
    assert held.apply(needs.where("id = 1").withColumn("wanted", F.lit(2).cast("long")), lots.where("lot = 0").withColumn("gone", F.lit(True)), 1) == {"full": 0, "scope": 5, "written": 5, "deleted": 0}
    assert made and not [f for x in made for f in x.inputFiles() if Path(f.removeprefix("file://")).exists()]
    assert {len(r.hash) for r in held.board().collect()} == {refresh.DIGITS}


def test_stream_board_tells_large_part_numbers_from_buyers(spark, tmp_path):
    """A part beyond a million of one buyer is not a small one of the next buyer."""
    small, sf_dir, con = "/root/testdata/sf0.001", str(tmp_path), duckdb.connect()
    shift = "case when {0} // 8 % 2 = 0 then {0} + 1000000 else {0} end as {0}"
    for t, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        con.execute(f"copy (select * replace ({shift.format(key)}) from read_parquet('{small}/{t}.parquet')) to '{sf_dir}/{t}.parquet' (format parquet)")
    # each part is asked for by a small group of buyers, so that numbers of neighbours would meet
    con.execute(f"copy (select * replace (o_custkey % 4 as o_custkey) from read_parquet('{small}/orders.parquet')) to '{sf_dir}/orders.parquet' (format parquet)")
    for t in ("nation", "supplier"):
        con.execute(f"copy (select * from read_parquet('{small}/{t}.parquet')) to '{sf_dir}/{t}.parquet' (format parquet)")
    for t in ("nation", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = [r.asDict() for r in QUERIES["stream_board"](spark, sf_dir).collect()]
    cur = con.execute(ORACLE_SQL["stream_board"])
    columns = [c[0] for c in cur.description]
    assert max(r["part"] for r in got) > 1_000_000 and sorted(str([r[c] for c in columns]) for r in got) == sorted(str(list(x)) for x in cur.fetchall())
