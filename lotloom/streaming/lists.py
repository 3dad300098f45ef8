"""Lists as a stream, reconciled against what each sender has live: state by tenant, counterparty and side.

A list is one row with its lines, so it is applied whole. The state of a sender is its lots as they stand, as columns
that are read and written once a batch, and not by a call for each lot; what comes out is the append-only log of what
each list did, from which the live lots follow and by which a list can be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.reconcile import LEAST_SHARE

SENDER = ["tenant", "counterparty", "side"]
#: Input: SENDER, list_id, at, complete (true, false or null), lines (identity, quantity, price_cents).
LOG = "tenant string, counterparty long, side string, list_id string, at timestamp, step int, identity long, kind string, quantity long, price_cents long, old_quantity long, old_price_cents long"


def reconciler() -> StatefulProcessor:
    """The processor, of a class of its own that goes to its workers whole: one of them is on the driver and has no shipped archive."""

    class Reconciler(StatefulProcessor):
        """Applies a sender's lists in order of ``at`` and list_id; lists met before are left aside.

        A list older than one that was applied only brings lots that are not known; it reprices, reopens and closes
        nothing. Closing needs a list that is whole and not shorter than half of what is live. An empty list is a
        failed reading and does nothing.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            # lots: whole numbers by identity: identity, whether it is live, quantity, price, and whether each of these two is known
            self.state = handle.getValueState("state", "at long, step int, lots binary")
            self.met = handle.getMapState("met", "list_id string", "at long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            was = self.state.get()
            newest, step = was[:2] if was else (None, 0)
            known = np.frombuffer(was[2], np.int64).reshape(6, -1).copy() if was else np.zeros((6, 0), np.int64)
            log = []
            for one in pd.concat(list(rows)).sort_values(["at", "list_id"], kind="stable").itertuples():
                if self.met.containsKey((one.list_id,)):
                    continue
                self.met.updateValue((one.list_id,), (int(one.at),))
                ids, first = np.unique(np.asarray(one.identity, np.int64), return_index=True)
                if not len(ids):
                    continue
                new = np.stack([ids, np.ones_like(ids), *(np.asarray(x, np.int64)[first] for x in (one.quantity, one.price, one.has_quantity, one.has_price))])
                late, whole = newest is not None and one.at < newest, one.complete is not None and bool(one.complete)
                place = np.searchsorted(known[0], ids)
                there = np.zeros(len(ids), bool)
                there[place < known.shape[1]] = known[0, place[place < known.shape[1]]] == ids[place < known.shape[1]]
                place = place[there]
                kinds, old = np.full(len(ids), "insert", object), np.zeros_like(new)
                old[:, there] = known[:, place]
                kinds[there] = np.where(old[1, there] == 0, "reopen", np.where((old[2:, there] == new[2:, there]).all(0), "refresh", "update"))
                live = known[1] == 1
                closed = np.zeros(0, np.int64)
                if whole and not late and len(ids) >= live.sum() * LEAST_SHARE:
                    closed = np.flatnonzero(live & ~np.isin(known[0], ids))
                acts = ~there | (not late)
                newest, step = int(max(newest or one.at, one.at)), step + 1
                gone = np.zeros((6, len(closed)), np.int64)
                gone[0] = known[0, closed]
                log.append((one.list_id, int(one.at), step, np.concatenate([kinds[acts], np.full(len(closed), "close", object)]), np.concatenate([new[:, acts], gone], 1), np.concatenate([old[:, acts], known[:, closed]], 1)))
                known[1, closed] = 0
                if not late:
                    known[:, place] = new[:, there]
                known = np.concatenate([known, new[:, ~there]], 1)
                known = known[:, np.argsort(known[0], kind="stable")]
            if log:
                self.state.update((newest, step, known.tobytes()))
                each, now, old = [len(x[3]) for x in log], np.concatenate([x[4] for x in log], 1), np.concatenate([x[5] for x in log], 1)
                number = lambda rows, n: pd.arrays.IntegerArray(rows[n].copy(), rows[n + 2] == 0)
                told = {name: np.repeat(np.array([x[n] for x in log], kind), each) for n, (name, kind) in enumerate((("list_id", object), ("at", np.int64), ("step", np.int32)))}
                sender = dict(zip(("tenant", "counterparty", "side"), key, strict=True))
                columns = {"identity": now[0], "kind": np.concatenate([x[3] for x in log]), "quantity": number(now, 2), "price_cents": number(now, 3), "old_quantity": number(old, 2), "old_price_cents": number(old, 3)}
                yield pd.DataFrame({**told, **columns}).assign(**sender)[[c.split()[0] for c in LOG.split(", ")]]

        def close(self) -> None:
            pass

    return Reconciler()


def reconciled(lists: DataFrame) -> DataFrame:
    """The log (LOG) of a stream of lists. The session keeps state in RocksDB from now on, as map state needs it."""
    spark = lists.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # instants are whole microseconds in the state, which knows no time zones; numbers stay whole beside what tells that they are there
    lines = F.filter("lines", lambda x: x["identity"].isNotNull())
    of = lambda f: F.coalesce(F.transform(lines, f), F.array())
    number = lambda c: of(lambda x: F.coalesce(x[c], F.lit(0)).cast("bigint")).alias(c.split("_")[0])
    has = lambda c: of(lambda x: x[c].isNotNull().cast("bigint")).alias("has_" + c.split("_")[0])
    rows = lists.select(*SENDER, "list_id", F.unix_micros("at").alias("at"), "complete", number("identity"), number("quantity"), number("price_cents"), has("quantity"), has("price_cents"))
    log = rows.groupBy(*SENDER).transformWithStateInPandas(reconciler(), LOG.replace("at timestamp", "at long"), "Append", "None")
    return log.withColumn("at", F.timestamp_micros("at"))


def logged(lists: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the log of what there is now to ``out`` and stop; a later call goes on from there."""
    return reconciled(lists).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(log: DataFrame) -> DataFrame:
    """Each lot as the log leaves it: SENDER, identity, live, quantity, price_cents, and the last thing done to it."""
    last = F.row_number().over(Window.partitionBy(*SENDER, "identity").orderBy(F.desc("step")))
    now = log.withColumn("n", last).where("n = 1")
    closed = F.col("kind") == "close"
    return now.select(*SENDER, "identity", (~closed).alias("live"), F.when(closed, F.col("old_quantity")).otherwise(F.col("quantity")).alias("quantity"), F.when(closed, F.col("old_price_cents")).otherwise(F.col("price_cents")).alias("price_cents"), "kind")


def taken_back(log: DataFrame, list_id) -> DataFrame:
    """What undoing a list does: SENDER, identity and undo. Lots it brought are withdrawn, lots it closed live again, lots it
    reopened close again, and prices and quantities go back; only where no later list has touched the lot."""
    later = Window.partitionBy(*SENDER, "identity")
    acts = log.where("kind <> 'refresh'").withColumn("last", F.max("step").over(later)).where((F.col("list_id") == list_id) & (F.col("step") == F.col("last")))
    undo = F.when(F.col("kind") == "insert", "withdrawn").when(F.col("kind") == "close", "reopened").when(F.col("kind") == "reopen", "closed").otherwise("restored")
    return acts.select(*SENDER, "identity", undo.alias("undo"), F.when(undo != "withdrawn", F.col("old_quantity")).alias("quantity"), F.when(undo != "withdrawn", F.col("old_price_cents")).alias("price_cents"))
