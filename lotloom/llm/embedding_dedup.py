"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within a cell.

Equal vectors of a label become one class first. Every class lives in the cell of its nearest
centroid and visits each further cell in which a vector linked to it may live: for centroids p
(its own) and q, a vector y can have a link in q's cell only if y.(p - q) <= c |p - q|, with c the
longest chord of a link. So a class finds all its links in its own cell, none twice.

Each label begins as one cell, and cells that are too large are split by k-means of their own, level
after level, so the number of cells follows the number of vectors of each label. A cell is left as it
is where splitting would send its vectors to too many cells, as in a cloud as dense as a link is
long. What is left is cut into blocks of bounded size; each pair of blocks is a group of its own,
which gives counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components

LINK = 0.98
#: Rows of a block; classes a cell should have; cells of one split at most; vectors that train a split, about.
BLOCK, CELL, FAN, SAMPLE = 4096, 1500, 64, 4096
ROUNDS = 8
#: A split is made if each vector then is in fewer cells than this; levels at most (FAN ** LEVELS cells a label).
SPREAD, LEVELS = 3.0, 8


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; starts from rows spread over the sample; empty cells keep theirs."""
    k = max(1, min(k, len(sample)))
    at = sample[np.linspace(0, len(sample) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        cell = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1)
        at[size > 1e-12] = sums[size > 1e-12] / size[size > 1e-12, None]
    return at


def visited(units: np.ndarray, at: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for each cell that a vector lives in or visits."""
    rows, cells, home = [], [], []
    apart = np.linalg.norm(at[:, None, :] - at[None, :, :], axis=2) if len(at) <= 256 else None
    for begin in range(0, len(units), 1024):
        dot = units[begin : begin + 1024] @ at.T
        own = dot.argmax(1)
        reach = apart[own] if apart is not None else np.sqrt(np.maximum(0, 2 - 2 * at[own] @ at.T))
        near = dot[np.arange(len(own)), own][:, None] - dot <= chord * reach + 1e-9
        near[np.arange(len(own)), own] = True
        r, c = np.nonzero(near)
        rows.append(r + begin)
        cells.append(c)
        home.append(c == own[r])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cells]), np.concatenate([none.astype(bool), *home])


def block_links(ask: np.ndarray, ask_ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, weight: np.ndarray, link: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight linked to each asking row, edges that connect what the block links)."""
    counts = np.zeros(len(ask), np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    ask_size, size = np.linalg.norm(ask, axis=1), np.linalg.norm(other, axis=1)
    for begin in range(0, len(ask), 512):
        some = slice(begin, begin + 512)
        near = ask[some] @ other.T / (ask_size[some, None] * size) >= link
        near &= ask_ids[some, None] != other_ids
        i, j = np.nonzero(near)
        np.add.at(counts, i + begin, weight[j])
        pairs.append(((i + begin).astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int32) for k in (0, 1))
    if not len(i):
        return counts, []
    nodes, place = np.unique(np.concatenate([ask_ids, other_ids]), return_inverse=True)
    a, b = place[: len(ask)][i], place[len(ask) :][j]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return counts, list(zip(nodes[hung].tolist(), nodes[label[hung]].tolist(), strict=True))


def _array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def split_cells(classes: DataFrame, cell: int, link: float) -> DataFrame:
    """``classes`` (label, h1, h2, v, ...) with cell and home: a row for the cell a class lives in, and one for each it visits.

    A level trains each cell of more than 2 * ``cell`` classes on a sample by hash of about SAMPLE
    vectors, writes its centroids to the shared folder under the cell's own name, and deals its
    rows out. Tasks read the centroids of the cells they meet, so no table of centroids is ever in
    one place.
    """
    chord, key = math.sqrt(2 - 2 * link), ["label", "n", "cell"]
    folder = scratch.new_folder(classes.sparkSession, "centroids")
    placed = classes.withColumns({"n": F.size("v"), "cell": F.lit("0"), "home": F.lit(True)})
    schema = placed.schema

    def trained(table: pa.Table) -> pa.Table:
        units = _array(table.column("v"))
        units = units[np.lexsort((table.column("h2").to_numpy(), table.column("h1").to_numpy()))]
        units /= np.linalg.norm(units, axis=1)[:, None]
        label, n, name, size = (table.column(c)[0].as_py() for c in ("label", "n", "cell", "size"))
        at = np.unique(centroids(units, int(min(FAN, max(2, -(-size // cell))))), axis=0)
        if len(at) < 2 or len(visited(units, at, chord)[0]) >= SPREAD * len(units):
            at = at[:0]
        fs, root = scratch.filesystem(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{label}_{n}_{name}") as out:  # every attempt writes the same bytes
            out.write(at.tobytes())
        return pa.table({"label": pa.array([label], pa.int64()), "n": pa.array([n], pa.int32()), "cell": [name], "split": [len(at) > 0]})

    def dealt(batches):
        fs, root = scratch.filesystem(folder)
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.select(key).to_pandas().groupby(key, sort=False).indices
            for (label, n, name), rows in groups.items():
                if (label, n, name) not in known:
                    if len(known) >= 64:
                        known.clear()
                    with fs.open_input_file(f"{root}/{label}_{n}_{name}") as file:
                        known[label, n, name] = np.frombuffer(file.read(), np.float64).reshape(-1, n)
                mine = batch.take(pa.array(rows))
                units = _array(mine.column("v"))
                row, of, home = visited(units / np.linalg.norm(units, axis=1)[:, None], known[label, n, name], chord)
                out = mine.take(pa.array(row))
                lived = out.column("home").to_numpy(zero_copy_only=False) & home
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.{k}" for k in of.tolist()]) if c == "cell" else pa.array(lived) if c == "home" else out.column(c) for c in out.schema.names], out.schema.names)

    done = None
    for _ in range(LEVELS):
        sizes = placed.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > 2 * cell)
        sample = placed.join(sizes, key).where(F.pmod(F.xxhash64("h1", "h2"), F.col("size")) < SAMPLE)
        made = scratch.table(sample.select(*key, "h1", "h2", "v", "size").groupBy(*key).applyInArrow(trained, "label long, n int, cell string, split boolean"), "splits").where("split").drop("split")
        if made.isEmpty():
            break
        stays = placed.join(made, key, "left_anti")
        done = stays if done is None else done.unionByName(stays)
        placed = scratch.table(placed.join(made, key, "left_semi").select(*schema.names).mapInArrow(dealt, schema), "cells")
    return placed if done is None else done.unionByName(placed)


def near_duplicates(vectors: DataFrame, link: float = LINK, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept, class_id (smallest vec_id with the same vector and label).

    Rows with a null id or label, and vectors that are null, empty, zero or hold a null or a
    number that is not finite, link with nothing and are their own component. Vectors of different
    length are not linked. A repeated id counts once per row as somebody's link. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    scratch.ship(spark)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = raw.select("vec_id", "label", sound.alias("sound"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "v")
    classes = scratch.table(keyed.where("sound").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")), "classes")
    placed = split_cells(classes, cell, link)
    cell_key = ["label", "n", "cell"]
    sizes = placed.groupBy(*cell_key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = placed.join(sizes, ["label", "n", "cell"]).withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")).withColumn("each", F.sequence(F.lit(0), F.col("blocks") - 1))
    roles = cut.select("*", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("asks"))
    met = roles.withColumn("with", F.explode("each")).select("label", "n", "cell", F.when(F.col("asks"), F.col("own")).otherwise(F.col("with")).alias("a"), F.when(F.col("asks"), F.col("with")).otherwise(F.col("own")).alias("b"), "asks", "rep", "weight", "h1", "h2", "v")

    def compared(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        v, rep = _array(table.column("v")), table.column("rep").to_numpy()
        ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        counts, edges = block_links(v[ask], rep[ask], v[other], rep[other], table.column("weight").to_numpy()[other], link)
        mine, linked = table.take(pa.array(ask[counts > 0])), counts[counts > 0]
        label = table.column("label")[0].as_py()
        none = [None] * len(edges)
        return pa.table({
            "label": pa.concat_arrays([mine.column("label").combine_chunks(), pa.array([label] * len(edges), pa.int64())]),
            "h1": pa.concat_arrays([mine.column("h1").combine_chunks(), pa.array(none, pa.int64())]),
            "h2": pa.concat_arrays([mine.column("h2").combine_chunks(), pa.array(none, pa.int64())]),
            "links": pa.array([*linked.tolist(), *none], pa.int64()),
            "a": pa.array([*[None] * len(linked), *(e[0] for e in edges)], pa.int64()),
            "b": pa.array([*[None] * len(linked), *(e[1] for e in edges)], pa.int64()),
        })

    found = scratch.table(met.groupBy("label", "n", "cell", "a", "b").applyInArrow(compared, "label long, h1 long, h2 long, links long, a long, b long"), "links")
    links = found.where("links is not null").groupBy("label", "h1", "h2").agg(F.sum("links").alias("links"))
    whole = components(found.where("a is not null").select("a", "b"))
    known = classes.select("label", "h1", "h2", "rep", "weight").join(links, ["label", "h1", "h2"], "left").join(whole, F.col("rep") == F.col("node"), "left").select("label", "h1", "h2", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = keyed.select("vec_id", "sound", F.when(F.col("sound"), F.col("label")).alias("label"), "h1", "h2")
    out = rows.join(known, ["label", "h1", "h2"], "left")
    of = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(False)).alias("kept"), F.coalesce("rep", "vec_id").alias("class_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, compared within their label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("class_id")
