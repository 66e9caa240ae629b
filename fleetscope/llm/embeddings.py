"""Near duplicates among embeddings through a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.llm import flatgraph
from fleetscope.llm.graph import components
from fleetscope.session import checkpointed

_CELL = ["label", "dim", "cluster"]


@dataclass(frozen=True)
class Settings:
    """``centroids`` bounds what every task gets (times the dimension, 8 bytes each); with more rows than centroids * rows of a
    shard, shards grow and are searched in more blocks. ``block`` bounds what a task holds. The audit searches ``audit`` drawn nodes and as many
    planted near copies of drawn nodes; a query with ``dense`` linked nodes or more counts among the dense ones."""

    threshold: float = 0.98
    shard: int = 4096
    block: int = 8192
    centroids: int = 8192
    sample_per_centroid: int = 24
    rounds: int = 5
    beam: int = 12
    audit: int = 200
    dense: int = 50
    recall: float = 0.95


@dataclass(frozen=True)
class Audit:
    """What the recall check of a run saw: queries with links, how many of them were planted, and the mean share of their linked nodes that was
    found, the lesser of dense and sparse queries; None without a vector to link."""

    queries: int
    planted: int
    recall: float | None


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return flatgraph.unit(np.stack(column.to_numpy()))


def _row_blocks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose products with so many columns take 32 MB."""
    step = max(1, (1 << 22) // max(columns, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


def _centroid_sums(batches: Iterator[pd.DataFrame], centroids: dict[tuple[str, int], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Sums of the vectors nearest to each centroid, one row a centroid and task at most; a label that a task has no vector of adds no frame, since
    Arrow can't turn an empty column into lists."""
    sums = {key: np.zeros((len(c), c.shape[1] + 1)) for key, c in centroids.items()}
    for batch in batches:
        for (label, dim), own in batch.groupby(["label", "dim"]):
            centres, total = centroids[label, int(dim)], sums[label, int(dim)]
            x, squares = _matrix(own["vector"]), (centres * centres).sum(axis=1) / 2
            for part in _row_blocks(len(x), len(centres)):
                nearest = (x[part] @ centres.T - squares).argmax(axis=1)
                np.add.at(total, nearest, np.hstack([x[part], np.ones((len(nearest), 1))]))
    for (label, dim), total in sums.items():
        used = np.flatnonzero(total[:, -1])
        if len(used):
            yield pd.DataFrame({"label": label, "dim": dim, "cluster": used, "total": list(total[used])})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": rows["label"][:1], "dim": rows["dim"][:1], "cluster": rows["cluster"][:1], "total": [np.stack(rows["total"]).sum(axis=0)]})


def _fit_centroids(nodes: DataFrame, settings: Settings) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of every (label, dimension) with more rows than a shard, on a bounded sample; smaller ones are one shard.

    The sample, about ``sample_per_centroid`` vectors a centroid, stays in the shared folder; each round is a job that assigns in tasks and adds up by
    centroid. The driver holds the centroids alone: at most about 2 * ``centroids``."""
    total = nodes.count()
    shard = max(settings.shard, -(-total // settings.centroids))
    large = nodes.groupBy("label", "dim").count().where(F.col("count") > shard)  # at most ``centroids`` rows
    large = large.withColumn("k", F.ceil(F.col("count") / shard)).withColumn("rate", settings.sample_per_centroid * F.col("k") / F.col("count"))
    sizes = {(r.label, int(r.dim)): int(r.k) for r in large.toLocalIterator()}
    if not sizes:
        return {}
    share = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = checkpointed(nodes.join(large, ["label", "dim"]).where(share < F.col("rate")).select("node", "label", "dim", "k", "vector"))
    place = F.row_number().over(W.partitionBy("label", "dim").orderBy(F.xxhash64("node"), "node"))
    first = drawn.withColumn("place", place).where(F.col("place") <= F.col("k")).select("label", "dim", "vector").toPandas()
    found = {(label, int(dim)): _matrix(own["vector"]) for (label, dim), own in first.groupby(["label", "dim"])}
    for _ in range(settings.rounds):
        now = dict(found)
        sums = drawn.select("label", "dim", "vector").mapInPandas(lambda b: _centroid_sums(b, now), "label string, dim int, cluster int, total array<double>")
        sums = sums.groupBy("label", "dim", "cluster").applyInPandas(_added, "label string, dim int, cluster int, total array<double>").toPandas()
        for (label, dim), own in sums.groupby(["label", "dim"]):
            totals = np.stack(own["total"])
            found[label, int(dim)][own["cluster"].to_numpy()] = totals[:, :-1] / totals[:, -1:]
    return found


def _assign(nodes: DataFrame, centroids: dict, radius: float) -> DataFrame:
    """Add ``cluster`` and ``home``: the nearest centroid, and every other cluster whose cell comes within ``radius`` of the vector. Any vector
    within the radius of one at home in a cluster is thus a member of that cluster too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            parts = []
            for (label, dim), own in table.groupby(["label", "dim"]):
                centres = centroids.get((label, int(dim)))
                if centres is None:
                    parts.append(own.assign(cluster=0, home=True))
                    continue
                x, squares = _matrix(own["vector"]), (centres * centres).sum(axis=1)
                for part in _row_blocks(len(x), len(centres)):
                    d2 = squares[None, :] - 2 * x[part] @ centres.T
                    nearest = d2.argmin(axis=1)
                    member = d2 - d2[np.arange(len(d2)), nearest][:, None]
                    for j in np.unique(nearest):
                        rows_of = nearest == j
                        member[rows_of] -= 2 * radius * np.sqrt(((centres - centres[j]) ** 2).sum(axis=1))
                    at, cluster = np.nonzero(member <= 1e-9)
                    parts.append(own.iloc[part].iloc[at].assign(cluster=cluster, home=cluster == nearest[at]))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts), schema=schema, preserve_index=False)

    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vector", pa.list_(pa.float64())), ("copies", pa.int64()),
                        ("cluster", pa.int32()), ("home", pa.bool_())])
    return nodes.select("node", "label", "dim", "vector", "copies").mapInArrow(
        rows, "node bigint, label string, dim int, vector array<double>, copies bigint, cluster int, home boolean")


def _build(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    names = rows["node"].to_numpy()
    edges = flatgraph.build(_matrix(rows["vector"]), least)
    return pd.DataFrame({"node": names, "near": [names[e] for e in edges]})


def _search(settings: Settings):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or queries.empty:
            return pd.DataFrame({"node": [], "links": [], "mates": [], "a": [], "b": []})
        graph = graph.sort_values("node")
        names, x = graph["node"].to_numpy(), _matrix(graph["vector"])
        edges = []
        for near in graph["near"]:
            place = np.searchsorted(names, near).clip(max=len(names) - 1)
            edges.append(place[names[place] == near])
        asked, y = queries["q_node"].to_numpy(), _matrix(queries["q_vector"])
        own = np.searchsorted(names, asked).clip(max=len(names) - 1)
        own = np.where(names[own] == asked, own, -1)
        lists, start = flatgraph.Lists(edges), flatgraph.medoid(x)
        links, mates = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        joined = []
        for part in _row_blocks(len(asked), len(names)):  # so many queries that all their links with the block are a bounded number of pairs
            some = asked[part]
            who, nodes = flatgraph.search(x, lists, start, own[part], y[part], settings.threshold, settings.beam)
            other = (names[nodes] != some[who]) & (names[nodes] >= 0)  # planted vectors are nobody's partners
            who, nodes = who[other], nodes[other]
            links[part] = np.bincount(who, weights=graph["copies"].to_numpy()[nodes], minlength=len(some)).astype(np.int64)
            mates[part] = np.bincount(who, minlength=len(some))
            real = some[who] >= 0
            joined.append(flatgraph.forest(some[who][real], names[nodes][real]))
        a, b = flatgraph.forest(*(np.concatenate(ends) for ends in zip(*joined)))
        some = mates > 0
        return pd.concat([pd.DataFrame({"node": asked[some], "links": links[some], "mates": mates[some]}), pd.DataFrame({"a": a, "b": b})])

    return run


def _planted(nodes: DataFrame, settings: Settings) -> pd.DataFrame:
    """Near copies of a bounded sample of nodes, similarities spread from the threshold up, under negative names: links that are there for certain."""
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(settings.audit).select("node", "label", "dim", "vector").toPandas()
    random, near = np.random.Generator(np.random.PCG64(23)), []
    for i, vector in enumerate(drawn["vector"]):
        x = flatgraph.unit(np.asarray(vector, float)[None, :])[0]
        away = random.standard_normal(len(x))
        away -= (away @ x) * x
        size = np.sqrt(away @ away)
        cosine = settings.threshold + (1 - settings.threshold) * (i % 20 + 1) / 21
        near.append((cosine * x + np.sqrt(1 - cosine**2) * away / size if size > 1e-9 else x).tolist())
    return drawn.assign(node=-1 - np.arange(len(drawn)), vector=near)


def _count_mates(nodes: DataFrame, sample: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """(node, mates): how many other nodes the queries truly link with, by comparison with all rows; queries without any are left out."""
    groups = {(label, int(dim)): (own["node"].to_numpy(), _matrix(own["vector"])) for (label, dim), own in sample.groupby(["label", "dim"])}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {key: np.zeros(len(asked), np.int64) for key, (asked, _) in groups.items()}
        for batch in batches:
            for (label, dim), own in batch.groupby(["label", "dim"]):
                if (label, int(dim)) in groups:
                    asked, y = groups[label, int(dim)]
                    names, x = own["node"].to_numpy(), _matrix(own["vector"])
                    for part in _row_blocks(len(x), len(y)):
                        near = (y @ x[part].T >= settings.threshold) & (asked[:, None] != names[part][None, :])
                        sums[label, int(dim)] += near.sum(axis=1)
        for key, (asked, _) in groups.items():
            some = sums[key] > 0
            yield pd.DataFrame({"node": asked[some], "mates": sums[key][some]})

    return nodes.select("node", "label", "dim", "vector").mapInPandas(count, "node bigint, mates bigint").groupBy("node").agg(
        F.sum("mates").alias("mates")).toPandas()


def _audit(true: pd.DataFrame, found: pd.DataFrame, settings: Settings) -> Audit:
    """Mean share of a query's linked nodes that the search found, over the queries with any; the lesser of dense and sparse queries."""
    both = true[true["mates"] > 0].merge(found, on="node", how="left", suffixes=("", "_found"))
    share = np.minimum(both["mates_found"].fillna(0), both["mates"]) / both["mates"]
    dense = both["mates"] >= settings.dense
    parts = [float(part.mean()) for part in (share[dense], share[~dense]) if len(part)]
    return Audit(len(both), int((both["node"] < 0).sum()), min(parts) if parts else None)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings(),
) -> DataFrame:
    """Return (vec_id, n_links, component_id, kept) for every row; see ``audited_near_duplicates``."""
    return audited_near_duplicates(vectors, id_col, vector_col, label_col, settings)[0]


def audited_near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings(),
) -> tuple[DataFrame, Audit]:
    """Rows (vec_id, n_links, component_id, kept) and the audit of the search; vectors link at cosine ``threshold`` or more within a label.

    1. Equal vectors of a label become one node with its number of copies, so copies never meet as pairs.
    2. Nodes go to overlapping cluster shards: the nearest centroid's and all whose cell is within reach, so a shard holds
       every possible partner of the vectors at home in it. A shard above ``block`` rows is cut into blocks by hash; a dense
       ball, which no centroid divides, is thus bounded too.
    3. Each block builds a pruned neighbour graph; a node's lists from all its blocks are united. Among the nodes in range of one another only such are
       pruned as a kept one leads to, so a node's range search in its own block finds all its links there.
    4. The vectors at home search every block of their shard, their own from their place in it, others greedily from the medoid, then expanding the range; an
       exact check of the other blocks follows; similarities are computed in double precision, so no link is false. A task returns counts and a spanning forest of its links, never pairs.
    5. Recall is measured in every run: near copies of drawn nodes are planted among the vectors, left out of all results, and searched like any vector, and so
       are drawn nodes; both are compared with all rows. A mean share of linked nodes found below ``recall``, for dense or for sparse queries, stops the job.

    Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing. Vectors of
    different length don't compare. Rows that repeat an id count as vectors of their own; they share a component if their
    vectors do. A null id is smaller than none: a group's component_id is its smallest id that is not null.
    """
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & usable(vector))
    good = rows.where("usable")
    nodes = good.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))

    radius = float(np.sqrt(2 - 2 * settings.threshold)) + 1e-9
    planted = _planted(nodes, settings)
    extra = nodes.sparkSession.createDataFrame([(int(r.node), r.label, int(r.dim), r.vector, 0) for r in planted.itertuples()],
                                               "node bigint, label string, dim int, vector array<double>, copies bigint")
    placed = checkpointed(_assign(nodes.select(extra.columns).unionByName(extra), _fit_centroids(nodes, settings), radius))
    sizes = placed.groupBy(*_CELL).agg(F.count("*").alias("members"), F.sum(F.col("home").cast("bigint")).alias("homes"))
    sizes = sizes.select(*_CELL, F.ceil(F.col("members") / settings.block).cast("int").alias("blocks"),
                         F.ceil(F.greatest("homes", F.lit(1)) / settings.block).cast("int").alias("chunks"))
    placed = placed.join(sizes, _CELL)
    members = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lists = members.groupBy(*_CELL, "block").applyInPandas(lambda rows: _build(rows, settings.threshold), "node bigint, near array<bigint>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = checkpointed(members.join(united, "node").select(*_CELL, "block", "chunks", "node", "vector", "copies", "near"))
    graph = graph.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = placed.where("home").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*_CELL, "block", "chunk"]
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "node", "vector")])
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(settings.audit).select("node", "label", "dim", "vector").toPandas()
    true = _count_mates(nodes, pd.concat([drawn, planted]), settings)
    queries = nodes.sparkSession.createDataFrame([(int(n),) for n in true["node"]], "node bigint")
    hits = checkpointed(graph.select(*key, "node", "vector", "copies", "near").groupBy(*key).cogroup(
        asked.groupBy(*[f"q_{c}" for c in key])).applyInPandas(
        _search(settings), "node bigint, links bigint, mates bigint, a bigint, b bigint"))
    links = checkpointed(hits.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("mates").alias("mates")))
    audit = _audit(true, links.join(queries, "node").select("node", "mates").toPandas(), settings)
    if audit.recall is not None and audit.recall < settings.recall:
        raise RuntimeError("the graph search finds fewer links than asked for")

    roots = components(hits.where("a is not null").select("a", "b"))
    member = nodes.join(roots, "node", "left").select("node", "label", "vector", "copies", "first_id", F.coalesce("root", "node").alias("root"))
    best = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(best, "root").join(links.drop("mates"), "node", "left").select(
        F.col("label").alias("n_label"), F.col("vector").alias("n_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(member, (F.col("label") == F.col("n_label")) & (vector == F.col("n_vector"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audit
