"""Embedding links against brute force, and the pipeline's stages against plain versions."""

import numpy as np
import pytest

from fleetscope.llm import embeddings, flatgraph
from fleetscope.llm.graph import components


def plain(rows, least=0.98):
    good = [(i, l, np.array(v, float)) for i, v, l in rows
            if l is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i in links}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, v) in enumerate(good):
        for j, b, w in good[k + 1:]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {(i, links[i], top(i)) for i in links}


@pytest.mark.parametrize("shard,block", [(3000, 4096), (60, 50)])
def test_links_equal_brute_force(frame, shard, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.3)).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, rows[0][1], None),
             (305, [float("nan")] + rows[0][1][1:], 0), (306, rows[0][1][:8], 0), (307, [None] + rows[0][1][1:], 0)]
    vectors = frame("vec_id bigint, embedding array<double>, label int", rows).selectExpr("*", "1 AS node", "'c' AS cluster")
    found = embeddings.near_duplicates(vectors, settings=embeddings.Settings(shard=shard, block=block)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_recall_counts_every_query():
    import pandas as pd

    # A ball with all its links found doesn't make up for the lost links of sparse queries, or the other way round.
    true = pd.DataFrame({"node": [-1, *range(1, 10)], "mates": [1000] * 5 + [2] * 4 + [0]})
    lost = pd.DataFrame({"node": [-1, *range(1, 8)], "mates": [1000] * 5 + [2, 0, 1]})
    settings = embeddings.Settings()
    assert embeddings._audit(true, true, settings) == embeddings.Audit(9, 1, 1.0)
    assert embeddings._audit(true, lost, settings).recall == (1 + 0 + 0.5 + 0) / 4
    assert embeddings._audit(true, true.assign(mates=[500] * 5 + [2] * 4 + [0]), settings).recall == 0.5
    assert embeddings._audit(true.iloc[:0], true, settings).recall is None


def test_recall_is_measured_without_a_link_in_the_table(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    found, audit = embeddings.audited_near_duplicates(vectors)
    assert audit.planted == 200 and audit.queries >= 200 and audit.recall >= 0.95
    assert found.count() == vectors.count()


def test_links_planted_in_the_table(spark, small):
    # Every tenth vector gets near copies just above and just below the limit, in the table itself.
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rng, more = np.random.default_rng(8), []
    for i, (vec_id, v, label) in enumerate(rows[::10]):
        x = np.array(v, float) / np.linalg.norm(v)
        away = rng.standard_normal(len(x))
        away -= (away @ x) * x
        away /= np.linalg.norm(away)
        for cosine in (0.9801, 0.99, 0.9799):
            more.append((10000 + len(more), (cosine * x + np.sqrt(1 - cosine**2) * away).tolist(), label))
    every = spark.createDataFrame(rows + more, "vec_id bigint, embedding array<double>, label int")
    for settings in (embeddings.Settings(), embeddings.Settings(shard=24, block=40)):
        found, audit = embeddings.audited_near_duplicates(every, settings=settings)
        assert {(r.vec_id, r.n_links, r.component_id) for r in found.collect()} == plain(rows + more) and audit.recall >= 0.95


def test_centroids_are_averages_of_their_cells(frame):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(2000)]
    nodes = frame("node bigint, vector array<double>", rows).selectExpr("node", "'a' AS label", "size(vector) AS dim", "vector")
    found = embeddings._fit_centroids(nodes, embeddings.Settings(shard=40, rounds=3))
    assert found["a", 4].shape == (50, 4) and np.isfinite(found["a", 4]).all()
    assert embeddings._fit_centroids(nodes, embeddings.Settings()) == {}


def test_a_task_without_vectors_of_a_large_label(frame):
    # Rows come label by label, so no task has vectors of all labels with several centroids; a task may have no rows at all.
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * (0.02 if i % 3 else 0.3)).tolist(), i // 150) for i in range(450)]
    vectors = frame("vec_id bigint, embedding array<double>, label int", rows)
    found = embeddings.near_duplicates(vectors, settings=embeddings.Settings(shard=60, block=50)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == plain(rows)

    centroids = {(label, 16): base[:3] for label in ("0", "1", "2")}
    nodes = frame("label string, dim int, vector array<double>", [(str(l), 16, v) for _, v, l in rows if l < 2]).repartition(8, "label")
    sums = nodes.mapInPandas(lambda b: embeddings._centroid_sums(b, centroids), "label string, dim int, cluster int, total array<double>")
    counts = sums.selectExpr("label", "total[16] AS n").groupBy("label").sum("n").collect()
    assert {tuple(r) for r in counts} == {("0", 150.0), ("1", 150.0)}


def loose_ball(rows, seed=4):
    rng = np.random.default_rng(seed)
    return rng.standard_normal(64) + rng.standard_normal((rows, 64)) * 0.15


@pytest.mark.parametrize("block", [8192, 100])
def test_no_link_of_a_loose_ball_is_lost(frame, block):
    # Many links, no vector in the middle, and vectors that are on nobody's list of nearest ones; scaled copies lie at one place.
    ball = loose_ball(700)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([ball, ball[:30] * 3, ball[:30] * 0.7]))]
    vectors = frame("vec_id bigint, embedding array<double>, label int", rows)
    found = embeddings.near_duplicates(vectors, settings=embeddings.Settings(block=block)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == plain(rows)


def test_range_search_of_a_block():
    x = flatgraph.unit(np.vstack([loose_ball(900), np.random.default_rng(6).standard_normal((300, 64))]))
    lists, start = flatgraph.Lists(flatgraph.build(x, 0.98)), flatgraph.medoid(x)
    true = {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.98) if a != b}
    at = np.arange(len(x))
    pairs = {(int(a), int(b)) for a, b in zip(*flatgraph.search(x, lists, start, at, x, 0.98)) if a != b}
    assert pairs == true
    y = flatgraph.unit(loose_ball(960)[900:])  # no nodes of the block
    true = {(int(a), int(b)) for a, b in np.argwhere(y @ x.T >= 0.98)}
    assert {(int(a), int(b)) for a, b in zip(*flatgraph.search(x, lists, start, np.full(len(y), -1), y, 0.98, 1))} == true and true


def test_no_rows(frame):
    assert embeddings.near_duplicates(frame("vec_id bigint, embedding array<double>, label int", [])).count() == 0


def test_forest_keeps_components():
    a, b = np.array([5, 7, 9, 1, 20]), np.array([7, 9, 3, 20, 21])
    at, to = flatgraph.forest(a, b)
    assert dict(zip(at.tolist(), to.tolist())) == {5: 3, 7: 3, 9: 3, 20: 1, 21: 1}


def test_components(frame):
    edges = [(i, i + 1) for i in range(1, 12)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(frame("a bigint, b bigint", edges)).collect()}
    assert found == {i: 1 for i in range(1, 13)} | {i: 100 for i in range(100, 140)}
    assert components(frame("a bigint, b bigint", [])).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= seen, name
        seen = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {p.doc_id for p in last} == seen and sum(p.length for p in last if p.start + p.length == p.doc_tokens) > 0
