"""Every registered query with SQL agrees with it; the others agree with brute force, a round trip or held-out labels."""

import numpy as np
import pytest

from facetflow.llm import queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).fetchdf())


def test_nearest_neighbours_recall(spark):
    rows = queries.QUERIES["op3_pruned_graph_search"](spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = wanted = 0
    for query, found in rows.groupby("query_id"):
        dist = np.sqrt(((x - x[ids == query]) ** 2).sum(1))
        dist[ids == query] = np.inf
        best = ids[np.lexsort((ids, dist))[:10]]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11))
        assert np.allclose(found.score, [dist[ids == v][0] for v in found.vec_id], rtol=0, atol=1e-12)
        hits, wanted = hits + len({*best} & {*found.vec_id}), wanted + 10
    assert set(rows.query_id) == set(ids[ids % 100 == 0])
    assert hits / wanted >= 0.9


def test_toxicity_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    from facetflow.llm import toxicity

    folder = DATA.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, toxicity.judged(labels.where("doc_id % 2 = 0")))
    held = toxicity.score(docs, chain).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = held.groupBy("toxic", "found").count().toPandas().set_index(["toxic", "found"])["count"]
    assert got.get((0, True), 0) <= 0.01 * got.get((0, False), 0)
    assert got.get((1, True), 0) > 0.9 * (got.get((1, True), 0) + got.get((1, False), 0))
    # the second model has one weight more, of the first category's log-odds
    assert [len(w) for w in chain.weights] == [len(chain.features) + 1, len(chain.features) + 2]
    assert docs.select(F.count("*")).first()[0] == toxicity.score(docs, chain).count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "packing" or out.columns == names
        counts.append(out.count())
        docs = out
    assert counts[1] <= counts[0] <= 200
    assert corpus_pipeline.run(spark, DATA).count() == counts[-1]


@pytest.mark.parametrize(
    ("name", "kinds"),
    [
        ("op2_pivotal_mixing", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
        ("op6_toxicity_chain", "doc_id bigint, toxic boolean"),
        ("op8_hierarchical_packing", "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"),
        ("op9_external_shuffle", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    ],
)
def test_columns_of_queries_without_sql(spark, name, kinds):
    rows = queries.QUERIES[name](spark, DATA)
    found = dict(rows.dtypes)
    for column in kinds.split(", "):
        of, kind = column.split(" ")
        assert found[of] == kind
    docs = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r[0] for r in rows.select("doc_id").collect()} == docs


def test_pipeline_keeps_what_it_should(spark):
    """Each stage's rows against its input: nothing new, no class of equal texts lost, repeats only by the mix."""
    import corpus_pipeline
    from facetflow.llm import toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.train(docs, toxicity.judged(labels))
    scores = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, DATA)
    whole = {tuple(r) for r in docs.collect()}
    rows = {tuple(r) for r in clean.collect()}
    assert rows == {tuple(r) for r in docs.collect() if not scores[r["doc_id"]]}
    single = stages["near_duplicates"](spark, clean, DATA)
    kept = [tuple(r) for r in single.collect()]
    at = docs.columns.index("text")
    assert len({*kept}) == len(kept) and {*kept} <= rows <= whole
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    sets = [grams(r[at] or "") for r in kept]
    assert all(len(a & b) / max(1, len(a | b)) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
    # what went is within a chain of links of something that stayed
    gone, reached = [grams(r[at] or "") for r in rows - {*kept}], sets[:]
    while near := [g for g in gone if any(len(g & s) / max(1, len(g | s)) >= 0.8 for s in reached)]:
        gone, reached = [g for g in gone if g not in near], reached + near
    assert not gone
    mixed = [tuple(r) for r in stages["mixing"](spark, single, DATA).collect()]
    assert {*mixed} <= {*kept} and max(mixed.count(r) for r in {*mixed}) <= 2
