"""Lexical search, near duplicates of vectors and importance resampling: bounds, audits and hard cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binweave.llm import lexical, neighbours, resampling
from binweave.llm.hnsw import Graph
from binweave.llm.words import mix, split

from . import brute

VECTORS = "vec_id bigint, embedding array<float>, label int"


def groups_of_vectors(seed, groups, most, dim=24, lone=300):
    """Unit vectors in groups of near copies, and lone ones."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(lone)]
    for _ in range(groups):
        centre = rng.normal(size=dim)
        rows += [centre + rng.normal(size=dim) * rng.uniform(0, 0.3) for _ in range(rng.integers(2, most))]
    return rng.permutation(np.array(rows), axis=0).astype(np.float32)


def exact_links(vectors):
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    same = unit @ unit.T >= neighbours.COSINE
    np.fill_diagonal(same, False)
    return same


def components_of(same):
    labels = np.arange(len(same))
    while True:
        least = np.minimum(labels, np.where(same, labels[None, :], len(labels)).min(1))
        if (least == labels).all():
            return labels
        labels = least


# --- small-world graphs ------------------------------------------------------------


def test_graph_reaches_every_node_and_keeps_its_degrees():
    vectors = neighbours._unit(groups_of_vectors(1, 30, 40).astype(np.float64)).astype(np.float32)
    chance = mix(np.arange(1, len(vectors) + 1, dtype=np.uint64)).astype(np.float64) / 2.0**64
    graph, order = Graph.build(vectors, chance)
    assert sorted(order.tolist()) == list(range(len(vectors)))
    assert len(graph.links) > 1
    for links in graph.links:
        assert links.max() < len(links)
        for i, row in enumerate(links):
            own = row[row >= 0]
            assert len(set(own.tolist())) == len(own) and i not in own
    ids, _ = graph._beam(graph.vectors, 0, graph._entry(graph.vectors, 0), 64, len(vectors))
    assert (ids[:, 0] == np.arange(len(vectors))).mean() > 0.99


def test_a_wide_range_is_found_whole_although_the_beam_is_narrow():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    vectors = neighbours._unit(np.concatenate([centre + 0.05 * rng.normal(size=(700, 16)), rng.normal(size=(700, 16))])).astype(np.float32)
    graph, order = Graph.build(vectors, rng.uniform(size=len(vectors)))
    q, node = graph.within(graph.vectors[:200], 0.93, 16, 0.02)
    true = (graph.vectors[:200].astype(np.float64) @ graph.vectors.T.astype(np.float64)) >= 0.93
    assert len(q) >= 0.99 * true.sum() and true.sum() > 50_000


def test_a_shard_whose_audit_fails_is_compared_whole():
    """A graph without links finds nothing, so the beam is widened until it is as wide as the shard."""
    vectors = groups_of_vectors(4, 10, 10)
    unit = neighbours._unit(vectors.astype(np.float64))
    bare = Graph(unit.astype(np.float32), [np.full((len(unit), 24), -1, np.int32)])
    width, slack = neighbours._audited_width(bare, unit, unit, 0.93, 0.99, 16)
    assert width >= len(unit)
    found = {(a, b) for q, n in neighbours._search(bare, unit, unit, 0.93, width, slack) for a, b in zip(q.tolist(), n.tolist()) if a != b}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(exact_links(vectors)))))


@pytest.mark.parametrize("shard_rows", [150, 100_000])
def test_near_duplicates_against_every_pair(spark, shard_rows):
    vectors = groups_of_vectors(5, 40, 30)
    copies = np.concatenate([vectors, np.repeat(vectors[:3], 200, axis=0)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(copies)], VECTORS).withColumn("node", F.lit("kept"))
    rows = {r.vec_id: r for r in neighbours.near_duplicates(df, shard_rows=shard_rows).collect()}
    same = exact_links(copies)
    number, least = same.sum(1), components_of(same)
    found = np.array([rows[i].n_links for i in range(len(copies))])
    assert len(rows) == len(copies) and (found <= number).all()
    assert found.sum() >= 0.99 * number.sum() and number[0] >= 200
    assert np.mean([rows[i].component_id == least[i] for i in range(len(copies))]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_recall_on_the_largest_test_table_with_near_copies(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rng = np.random.default_rng(8)
    own = np.stack(table.embedding.values)
    near = np.repeat(own[::10], 8, axis=0)
    near = near + rng.normal(size=near.shape) * np.abs(near).mean() * rng.uniform(0, 0.5, (len(near), 1))
    vectors = np.concatenate([own, near.astype(np.float32)])
    labels = np.concatenate([table.label, np.repeat(table.label.values[::10], 8)])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(vectors, labels))], VECTORS)
    found = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df, shard_rows=256).collect()}
    total = reached = 0
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        number = exact_links(vectors[mine]).sum(1)
        links = np.array([found[i] for i in mine.tolist()])
        assert (links <= number).all()
        total, reached = total + number.sum(), reached + links.sum()
    assert total > 1_000 and reached >= 0.98 * total


# --- lexical search ----------------------------------------------------------------


def brute_search(docs, items, k):
    terms = lambda t: brute.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c
            )
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def small_corpus(seed, n=700):
    rng = np.random.default_rng(seed)
    words = [f"w{j}" for j in range(300)]
    share = 1 / np.arange(1, 301)
    docs = [" ".join(rng.choice(words, rng.integers(1, 120), p=share / share.sum())) for _ in range(n)]
    return [(i, t) for i, t in enumerate(docs)], [(j, " ".join(rng.choice(words, rng.integers(1, 25)))) for j in range(25)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_against_every_document(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 32)
    monkeypatch.setattr(lexical, "SEED_ROWS", 64)
    docs, items = small_corpus(1)
    found = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert sorted(map(tuple, found.collect())) == sorted(brute_search(docs, items, k))


def test_search_in_blocks_of_items(spark):
    docs, items = small_corpus(2, 200)
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, lexical.search(a, b, 5, block_items=7).collect())) == sorted(brute_search(docs, items, 5))


def test_buckets_are_passed_over_and_never_wrongly():
    """Thresholds prune whole buckets and single documents, yet the best are what they are without."""
    docs, texts = small_corpus(3, 2_000)
    items = lexical.Items.of([t for _, t in texts])
    size = len(items.vocabulary)
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, size, rng.integers(1, 40))) for _ in docs]
    impacts = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    weights = rng.integers(1, 9_000, size)
    norms = np.array([math.sqrt((weights[r] * x.astype(float) ** 2).sum()) for r, x in zip(rows, impacts)])
    order = np.argsort(-norms)
    for sequence in (order, order[::-1]):
        best, plain = (lexical._Best(np.zeros(len(items), np.int64), 10) for _ in range(2))
        for low in range(0, len(sequence), 100):
            some = sequence[low : low + 100]
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
            terms, values = np.concatenate([rows[i] for i in some]), np.concatenate([impacts[i] for i in some])
            lexical._search_bucket(items, weights, some, norms[some], terms, values, first, best)
            for item in range(len(items)):
                own = items.terms[items.first[item] : items.first[item + 1]]
                scores = np.array([(weights[rows[i]] * impacts[i])[np.isin(rows[i], own)].sum() for i in some])
                plain.add(item, scores, some)
        for item in range(len(items)):
            assert best.scores[item].tolist() == plain.scores[item].tolist() and best.ids[item].tolist() == plain.ids[item].tolist()


def test_search_ties_repeats_and_missing_ids(spark):
    docs = [(3, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, "A-b"), (4, None), (5, ""), (6, "c")] + [(10 + i, "z z") for i in range(9)]
    items = [(1, "b, a a"), (1, "b, a a"), (None, "c"), (2, "absent"), (3, None), (4, "!!")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("norm", "terms", "n", "m", "item", "rank")})
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    found = lexical.search(a, b, 10).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    wanted = brute_search(docs, [(1, "b, a a"), (None, "c")], 10)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert [r.doc_id for r in sorted((r for r in found if r.item_id == 1), key=lambda r: r.rank)] == [1, 1, 2, 3, None]


# --- resampling --------------------------------------------------------------------


def test_crc_of_spans_of_any_length_and_beginning():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5_000).astype(np.uint8)
    low = rng.integers(0, 4_000, 300)
    high = low + rng.integers(0, 130, 300)
    before = np.array([zlib.crc32(bytes([i % 256, 7])) for i in range(300)], np.uint32)
    assert resampling.crc_of_spans(data, low, high).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(low, high)]
    assert resampling.crc_of_spans(data, low, high, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(low, high, before)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_head_and_tail_give_the_same_features(longest):
    text = "The cat the CAT sat " + "x" * 200 + " sat the cat é Élan 日本 " * 5
    words = split(pa.array([text, "", None, "one"], pa.string()), lower=True, plain=True)
    plain = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    wanted = [[zlib.crc32(" ".join(plain[k : k + w]).encode()) for k in range(len(plain) - w + 1)] for w in range(1, longest + 1)]
    direct = list(resampling._features(words, longest, resampling.Head({}, {})))
    width, hashes, crcs = (np.concatenate(x) for x in zip(*[(np.full(len(h), w), h, c) for w, h, c, _ in direct]))
    for some in (slice(0, 0), slice(None, None, 3), slice(None)):
        head = resampling.Head.of(width[some], hashes[some], crcs[some], 64)
        for (w, _, found, first), expected in zip(resampling._features(words, longest, head), wanted):
            assert found[: first[1]].tolist() == expected


def brute_totals(texts, longest, buckets):
    total = Counter()
    for t in texts:
        w = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t))
        total.update(zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1))
    return total


@pytest.mark.parametrize("head", [1, 100, 1 << 16])
def test_bucket_totals_do_not_depend_on_the_head(spark, hard, pairs_of_hard, head):
    shared = spark.sparkContext.broadcast(resampling.frequent_features(hard, 2, head))
    totals = resampling.bucket_totals(hard, shared, 2, 97)
    wanted = brute_totals([t for _, t in pairs_of_hard], 2, 97)
    assert totals.tolist() == [wanted[b] for b in range(97)]


@pytest.fixture(scope="module")
def pairs_of_hard(hard_rows):
    return [(r[0], r[1]) for r in hard_rows]


def test_draw_takes_its_share_and_favours_the_target(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = docs.filter("lang = 'de'").limit(50)
    rows = resampling.resample(docs.withColumn("rank", F.lit("kept")).withColumn("score", F.lit(1)), target, percent=20, longest=2)
    drawn = rows.filter("rank IS NOT NULL").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert sorted(drawn["rank"]) == list(range(1, len(drawn) + 1))
    assert (drawn.sort_values("rank").score.diff().dropna() <= 0).all()
    everywhere = docs.filter("lang = 'de'").count() / docs.count()
    assert (drawn.lang == "de").mean() > min(0.9, 2 * everywhere)


def test_one_id_in_most_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(7, text)] * 900 + [(i, text + f" u{i}") for i in range(100)] + [(None, text), (8, None), (9, "few words")], "doc_id bigint, text string")
    rows = resampling.resample(df, df.limit(5), percent=50).collect()
    assert len(rows) == 1003 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 501))
    assert all(r["rank"] is None for r in rows if r.doc_id in (None, 8, 9) and r.n_features < 20 or r.doc_id is None)
