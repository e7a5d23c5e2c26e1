"""Parts of the operators, and cases made to be hard for one of them."""

import itertools
import math
from collections import Counter
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binweave.llm import bitplanes, decontaminate, jaccard, language, lm, packing, quality, sharding, substrings, topk
from binweave.llm.components import components
from binweave.llm.tokens import encoder, tokenizer
from binweave.llm.words import row_chunks, split, unique_per_row, windows

from . import brute
from .conftest import CLASHING, DOCS, words

TEXTS = [None, "", " ", "a", "a b", "  A\tb\n", "ÄB c d", "x" * 5_000, "w " * 5_000, "  é \x1c f"]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)


# --- words --------------------------------------------------------------------


@pytest.mark.parametrize("lower", [False, True])
def test_split_finds_the_words(lower):
    found = split(pa.array(TEXTS), lower)
    data = found.data.tobytes()
    seen = {}
    for row, text in enumerate(TEXTS):
        spans = range(found.first[row], found.first[row + 1])
        assert [data[found.starts[k] : found.ends[k]].decode() for k in spans] == brute.split(text)
        for k in spans:
            word = data[found.starts[k] : found.ends[k]].decode()
            assert seen.setdefault(brute.lower(word) if lower else word, found.hashes[k]) == found.hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_split_of_a_slice_is_the_same():
    column = pa.array(TEXTS)
    whole, part = split(column), split(column.slice(4, 3))
    assert list(part.hashes) == list(whole.hashes[whole.first[4] : whole.first[7]])


def test_windows_stay_within_rows():
    found = split(pa.array(["a b c", "b c", None, "c", "a b c"]))
    full = windows(found, 2)
    assert list(np.diff(full.first)) == [2, 1, 0, 0, 2]
    assert full.hashes[1] == full.hashes[2] == full.hashes[4]
    assert list(np.diff(windows(found, 2, short=True).first)) == [2, 1, 0, 1, 2]


def test_row_chunks_cover_all_rows_once():
    column = pa.array(TEXTS * 3)
    spans = list(row_chunks(column, 100))
    assert spans[0][0] == 0 and spans[-1][1] == len(column)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_unique_per_row():
    values, first = unique_per_row(np.array([3, 1, 3, 2], np.uint64), np.array([0, 0, 0, 2]), 3)
    assert list(values) == [1, 3, 2] and list(first) == [0, 2, 2, 3]


# --- tokens --------------------------------------------------------------------


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_the_text(name, spaced):
    rng = random.Random(5)
    odd = ["it's", " ", "é", "é", "日本", "1234", "...", "A", "\x85", "don't!!", "Σς", "​"]
    gaps = [" ", " ", " ", "  ", "\n", "\t ", " \n", " ", "\x0b"]
    texts = TEXTS + ["".join(rng.choice(odd) + rng.choice(gaps) for _ in range(rng.randrange(30))) for _ in range(300)]
    ids, first = encoder(name, spaced).encode(pa.array(texts))
    for row, text in enumerate(texts):
        wanted = tokenizer(name).encode(text or "", add_special_tokens=False).ids
        assert list(ids[first[row] : first[row + 1]]) == wanted, repr(text)


# --- bit planes -----------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3], [2**32 - 1, 0, 7], list(range(70_000))])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    mask, planes = bitplanes.encode_block(ids)
    assert len(planes) == mask.bit_count()
    assert (bitplanes.decode_block(len(ids), mask, planes) == ids).all()


def test_short_items_remove_documents_only_if_asked(spark):
    df = docs_of(spark, ["the cat sat", "a dog ran", "one two three four five six seven"])
    items = spark.createDataFrame([(0, "the"), (1, None), (2, "ONE two three four five six")], "item_id long, text string")
    left = lambda **k: sorted(r.doc_id for r in decontaminate.without_contaminated(df, items, **k).collect())
    assert left() == [0, 1] and left(least_tokens=1) == [1]


# --- packing --------------------------------------------------------------------


@pytest.mark.parametrize("tokens", [1, 2, 3, 1023, 1024, 1025, 1365, 2047, 2048, 2049, 5_000, 100_001])
def test_cut_points_cover_a_document(tokens):
    pieces = packing.cut_points(tokens)
    at = 0
    for start, length, cls in pieces:
        assert start == at and length >= 1 and (2048 // length == cls or length == 2048 // cls)
        at += length
    assert at == tokens


def test_first_fit_keeps_the_capacity():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 2049) for _ in range(500)]
    bins = packing.first_fit(lengths, 2048)
    load = np.bincount(bins, weights=lengths)
    assert load.max() <= 2048 and len(load) <= 1.1 * math.ceil(sum(lengths) / 2048)


def test_padding_is_small(spark):
    pieces = corpus_pipeline.pack(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "")
    row = pieces.agg(F.sum("length").alias("ids"), F.count_distinct("sequence_id").alias("n")).first()
    assert row["ids"] / row["n"] / 2048 > 0.99


def test_leftovers_fill_bins_across_tasks(spark):
    """A third of all rows in one class, over many tasks: bins of the class are full but for one."""
    df = spark.range(3_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("one two three")).otherwise(F.repeat(F.lit("word "), (F.col("id") % 700).cast("int"))).alias("text"),
    )
    pieces = packing.pack(df.repartition(37, "doc_id")).toPandas()
    assert set(pieces.doc_id) == set(range(3_000))
    loads = pieces.groupby("sequence_id").length.sum()
    assert loads.max() <= 2048 and loads.sum() / len(loads) / 2048 > 0.98
    for _, bin_ in pieces.sort_values("offset").groupby("sequence_id"):
        assert (bin_.offset.to_numpy() == np.concatenate([[0], bin_.length.cumsum()[:-1]])).all()
    cuts = pieces.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert (cuts.length.sum() == cuts.doc_tokens.first()).all()


def test_leftovers_are_numbered_without_gaps(spark):
    rng = random.Random(4)
    rows = [(cls, task, place) for cls in (2, 3, 700) for task in range(40) for place in range(rng.randrange(cls))]
    found = packing._numbered(spark.createDataFrame(rows, "cls long, task long, place long").repartition(7)).toPandas()
    for cls, group in found.groupby("cls"):
        assert sorted(group._rank) == list(range(len(group))) and (group._n == sum(r[0] == cls for r in rows)).all()


# --- classifiers ----------------------------------------------------------------


def test_quality_learns_a_sign():
    texts = pa.array(["good fine text here"] * 40 + ["BAD!!! WORSE!!! TEXT!!!"] * 40)
    weights = quality.fit(iter([texts]), iter([np.array([1] * 40 + [0] * 40)]))
    scores = quality.score(pa.array(["other fine words", "AWFUL!!! WORDS!!!", "", None]), weights)
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3]


def test_forward_sums_all_segmentations():
    vocabulary = language.pieces()
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.ones(vocabulary.count), 2)).T
    # Words below and above the dense table's width, a long one of several stretches, pieces of up to 33 bytes.
    long_piece = max(vocabulary.strings, key=len).decode().strip()
    texts = ["the theory of", "être là", "internationalization " + "Verantwortlichkeit" * 2, None, "",
             "é" * 20 + " " + "é" * 21, long_piece, "x" + "misunderstanding" * 60 + long_piece * 12, "😀" * 9, "z" * 40 + " " + "z" * 41]
    found, first = language.word_log_likelihoods(pa.array(texts, pa.string()), log_p, vocabulary)
    for row, text in enumerate(texts):
        words = (text or "").split()
        assert first[row + 1] - first[row] == len(words)
        for at, word in enumerate(words):
            for lang in range(2):
                assert np.isclose(found[first[row] + at, lang], brute.segmentations(word, log_p[:, lang]), rtol=1e-9)


def test_every_piece_of_the_vocabulary_is_found():
    vocabulary = language.pieces()
    assert vocabulary.reach > 30
    width = vocabulary.reach
    units = np.zeros((vocabulary.count, width), np.uint8)
    for row, piece in enumerate(vocabulary.strings):
        units[row, : len(piece)] = list(piece)
    end, size, unit, piece = language.matches(units, vocabulary.sizes, vocabulary)
    whole = size == vocabulary.sizes[unit]
    assert np.array_equal(np.sort(unit[whole]), np.arange(vocabulary.count)) and np.array_equal(unit[whole], piece[whole])


def test_no_language_ties_by_underflow():
    vocabulary = language.pieces()
    log_p = np.full((vocabulary.count, 2), -25.0)
    log_p[:, 1] = -25.5
    found, _ = language.word_log_likelihoods(pa.array(["\x7f" * 40, "\x7f" * 5000]), log_p, vocabulary)
    assert np.isfinite(found).all() and (found[:, 0] > found[:, 1]).all()


# --- inverted lists -------------------------------------------------------------


@pytest.mark.parametrize("changed,pool", [(0, 9), (3, 10**6), (20, 40), (45, 60)])
def test_divide_skip_by_brute_force(changed, pool):
    """Sets from alike to unlike, some tiny; heap merge, skips and probes find what counting finds."""
    rng = np.random.default_rng(changed)
    base = np.arange(10**7, 10**7 + 50).astype(np.uint64)
    grams = []
    for k in range(120):
        own = base[: rng.integers(1, 51)].copy() if k % 5 == 0 else base.copy()
        own[rng.permutation(len(own))[:changed]] = rng.integers(0, pool, min(changed, len(own)))
        grams.append(rng.permutation(np.unique(own)))
    sizes = np.array([len(g) for g in grams])
    index = jaccard.Index(grams, sizes)
    sets = [set(g.tolist()) for g in grams]
    for q in range(len(grams)):
        open_ = rng.random(len(grams)) < (0.1 if q % 3 else 1)
        open_[q] = False
        found = index.search(grams[q], int(sizes[q]), open_)
        wanted = [k for k in np.flatnonzero(open_) if 100 * len(sets[q] & sets[k]) >= 80 * len(sets[q] | sets[k])]
        assert found.tolist() == wanted
        for least in (1, 2, 7, 30):
            low, high = np.searchsorted(index.values, grams[q], "left"), np.searchsorted(index.values, grams[q], "right")
            nodes, counts = index.merge(low, high, open_, least)
            both = {int(k): len(sets[q] & sets[k]) for k in np.flatnonzero(open_)}
            assert dict(zip(nodes.tolist(), counts.tolist())) == {k: c for k, c in both.items() if c >= least}


def family(seed, count, length, least, most):
    """Word lists that differ from one another in some places, a third of them in too many to be partners."""
    rng = np.random.default_rng(seed)
    base = words(seed, length, 10_000)
    out = []
    for _ in range(count):
        copy = list(base)
        for place in rng.integers(0, length, rng.integers(0, least) if rng.random() < 0.66 else rng.integers(least, most)):
            copy[place] = f"e{rng.integers(0, 6)}"
        out.append(copy)
    return out


def test_a_family_is_searched_from_few_nodes(monkeypatch):
    """Near copies that share most lists: each pair once, and long lists are not merged."""
    sets = [set(zip(*[t[k:] for k in range(5)])) for t in family(4, 300, 200, 3, 9)]
    held = Counter(g for s in sets for g in s)
    number = {g: k for k, g in enumerate(sorted(g for g, c in held.items() if c > 1))}
    order = np.random.default_rng(1).permutation(len(number)).astype(np.uint64) + np.uint64(5)
    grams = [np.sort(order[[number[g] for g in s if g in number]]) for s in sets]
    asked, popped = [], []
    search, pop = jaccard.Index.search, jaccard.heappop
    monkeypatch.setattr(jaccard.Index, "search", lambda self, *a: (asked.append(int(a[2].sum())), search(self, *a))[1])
    monkeypatch.setattr(jaccard, "heappop", lambda heap: (popped.append(1), pop(heap))[1])
    found = jaccard._search(pa.table({
        "role": pa.array([0] * 300, pa.int32()), "node": list(range(300)), "n": [len(s) for s in sets],
        "weight": [sum(min(held[g], 255) for g in s if g in number) for s in sets], "settled": [False] * 300,
        "grams": pa.array([g.tobytes() for g in grams], pa.binary()),
    }))
    pairs = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    links = set(map(tuple, map(sorted, zip(found["a"].to_pylist(), found["b"].to_pylist()))))
    assert links <= {tuple(sorted(p)) for p in pairs}

    def parts(edges):
        label = list(range(300))
        for _ in range(300):
            before = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    assert parts(links) == parts(pairs) and 2 < len(set(parts(pairs))) < 200
    assert len(asked) < 150 and len(popped) < 100_000  # 300 and 1.2 million when every node asked


@pytest.mark.parametrize("bounds", [{}, {"chunk_nodes": 12, "chunk_postings": 3_000}])
def test_a_family_with_members_apart(spark, bounds):
    texts = [" ".join(t) for t in family(8, 70, 120, 3, 9)]
    found = jaccard.similar_documents(docs_of(spark, texts), **bounds).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in found.collect()) == brute.jaccard(list(enumerate(texts)))


# --- language model -------------------------------------------------------------


def test_levels_hold_their_counts():
    counts = np.arange(1, 5_000)
    level = lm.levels(counts)
    assert (np.diff(level) >= 0).all()
    assert (lm.lower_end(level) <= counts).all() and (counts <= lm.upper_end(level)).all()
    assert (lm.upper_end(level) / lm.lower_end(level) < 2**0.5 + 0.01).all()
    assert lm.lower_end(np.array([-1, 0])).tolist() == lm.upper_end(np.array([-1, 0])).tolist() == [0, 1]


def test_a_segment_gives_back_levels():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(1, 500, 20_000) ** 2 // 300 + 1
    part = lm.segment_of(keys, lm.levels(counts))
    level = lm.levels_in(part, keys)
    assert (level >= lm.levels(counts)).all() and (level == lm.levels(counts)).mean() > 0.95
    strangers = rng.integers(0, 2**63, 10_000).astype(np.uint64)
    assert (lm.levels_in(part, strangers) >= 0).mean() < 0.05
    assert (lm.levels_in(lm.segment_of(keys[:0], counts[:0]), keys) == -1).all()


def counted(texts):
    """Counts of words, contexts and pairs, by plain Python."""
    words_, contexts, pairs = Counter(), Counter(), Counter()
    for t in texts:
        before = "<begin>"
        for w in [*brute.split(brute.lower(t)), "<end>"]:
            words_[w] += 1
            contexts[before] += 1
            pairs[before, w] += 1
            before = w
    return words_, contexts, pairs


def brute_probability(words_, pairs, texts, context, word):
    low = lambda c: math.ceil(2 ** (math.floor(2 * math.log2(c) + 1e-9) / 2) - 1e-9) if c else 0
    high = lambda c: max(math.ceil(2 ** ((math.floor(2 * math.log2(c) + 1e-9) + 1) / 2) - 1e-9) - 1, low(c)) if c else 0
    z = sum(low(c) + 1 for c in words_.values()) + 1
    of_context = texts if context == "<begin>" else high(words_[context])
    share = lm.BETA * of_context / (of_context + lm.RARE)
    pair = max(low(pairs[context, word]) - lm.DISCOUNT, 0) / max(of_context, 1)
    return (1 - share) * (low(words_[word]) + 1) / z + share * pair


LM_TEXTS = [" ".join(words(200 + k, 40, 300)) for k in range(40)] + ["only once", None, "only w1 w2 w1 w2 once", "W1 w2"]


def test_probabilities_sum_to_one_at_most():
    words_, _, pairs = counted(LM_TEXTS)
    unseen = "never seen"
    for context in ["<begin>", unseen, "only", "once", *[w for w, _ in words_.most_common(5)], *list(words_)[-5:]]:
        total = sum(brute_probability(words_, pairs, len(LM_TEXTS), context, w) for w in [*words_, unseen])
        assert 0.3 < total <= 1 + 1e-9
    # The same by the arrays the workers use.
    vocabulary = [*words_, unseen]
    level = lambda counts: np.where(np.array(counts) > 0, lm.levels(np.array(counts)), -1)
    z = float((lm.lower_end(level([words_[w] for w in words_])) + 1).sum()) + 1
    for context in ("<begin>", "w1", unseen):
        n = len(vocabulary)
        p = lm.probabilities(level([words_[w] for w in vocabulary]), np.full(n, level([words_[context]])[0]), level([pairs[context, w] for w in vocabulary]),
                             np.full(n, context == "<begin>"), len(LM_TEXTS), z)
        assert np.allclose(p, [brute_probability(words_, pairs, len(LM_TEXTS), context, w) for w in vocabulary])


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_scores_by_brute_force(spark, head):
    """Every pair counts, those seen once too, whatever the head; the filter is large, so that levels are exact."""
    docs = docs_of(spark, LM_TEXTS)
    learn = F.col("doc_id") % 5 != 0
    words_, _, pairs = counted([t for k, t in enumerate(LM_TEXTS) if k % 5])
    n = sum(k % 5 != 0 for k in range(len(LM_TEXTS)))
    got = {r["doc_id"]: r for r in lm.scored(docs, learn, head, 256).collect()}
    total, distinct = sum(words_.values()), len(words_)
    for k, text in enumerate(LM_TEXTS):
        each = [*brute.split(brute.lower(text)), "<end>"]
        p = [brute_probability(words_, pairs, n, a, b) for a, b in zip(["<begin>", *each], each)]
        assert abs(got[k]["score"] - sum(map(math.log10, p))) < 1e-9 * len(each)
        assert abs(got[k]["base_score"] - sum(math.log10((words_[w] + 1) / (total + distinct + 1)) for w in each)) < 1e-9 * len(each)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(each), sum(w in words_ for w in each), total)


def test_language_model_without_texts_to_learn_from(spark):
    rows = lm.scored(docs_of(spark, ["a b", None, ""]), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 3


def test_language_model_keeps_columns_of_any_name(spark):
    names = ["bucket", "chunk", "part", "data", "words", "pairs", "word_levels", "pair_levels", "word_counts", "learn", "learn_", "n", "v", "z", "times", "key", "kind"]
    docs = docs_of(spark, LM_TEXTS).withColumns({c: F.lit("kept") for c in names}).withColumn("score", F.lit(7)).withColumn("n_known", F.lit("x"))
    found = lm.scored(docs, F.lit(True))
    assert found.filter(" OR ".join(f"`{c}` <> 'kept'" for c in names)).isEmpty()
    assert found.count() == len(LM_TEXTS) and found.filter("score >= 0 OR n_known < 1").isEmpty()


# --- pairs ----------------------------------------------------------------------


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 160)} == {100} and found[201] == 200
    assert len(found) == 41 + 60 + 2


@pytest.mark.parametrize("bounds", [{}, {"chunk_nodes": 6, "chunk_postings": 2_000}])
def test_near_copies_around_a_centre(spark, bounds):
    """Copies that are each like the original and not like one another, and pairs at the limit."""
    base = words(9, 150, 10_000)
    texts = [" ".join(base)]
    for k in range(25):
        copy = list(base)
        copy[5 * k % 150] = f"x{k}"
        copy[(5 * k + 77) % 150] = f"y{k}"
        texts.append(" ".join(copy))
    for n in range(80, 101):
        half = words(1_000 + n, 104, 10_000)
        texts += [" ".join(half), " ".join(half[: n + 4])]
    texts += [" ".join(words(k, 30, 40)) for k in range(30)] + ["a b c", "A B C", "a b d"]
    rows = list(enumerate(texts))
    found = jaccard.similar_documents(docs_of(spark, texts), **bounds).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in found.collect()) == brute.jaccard(rows)


def test_seeds_tolerate_substitutions(spark):
    item = words(11, 40, 100_000)
    rng = random.Random(2)
    texts, caught = [], []
    for share in (0.0, 0.1, 0.2):
        for _ in range(10):
            passage = list(item)
            for at in rng.sample(range(40), int(40 * share)):
                passage[at] = f"z{rng.randrange(10**6)}"
            caught.append(len(texts))
            texts.append(" ".join(words(len(texts), 60, 100_000) + passage + words(len(texts) + 500, 60, 100_000)))
    clean = [" ".join(words(k + 900, 150, 100_000)) for k in range(20)]
    items = spark.createDataFrame([(0, " ".join(item).upper() + "!")], "item_id bigint, text string")
    upper = [t.upper() for t in texts[:5]] + texts[5:]
    found = {r["doc_id"] for r in decontaminate.overlaps(docs_of(spark, upper + clean), items).collect()}
    assert found <= set(caught) and len(found) >= 0.95 * len(caught)
    kept = decontaminate.without_contaminated(docs_of(spark, upper + clean), items)
    assert kept.count() == len(upper) + 20 - len(found)


@pytest.mark.parametrize("width", range(1, 14))
def test_masks_hit_every_stretch_that_agrees_enough(width):
    masks = [[k for k, sign in enumerate(m) if sign == "1"] for m in decontaminate.FAMILIES[width]]
    placed = [{at + k for k in m} for m, text in zip(masks, decontaminate.FAMILIES[width], strict=True) for at in range(width - len(text) + 1)]
    for differing in itertools.combinations(range(width), width - decontaminate.needed(width)):
        assert any(not p.intersection(differing) for p in placed), differing


def test_short_items_and_scattered_substitutions(spark):
    """Items of every length with as many tokens changed as the rule allows, and with one more."""
    rng = random.Random(5)
    items, texts, wanted = [], [], set()
    for size in [*range(1, 14), 40]:
        item = words(3_000 + size, size, 10**6)
        items.append((size, " ".join(item)))
        allowed = min(size, 13) - decontaminate.needed(size)
        patterns = list(itertools.combinations(range(min(size, 13)), allowed))
        for pattern in rng.sample(patterns, min(len(patterns), 40)):
            changed = [f"z{k}" if k % 13 in pattern else w for k, w in enumerate(item)]
            wanted.add((len(texts), size))
            texts.append(" ".join(words(5_000 + len(texts), 7, 10**6) + changed + words(9_000 + len(texts), 7, 10**6)))
        if size <= 13:
            texts.append(" ".join(f"z{k}" if k <= allowed else w for k, w in enumerate(item)))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs_of(spark, texts), frame).collect()} == wanted
    repeated = docs_of(spark, [f"a {items[0][1]} b {items[0][1]}", f"{items[0][1]}x"])
    assert [tuple(r) for r in decontaminate.overlaps(repeated, frame).collect()] == [(0, 1, 1, 0, 1, 1)]


def test_repeats_at_every_offset(spark):
    """A passage of exactly a window, wherever it lies against the blocks of the first document."""
    passage = words(21, 50, 100_000)
    texts = [" ".join(words(30 + k, 3 * k, 100_000) + passage + words(90 + k, 7 + k, 100_000)) for k in range(30)]
    texts.append(" ".join(passage[:49]))
    found = substrings.without_repeats(docs_of(spark, texts))
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in found.collect()}
    assert got == {0: [], 30: [], **{k: [(3 * k, 50)] for k in range(1, 30)}}


def test_cut_text_keeps_the_rest_as_it_was(spark):
    passage = "\n".join(words(22, 60))
    texts = [passage, "Before,  it \t" + passage + "\n after  it.\n"]
    row = substrings.without_repeats(docs_of(spark, texts)).filter("doc_id = 1").first()
    assert row["text"] == "Before,  it \tafter  it.\n"
    assert [tuple(x) for x in row["removed"]] == [(2, 60)]


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "ROW_BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(k, [int(x) for x in rng.integers(-3, 4, 5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    found = topk.top_k(df.filter("vec_id % 10 = 0"), df, 4)
    wanted = []
    for q, v in rows[::10]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in rows if k != q)
        wanted += [(q, rank + 1, k, -s) for rank, (s, k) in enumerate(scored[:4])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_shards_of_zero_and_huge_rows(spark):
    df = spark.createDataFrame([(k, 0 if k % 2 else None) for k in range(10)] + [(20, 10**12)], "k bigint, size bigint")
    rows = sharding.balanced_shards(df, "k", "size", 4).orderBy("k").collect()
    assert [r["k"] for r in rows] == [*range(10), 20] and all(0 <= r["shard"] < 4 for r in rows)
    assert rows == sorted(rows, key=lambda r: (r["shard"], r["slot"]))


@pytest.mark.parametrize("merged", [True, False])
def test_shards_come_from_files_by_bytes(spark, monkeypatch, merged):
    """Few rows are written to a few files; many partitions give the same shards and slots."""
    written = []
    monkeypatch.setattr(sharding, "cut", lambda df, name, of=sharding.cut: written.append(of(df, name)) or written[-1])
    sizes = [(k * 7919) % 1_000 for k in range(3_000)]
    rows = spark.range(3_000).select((F.col("id") * 7 % 3_000).alias("k")).withColumn("size", F.col("k") * 7919 % 1_000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(merged).lower())
    try:
        found = sorted(tuple(r) for r in sharding.balanced_shards(rows, "k", "size", 4).select("k", "shard", "slot").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(written) == 1
    files, parts = len(written[0].inputFiles()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files < parts if merged else files == parts
    wanted, counts, upto = [], Counter(), 0
    for k, size in enumerate(sizes):
        shard = min((2 * upto + size) * 4 // (2 * sum(sizes)), 3)
        wanted.append((k, shard, counts[shard]))
        counts[shard] += 1
        upto += size
    assert found == wanted


# --- columns and the pipeline -----------------------------------------------------


def test_clashing_columns_pass_through_the_pipeline(spark, clashing, hard_dir, monkeypatch):
    # A classifier that accepts all, so that every stage has rows.
    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *a, **k: np.zeros(2**quality.BITS + 1, np.float32))
    df = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{hard_dir}/clashing-{name}"
        stage(spark, df, hard_dir).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == df.columns
        assert out.filter(" OR ".join(f"`{c}` <> 'kept'" for c in CLASHING)).isEmpty()
        df = out
    assert corpus_pipeline.pack(spark, df, hard_dir).count() > 0


def test_inner_names_may_clash_too(spark, hard):
    """Columns that bear the names that operators use inside come back as they were."""
    inner = ["_size", "_first", "_any", "_part", "_row", "shard", "slot", "order", "tie", "c0", "a.b"]
    rows = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 7).alias("size"), *[F.lit(777).alias(c) for c in inner])
    found = sharding.balanced_shards(rows, "k", "size", 4, "_size")
    assert sorted(found.columns) == sorted(rows.columns)
    assert found.filter(" OR ".join(f"`{c}` <> 777" for c in inner if c not in ("shard", "slot"))).isEmpty()
    assert found.select("shard", "slot").distinct().count() == 40 and found.filter("shard > 3").isEmpty()
    inner = ["__keys", "__maybe", "__slot", "__word", "__set", "__removed", "keys", "removed", "c1", "a.b"]
    df = hard.select("doc_id", "text", *[F.lit("kept").alias(c) for c in inner])
    found = substrings.without_repeats(df)
    assert sorted(found.columns) == sorted(df.columns) and found.count() == df.count()
    assert found.filter(" OR ".join(f"`{c}` <> 'kept'" for c in inner if c != "removed")).isEmpty()
    assert not found.filter("size(removed) > 0").isEmpty()


def test_clashing_columns_of_operators(clashing):
    assert language.predict(clashing, [], np.zeros((language.pieces().count, 0))).filter("lang_pred <> 'und' OR score <> 0").isEmpty()
    assert quality.with_quality(clashing, np.zeros(2**quality.BITS + 1, np.float32)).filter("score <> 0.5 OR predicted <> 1").isEmpty()
    assert substrings.without_repeats(clashing).filter("size(removed) > 0").count() > 0
    assert jaccard.similar_documents(clashing).count() == clashing.count()
    assert lm.scored(clashing, F.lit(True)).filter("n = 'kept' AND score < 0").count() == clashing.count()


def test_pipeline_against_brute_force(spark, hard_dir, hard_rows, monkeypatch):
    """All stages on the hard cases; the classifier accepts all, so that the rest has work."""
    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *a, **k: np.zeros(2**quality.BITS + 1, np.float32))
    out = corpus_pipeline.run(spark, hard_dir).select("doc_id", "doc_tokens").distinct().collect()
    # A key for each row: ids that stand once, then numbers above them.
    ids = Counter(r[0] for r in hard_rows)
    rows = [(r[0] if r[0] is not None and ids[r[0]] == 1 else 1_000 + k, r[1]) for k, r in enumerate(hard_rows)]
    old = {rows[k][0]: r[0] for k, r in enumerate(hard_rows)}
    kept = sorted((i, t) for (i, t), (_, _, c) in zip(rows, brute.jaccard(rows)) if c == i)
    cut = {}
    for (i, t), (_, _, gone, _) in zip(kept, brute.substring_dedup(kept)):
        cut[i] = (t, gone)
    items = [(0, " ".join(words(1, 140)[30:55]))]
    texts = {r["doc_id"]: r["text"] for r in substrings.without_repeats(spark.createDataFrame(kept, "doc_id bigint, text string")).collect()}
    assert all((texts[i] == t) == (gone == 0) for i, (t, gone) in cut.items())
    left = {i: t for i, t in texts.items() if not cut[i][1] or brute.split(t)}
    leaked = {i for i, _ in brute.overlaps([(i, t) for i, t in left.items() if len(t or "") < 5_000], items)}
    wanted = [(old[i], len(brute.encode("word_bpe_49k.json", t, 1))) for i, t in left.items() if i not in leaked]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted({(r["doc_id"], r["doc_tokens"]) for r in out}, key=key) == sorted(set(wanted), key=key)


@pytest.mark.parametrize("most", [100_000, 0])
def test_stages_judge_rows_by_their_text(spark, tmp_path, monkeypatch, most):
    """Unlike texts that share an id stay, copies and leaks without an id go; few or many repeated ids."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most)
    leak = " ".join(words(900, 40, 5_000))
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d = (" ".join(words(k, 80, 5_000)) for k in (901, 902, 903, 904))
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, a), (2, None), (2, ""), (None, None), (3, leak + " " + d), (None, "x " + leak), (4, d + " " + a)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"doc_id_": F.lit("kept"), "_id": F.lit("kept")}).write.parquet(path)
    docs = spark.read.parquet(path)
    found = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    once = found(corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path)))
    assert sum(once[i, t] for i, t in rows if t == a) == 1 and once[1, b] == 1 and once[None, c] == 1
    assert all(once[r] == 1 for r in [(2, None), (2, ""), (None, None), (4, d + " " + a)])
    clean = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.filter("doc_id_ <> 'kept' OR _id <> 'kept'").isEmpty()
    assert found(clean) == Counter(r for r in rows if leak not in (r[1] or ""))
    short = corpus_pipeline.cut_repeats(spark, docs.filter("doc_id IS NULL OR doc_id = 4"), str(tmp_path))
    assert sorted(len(brute.split(r["text"])) for r in short.collect()) == sorted([160, 80, 41, 0])
