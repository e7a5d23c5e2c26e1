"""Small tables of hard cases: NULLs, empty and long texts, repeats, clashing columns."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["score", "predicted", "removed", "keys", "node", "n", "shard", "slot", "bin", "lang_pred", "held_out", "size", "label", "c"]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]


@pytest.fixture(scope="session")
def hard_rows():
    base, other = words(1, 140), words(2, 200)
    near = list(base)
    near[70] = "changed"
    rows = [
        (1, " ".join(base), "en"),
        (2, " ".join(near), "en"),
        (3, " ".join(base), "en"),
        (4, None, "en"),
        (5, "", "fr"),
        (6, " \t\n\v\f\r ", None),
        (7, "one", "fr"),
        (8, "Deux  mots", "fr"),
        (9, "\n".join(other[:60]) + "  " + "\t".join(base[20:90]) + " end", "fr"),
        (10, " ".join(words(3, 30_000, 5_000)), "de"),
        (11, "x" * 100_000, "de"),
        (12, "... 123 !!", "de"),
        (None, " ".join(base), "en"),
        (None, None, None),
        (3, " ".join(base), "en"),
        (13, " ".join(other), "es"),
        (14, " ".join(other[:-1]), "es"),
        (15, " ".join(["same"] * 300), "es"),
        (16, " ".join(["same"] * 120), "es"),
        (17, "ÀÉ 日本語   text\u0000nul", None),
        (-5, " ".join(words(4, 80) + base[40:100]), "en"),
    ]
    return [(i, t, lang, f"src{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(hard):
    from pyspark.sql import functions as F

    return hard.withColumns({c: F.lit("kept") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def hard_dir(spark, hard, tmp_path_factory):
    """The hard cases as a folder of tables that the registered queries read."""
    folder = str(tmp_path_factory.mktemp("hard"))
    hard.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (8, 1, 0), (12, 0, 1), (12, None, None), (None, 1, 0), (99, 0, 0)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(words(1, 140)[30:55])), (1, None), (2, ""), (3, "too short"), (None, "no id but a text of some words"), (0, " ".join(words(1, 140)[30:55]))],
                          "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(0, [0.5, -0.25, 1.0], 1), (100, [0.5, -0.25, 1.0], 1), (200, [float("nan"), 0.0, 1.0], 1), (3, [0.5, -0.25, 1.0], 1), (4, None, 1),
               (5, [], 1), (6, [1.0], 1), (7, [None, 1.0, 2.0], 1), (8, [float("inf"), 1.0, 2.0], 1), (3, [0.5, -0.25, 1.0], 1), (None, [1.0, 1.0, 1.0], 1),
               (9, [0.1, 0.2, 0.3, 0.4], 1)] + [(20 + k, [0.0, 0.0, 0.5], 2) for k in range(15)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, hard_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{hard_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
