import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkset import ClassLabel, Dataset, Features, SplitDict
from sparkset.functions.cast import CastError
from sparkset.functions import features as ft
from sparkset.operators import sampler

ROWS = [{"id": f"r{i}", "input": f"q{i}", "expected": str(i), "metadata": {"difficulty": d}} for i, d in enumerate(("easy", "easy", "medium", "medium", "hard"))]


@pytest.fixture
def five(spark):
    return Dataset.from_list(spark, ROWS, name="five")


def ids(d):
    return [r["id"] for r in d.to_list()]


def test_positions(five):
    assert ids(five.take(2)) == ["r0", "r1"] and ids(five.take(0)) == [] and ids(five.take(9)) == ids(five)
    assert ids(five.skip(3)) == ["r3", "r4"] and ids(five.skip(9)) == []
    assert ids(five.slice(1, 2)) == ["r1", "r2"] and ids(five.slice(-2, 2)) == ["r3", "r4"] and ids(five.slice(-9, 2)) == ["r0", "r1"]
    assert ids(five.select([4, 0, 0, -1, 7, -6])) == ["r4", "r0", "r0", "r4"]
    assert ids(five.select(range(0, 5, 2))) == ["r0", "r2", "r4"]
    assert ids(five.select([])) == []
    assert [ids(b) for b in five.batch(2)] == [["r0", "r1"], ["r2", "r3"], ["r4"]]
    assert [ids(five.shard(3, i)) for i in range(3)] == [["r0", "r1"], ["r2", "r3"], ["r4"]]
    assert five[0]["id"] == "r0" and five[-1]["id"] == "r4" and five.get(5) is None
    with pytest.raises(IndexError):
        five[5]
    assert ids(five.update(1, {"id": "new"})) == ["r0", "new", "r2", "r3", "r4"]
    gone, rest = five.pop(-1)
    assert gone["id"] == "r4" and len(rest) == 4


def test_any_number_of_batches_is_one_plan(spark, five):
    batches = Dataset.from_frame(spark.range(3000).select((2999 - F.col("id")).alias("id"), F.lit("b").alias("batch")), "id", name="d").batch(2)
    assert len(batches) == 1500 and batches[-1].name == "d_batch_1499" and [r["id"] for r in batches[-1].to_list()] == [2998, 2999]
    rows = batches.rows()
    assert rows.columns == ["id", "batch"] and "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(i, i // 2) for i in range(3000)]
    assert [ids(b) for b in five.batch(2)[1:]] == [["r2", "r3"], ["r4"]] and list(five.take(0).batch(2)) == []
    with pytest.raises(IndexError):
        five.batch(2)[3]
    with pytest.raises(ValueError):
        five.batch(0)


def test_order_survives_filters_and_sorts(five):
    kept = five.filter(F.col("id") != "r2")
    assert ids(kept) == ["r0", "r1", "r3", "r4"] and ids(kept.skip(2)) == ["r3", "r4"]
    d = five.map({"k": F.when(F.col("id") == "r1", None).otherwise(F.length("metadata.difficulty"))})
    assert ids(d.sort("k")) == ["r0", "r4", "r2", "r3", "r1"]  # nulls follow numbers, ties stay
    assert ids(d.sort("k", "desc")) == ["r1", "r2", "r3", "r0", "r4"]
    assert ids(d.sort("k").sort("id", "desc")) == ["r4", "r3", "r2", "r1", "r0"]
    assert ids(d.sort("k").take(2)) == ["r0", "r4"]
    b = five.map({"b": F.when(F.col("id") == "r0", None).otherwise(F.col("id") > "r2")})
    assert ids(b.sort("b")) == ["r1", "r2", "r0", "r3", "r4"]  # false, null, true


def test_projections(five):
    assert five.select(["id", "nope"]).column_names == ["id"]
    assert five.rename_column("id", "key").column_names[0:1] == ["expected"] or "key" in five.rename_column("id", "key").column_names
    assert five.rename_column("id", "input").to_list()[0]["input"] == "r0"
    assert five.rename_column("absent", "x").column_names == five.column_names
    assert five.flatten("metadata").to_list()[2]["metadata_difficulty"] == "medium"
    assert five.flatten("id").column_names == five.column_names
    assert [r["i"] for r in five.add_column("i", lambda i: i * 10).to_list()] == [0, 10, 20, 30, 40]
    assert five.to_dict(["id"]) == {"id": ["r0", "r1", "r2", "r3", "r4"]}
    five.validate()
    with pytest.raises(ValueError):
        five.remove_columns("expected").validate()


def test_python_functions(five):
    assert ids(five.filter(lambda r: None if r["id"] == "r0" else r["id"] != "r1")) == ["r2", "r3", "r4"]
    assert ids(five.filter(lambda r: 0)) == ids(five)  # only None and False drop a row
    twice = five.map(lambda rows: [{"id": r["id"] + s} for r in rows for s in "ab"], "id string", batched=True, batch_size=2)
    assert ids(twice) == [f"r{i}{s}" for i in range(5) for s in "ab"]
    assert [r["n"] for r in five.map(lambda r: {"n": len(r["id"])}, "n long").to_list()] == [2] * 5


def test_unique_concat(spark, five):
    d = Dataset.from_list(spark, [{"c": "a", "v": 1}, {"c": None, "v": 2}, {"c": "a", "v": 3}, {"c": None, "v": 4}])
    assert [r["v"] for r in d.unique("c").to_list()] == [1, 2]
    assert [r["v"] for r in d.sort("v", "desc").unique("c").to_list()] == [4, 3]
    both = five.select(["id"]).concat(d)
    assert len(both) == 9 and both.to_list()[5] == {"id": None, "c": "a", "v": 1}


def test_cast(spark):
    d = Dataset.from_list(spark, [{"x": "1", "label": "neg"}, {"x": "2", "label": "pos"}])
    made = d.cast(Features(x=ft.float32, label=ClassLabel(names=["neg", "pos"])))
    assert made.to_list() == [{"x": 1.0, "label": 0}, {"x": 2.0, "label": 1}]
    assert made.features["label"].names == ["neg", "pos"] and made.filter(F.col("x") > 0).features["label"].names == ["neg", "pos"]
    with pytest.raises(CastError) as e:
        Dataset.from_list(spark, [{"x": "not_a_number"}, {"x": "3"}]).cast_column("x", ft.int64)
    assert e.value.wrong == {"x": 1}
    with pytest.raises(CastError):
        Dataset.from_list(spark, [{"x": None, "y": 1}], "x string, y long").cast_column("x", ft.int64, strict=True)
    lists = Dataset.from_list(spark, [{"x": ["1", "2"]}, {"x": ["1", "q"]}]).cast_column("x", ft.Sequence(ft.int32), errors="null")
    assert [r["x"] for r in lists.to_list()] == [[1, 2], None]


def test_class_encode(spark):
    d = Dataset.from_list(spark, [{"label": "b"}, {"label": None}, {"label": "a"}])
    assert [r["label"] for r in d.class_encode_column("label").to_list()] == [1, None, 0]
    assert [r["label"] for r in d.class_encode_column("label", include_nulls=True).to_list()] == [1, 2, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000])
@pytest.mark.parametrize("seed", [0, 7, 42])
def test_shuffle_is_numpys(spark, n, seed):
    d = Dataset.from_list(spark, [{"x": i} for i in range(n)], "x long").shuffle(seed)
    assert [r["x"] for r in d.to_list()] == np.random.Generator(np.random.PCG64(seed)).permutation(n).tolist()


def test_splits(spark):
    rows = Dataset.from_list(spark, [{"x": i, "label": "pos" if i % 5 else "neg"} for i in range(100)])
    s = rows.train_test_split(test_size=0.2, stratify_by="label", seed=1)
    assert len(s["train"]) == 80 and sum(r["label"] == "neg" for r in s["test"].to_list()) == 4
    again = rows.train_test_split(test_size=0.2, stratify_by="label", seed=1)
    assert s["test"].to_list() == again["test"].to_list()
    a, b = rows.split(0.333)
    assert (len(a), len(b)) == (33, 67)
    folds = sampler.k_fold(rows.take(10), 3, shuffle=False)
    assert [[r["x"] for r in f["test"].to_list()] for f in folds] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert all(len(f["train"]) == 7 for f in folds)
    drawn = sampler.stratified(rows, 10, "label", seed=4)
    assert len(drawn) == 10 and drawn.metadata["strata_distribution"] == {"neg": 2, "pos": 8}
    assert sampler.random(rows, 10, seed=2).to_list() == sampler.random(rows, 10, seed=2).to_list()


def test_split_dict(spark, five):
    s = SplitDict({"train": five.take(3), "test": five.skip(3)})
    assert s.split_names == ["test", "train"] and s.num_rows == {"test": 2, "train": 3}
    assert ids(s.flatten()) == ["r3", "r4", "r0", "r1", "r2"]
    assert s.rename_split("absent", "x").split_names == s.split_names and s.rename_split("test", "dev").split_names == ["dev", "train"]
    assert s.filter(F.col("id") == "r0").num_rows == {"test": 0, "train": 1} and len(s.delete("test")) == 1
    assert len(s.map(lambda d: d.take(1)).flatten()) == 2


def test_formats(five, spark):
    d = Dataset.from_list(spark, [{"v": [float(i), 1.0], "s": "x"} for i in range(5)])
    batches = list(d.set_format("numpy").iter(2))
    assert [b["v"].shape for b in batches] == [(2, 2), (2, 2), (1, 2)] and batches[0]["v"].dtype == np.float32
    assert len(list(d.set_format("numpy").iter(2, drop_last=True))) == 2
    assert list(d.set_format("pandas", ["s"]).iter(5))[0].columns.tolist() == ["s"]
    assert list(d.set_format("custom", transform=lambda r: r["s"])) == ["x"] * 5
    assert next(iter(d.set_format("numpy").reset_format())) == {"s": "x", "v": [0.0, 1.0]}
    with pytest.raises(ValueError):
        d.set_format("tensor")


def test_search(spark, tmp_path):
    d = Dataset.from_list(spark, [{"id": i, "e": e} for i, e in enumerate(([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]))]).add_index("e")
    scores, rows = d.get_nearest_examples("e", [1, 0, 0], 2)
    assert rows[0]["id"] == 0 and scores[0] == pytest.approx(1)
    assert [r["id"] for r in d.get_nearest_examples("e", [0, 0, 0], 9)[1]] == [0, 1, 2, 3]  # ties by position, k over n
    d.save_index("e", f"file://{tmp_path}/index")
    assert d.drop_index("e").load_index("e", f"file://{tmp_path}/index").get_nearest_examples("e", [0, 1, 0], 1)[1][0]["id"] == 1
    with pytest.raises(ValueError):
        d.drop_index("e").get_nearest_examples("e", [1, 0, 0])
    l2 = Dataset.from_list(spark, [{"e": e} for e in ([0.0, 0.0], [1.0, 1.0], [10.0, 10.0])]).add_index("e", "l2")
    assert l2.indices["e"].search([0.1, 0.1], 2)[0][1] == pytest.approx(-0.02)


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_nearest_of_many_queries(spark, metric):
    from sparkset.operators import search

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)] + [(300, None), (301, [0.0] * 3)]  # many equal vectors
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(5)
    got = search.top_k_many(df, "e", df.where("id % 20 = 0"), "id", "e", 7, metric, tie="id", block=4)
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect())
    want = []
    for q, v in rows[:300:20]:
        top = search.top_k(df, "e", v, 7, metric, tie="id").collect()
        want += [(q, n, r["id"], round(r["score"], 9)) for n, r in enumerate(top, 1)]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[3] + 0.0 for x in got] == [x[3] + 0.0 for x in want]
    if metric != "cosine":  # whole numbers: equal scores are equal to the last bit
        assert got == want
    assert search.top_k_many(df, "e", df.limit(0), "id", "e", tie="id").count() == 0


def test_fingerprints(five):
    from sparkset.plans import fingerprint

    assert five.take(2).fingerprint == five.take(2).fingerprint != five.take(3).fingerprint
    assert fingerprint.generate("map", [lambda x: x + 1]) != fingerprint.generate("map", [lambda x: x + 2])


def test_cache(spark, tmp_path):
    from sparkset.plans.cache import TableCache

    cache = TableCache(spark, str(tmp_path / "c"))
    assert cache.get("k") is None
    assert cache.cached("k", lambda: spark.range(3)).count() == 3 and cache.cached("k", lambda: spark.range(9)).count() == 3
    assert cache.list() == ["k"] and cache.stats()["entries"] == 1
    d = Dataset.from_frame(spark.range(5), "id")
    assert [r["id"] for r in d.skip(2).cached(cache).to_list()] == [2, 3, 4] and len(d.skip(2).cached(cache, "own", 1)) == 3
    cache.invalidate("k")
    assert len(cache.list()) == 2
    cache.max_bytes = 0
    assert len(cache.cleanup()) == 2 and cache.list() == []


def test_images_without_a_decoder(spark):
    from sparkset.functions import media

    df = spark.createDataFrame([(bytearray(b"no image"), None)], "bytes binary, path string").select(F.struct("bytes", "path").alias("image"))
    made = media.decode_or_keep(df, "image").first()
    assert made["image"]["bytes"] == b"no image" and (made["image_decoded"] is None or made["image_decoded"]["height"] is None)
    with pytest.raises(ValueError):
        media.decode_image(F.col("image.bytes"), "CMYK")


def test_plans_scale(spark):
    """Positions come without a single-task window, and a top-k without a full sort."""
    d = Dataset.from_frame(spark.range(1000), "id").sort("id", "desc")
    plan = lambda x: x.frame._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(d.take(5))
    for made in (d.skip(5), d.shard(4, 1), d.shuffle(1), d.unique("id")):
        assert "SinglePartition" not in plan(made) and "Window" not in plan(made)


def test_ranks_add_up_over_blocks(spark):
    from sparkset.operators.dataset import _ranked_in_group

    given = [(i, None if i % 7 == 0 else "ab"[i % 3 % 2]) for i in range(100)]
    seen, want = {}, {}
    for i, g in given:
        want[i] = seen[g] = seen.get(g, -1) + 1
    frame = spark.createDataFrame(given, "__pos long, g string").repartition(5)
    for block in (1, 10, 1000):
        made = _ranked_in_group(frame, "g", block)
        assert made.columns == ["__pos", "g", "__rank"] and {r["__pos"]: r["__rank"] for r in made.collect()} == want


def test_long_permutations_are_drawn_in_slices(spark, monkeypatch):
    from sparkset.operators import dataset

    d = Dataset.from_list(spark, [{"a": i} for i in range(23)])
    want = [r["a"] for r in d.shuffle(seed=42).to_list()]
    monkeypatch.setattr(dataset, "MOST_PERMUTED", 5)
    assert [r["a"] for r in d.shuffle(seed=42).to_list()] == want == np.random.Generator(np.random.PCG64(42)).permutation(23).tolist()


def test_cached_operations(spark, tmp_path):
    from sparkset.plans.cache import TableCache

    cache, d = TableCache(spark, str(tmp_path)), Dataset.from_list(spark, [{"a": i} for i in range(20)])
    odd = lambda row: row["a"] % 2 == 1
    first = d.filter(odd, cache=cache)
    again = d.filter(odd, cache=cache)
    assert [r["a"] for r in again.to_list()] == [r["a"] for r in first.to_list()] == list(range(1, 20, 2)) and (cache.hits, cache.misses) == (1, 1)
    assert [r["a"] for r in d.filter(F.col("a") > 17, cache=cache).to_list()] == [18, 19] and cache.misses == 2
    doubled = d.map(lambda row: {"a": row["a"] * 2}, cache=cache, new_fingerprint="doubled")
    assert "doubled" in cache.list() and [r["a"] for r in doubled.to_list()] == list(range(0, 40, 2))
    assert [r["a"] for r in d.map({"a": F.col("a") * 9}, cache=cache, new_fingerprint="doubled").to_list()] == list(range(0, 40, 2))


def test_adding_to_an_index(spark):
    some = Dataset.from_list(spark, [{"v": [1.0, 0.0]}, {"v": [0.0, 1.0]}]).add_index("v")
    both = some.add_to_index("v", Dataset.from_list(spark, [{"v": [0.6, 0.8]}, {"v": None}, {"v": [3.0, 0.1]}]))
    scores, found = both.get_nearest_examples("v", [1.0, 0.0], 2)
    assert [r["v"] for r in found] == [[1.0, 0.0], [3.0, 0.1]] and scores[0] == 1.0
    with pytest.raises(ValueError, match="no index"):
        both.drop_index("v").add_to_index("v", some)
