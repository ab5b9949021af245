"""Queries of the library's own operators over the driver's tables, with the SQL that gives the same rows.

Each is one operator on a whole table, ordered by the table's natural key; ``pos`` columns carry the order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.functions import answers, cast, conversations, preference, shapes
from sparkset.functions import features as ft
from sparkset.operators import allocate, sampler, search
from sparkset.operators.dataset import Dataset
from sparkset.operators.splits import SplitDict
from sparkset.plans.cache import TableCache
from sparkset.session import shared_folder
from sparkset.sources import formats, registry, sinks
from sparkset.streaming.iterable import IterableDataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLE_SQL[key] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> Dataset:
    df = _table(spark, sf_dir, "documents")
    return Dataset.from_frame(df.select(*columns) if columns else df, "doc_id", name="documents")


def _numbered(d: Dataset, *columns: str) -> DataFrame:
    return d.with_position().select("pos", *columns)


# -- filters and projections ------------------------------------------------------------------------------------------


@_register("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100")
def flagship(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars").filter(F.col("lang") == "en")
    return d.select(["doc_id", "source", "n_chars"]).sort("n_chars", "desc").take(100).df


@_register("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def filter_lang(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang", "n_chars").filter(F.col("lang") == "en").df


@_register("SELECT doc_id, n_chars FROM documents WHERE n_chars % 7 = 0")
def filter_python(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "n_chars").filter(lambda r: r["n_chars"] % 7 == 0).df


@_register("SELECT doc_id, lang, source FROM documents")
def select_columns(spark, sf_dir):
    return _docs(spark, sf_dir).select(["doc_id", "lang", "source", "no_such_column"]).df


@_register("SELECT doc_id, lang AS language, n_chars FROM documents")
def rename_column(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang", "n_chars").rename_column("lang", "language").df


@_register("SELECT doc_id, n_chars FROM documents")
def remove_columns(spark, sf_dir):
    return _docs(spark, sf_dir).remove_columns("text", "lang", "source", "absent").df


@_register("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, n_chars * 2 AS twice FROM documents")
def add_column_index(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "n_chars").add_column("idx", lambda i: i).add_column("twice", F.col("n_chars") * 2)
    return d.select(["doc_id", "idx", "twice"]).df


@_register("SELECT doc_id, n_chars + row_number() OVER (ORDER BY doc_id) - 1 AS total FROM documents")
def add_column_python(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "n_chars").add_column("total", lambda r, i: r["n_chars"] + i, returns="long").select(["doc_id", "total"]).df


@_register("SELECT doc_id, lang AS s_lang, n_chars AS s_n FROM documents")
def flatten_struct(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.col("n_chars").alias("n")).alias("s"))
    return Dataset.from_frame(df, "doc_id").flatten("s").df


@_register("SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars END AS m_en, CASE WHEN lang <> 'en' THEN n_chars END AS m_other FROM documents")
def flatten_map(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.when(F.col("lang") == "en", "en").otherwise("other"), "n_chars").alias("m"))
    return Dataset.from_frame(df, "doc_id").flatten("m").df


@_register("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM customer")
def class_encode(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return Dataset.from_frame(df, "c_custkey").class_encode_column("c_mktsegment").df


@_register("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(value AS INTEGER) AS whole FROM (SELECT event_id, props, trunc(value) AS value FROM events)")
def cast_columns(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("whole"))
    return Dataset.from_frame(df, "event_id").cast(ft.Features(k=ft.int64, whole=ft.int32), errors="null").df


@_register("SELECT doc_id, toxic = 1 AS toxic, CAST(quality AS VARCHAR) AS quality FROM labels")
def cast_bool_string(spark, sf_dir):
    return Dataset.from_frame(_table(spark, sf_dir, "labels"), "doc_id").cast(ft.Features(toxic=ft.boolean, quality=ft.string)).df


_GUARD = ["' 1 '", "'1.7'", "'+3'", "'NaN'", "'-12'", "'1e3'", "'.5'", "'TRUE'", "'true'", "'300'", "NULL", "'99999999999999999999'"]


@_register(
    "SELECT i, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS as_int64, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') AND TRY_CAST(s AS BIGINT) BETWEEN -128 AND 127 THEN CAST(s AS TINYINT) END AS as_int8, "
    "CASE WHEN regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(s AS DOUBLE) END AS as_float, CASE s WHEN 'true' THEN true WHEN 'false' THEN false END AS as_bool "
    f"FROM (VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(_GUARD))}) v(i, s)"
)
def cast_guards(spark, sf_dir):
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(_GUARD))} AS v(i, s)")
    kind = df.schema["s"].dataType
    made = {"as_int64": ft.int64, "as_int8": ft.int8, "as_float": ft.float64, "as_bool": ft.boolean}
    return df.select("i", *[cast.cast_column_expr(F.col("s"), kind, f).alias(k) for k, f in made.items()])


@_register("SELECT count(*) FILTER (len(embedding) <> 64) AS bad_vectors, count(*) FILTER (label < 0 OR label > 4) AS bad_labels FROM embeddings")
def validate_features(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    matrix = F.transform("embedding", lambda x: F.array(x))
    sized = cast._shaped(matrix, spark.range(0).select(F.array(F.array(F.lit(0.0))).alias("x")).schema["x"].dataType, (64, 1))
    return df.agg(F.count_if(~sized).alias("bad_vectors"), F.count_if(~cast.valid(F.col("label"), kinds["label"], ft.ClassLabel(num_classes=5))).alias("bad_labels"))


# -- positions --------------------------------------------------------------------------------------------------------

_RN = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)"


@_register("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def sort_desc_take(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "n_chars").sort("n_chars", "desc").take(100).df


@_register("SELECT row_number() OVER (ORDER BY k DESC NULLS FIRST, doc_id) - 1 AS pos, doc_id, k FROM (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars % 11 END AS k FROM documents)")
def sort_numbers_with_nulls(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "n_chars").map({"k": F.when(F.col("n_chars") % 5 == 0, None).otherwise(F.col("n_chars") % 11)})
    return _numbered(d.sort("k", "desc"), "doc_id", "k")


@_register("SELECT row_number() OVER (ORDER BY k ASC NULLS FIRST, doc_id) - 1 AS pos, doc_id, k FROM (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE source END AS k FROM documents)")
def sort_strings_with_nulls(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "n_chars", "source").map({"k": F.when(F.col("n_chars") % 5 == 0, None).otherwise(F.col("source"))})
    return _numbered(d.sort("k"), "doc_id", "k")


@_register(f"SELECT rn - 10 AS pos, doc_id FROM {_RN} WHERE rn BETWEEN 10 AND 29")
def skip_take(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").skip(10).take(20), "doc_id")


@_register(f"SELECT rn - 5 AS pos, doc_id FROM {_RN} WHERE rn BETWEEN 5 AND 54")
def slice_rows(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").slice(5, 50), "doc_id")


@_register(f"SELECT rn - (n - 7) AS pos, doc_id FROM {_RN} WHERE rn >= n - 7 AND rn < n - 2")
def slice_negative(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").slice(-7, 5), "doc_id")


@_register(f"SELECT (rn - 3) // 4 AS pos, doc_id FROM {_RN} WHERE rn BETWEEN 3 AND 99 AND (rn - 3) % 4 = 0")
def select_range(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").select(range(3, 100, 4)), "doc_id")


@_register(f"SELECT row_number() OVER (ORDER BY o) - 1 AS pos, doc_id FROM (VALUES (0, 5), (1, 0), (2, 5), (3, -1), (4, 1000000000), (5, 17), (6, -3)) w(o, i) JOIN {_RN} ON rn = CASE WHEN i < 0 THEN n + i ELSE i END")
def gather_indices(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").select([5, 0, 5, -1, 1_000_000_000, 17, -3]), "doc_id")


@_register("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS batch, o_orderkey FROM orders")
def batch_rows(spark, sf_dir):
    d = Dataset.from_frame(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return d.batch(5000).rows()


@_register("SELECT rn AS pos, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 - ((n // 7) * 3 + least(3, n % 7)) AS rn, n FROM (SELECT doc_id, count(*) OVER () AS n FROM documents)) WHERE rn >= 0 AND rn < n // 7 + CASE WHEN 3 < n % 7 THEN 1 ELSE 0 END")
def shard_rows(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").shard(7, 3), "doc_id")


@_register("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def unique_first(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "source").unique("source").df


@_register("SELECT row_number() OVER (ORDER BY s, doc_id) - 1 AS pos, doc_id, lang, n_chars FROM (SELECT 0 AS s, doc_id, lang, NULL AS n_chars FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id, NULL, n_chars FROM documents WHERE lang = 'fr')")
def concat_two(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "lang", "n_chars")
    one = d.filter(F.col("lang") == "de").remove_columns("n_chars")
    return _numbered(one.concat(d.filter(F.col("lang") == "fr").remove_columns("lang")), "doc_id", "lang", "n_chars")


def _by_lang(spark, sf_dir) -> SplitDict:
    d = _docs(spark, sf_dir, "doc_id", "lang")
    return SplitDict({x: d.filter(F.col("lang") == x) for x in ("en", "de", "fr", "es")})


@_register("SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS pos, doc_id FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def dict_flatten(spark, sf_dir):
    return _numbered(_by_lang(spark, sf_dir).flatten(), "doc_id")


@_register("SELECT lang AS split, count(*) AS n_rows FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang")
def dict_num_rows(spark, sf_dir):
    return _by_lang(spark, sf_dir).counted()


# -- maps -------------------------------------------------------------------------------------------------------------


@_register("SELECT doc_id, upper(lang) AS lang FROM documents")
def map_expressions(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang").map({"lang": F.upper("lang")}).df


@_register("SELECT doc_id, n_chars % 10 AS digit FROM documents")
def map_python(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "n_chars").map(lambda r: {"doc_id": r["doc_id"], "digit": r["n_chars"] % 10}, "doc_id long, digit long").df


@_register("SELECT doc_id, unnest([0, 1]) AS copy FROM documents")
def map_batches(spark, sf_dir):
    twice = lambda rows: [{"doc_id": r["doc_id"], "copy": c} for r in rows for c in (0, 1)]
    return _docs(spark, sf_dir, "doc_id").map(twice, "doc_id long, copy long", batched=True, batch_size=300).df.select("doc_id", F.col("copy").cast("int").alias("copy"))


# -- shuffles, splits, samples ----------------------------------------------------------------------------------------


@_register()
def shuffle_seed42(spark, sf_dir):
    return _numbered(_docs(spark, sf_dir, "doc_id").shuffle(42), "doc_id")


def _permutation(n: int, seed: int) -> list[int]:
    return np.random.Generator(np.random.PCG64(seed)).permutation(n).tolist()


_P25 = ", ".join(f"({i}, {p})" for i, p in enumerate(_permutation(25, 42)))


@_register(f"SELECT CAST(o AS BIGINT) AS pos, n_name FROM (VALUES {_P25}) w(o, i) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) ON rn = i")
def shuffle_seeded_nations(spark, sf_dir):
    return _numbered(Dataset.from_frame(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").shuffle(42), "n_name")


_ORN = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)"


def _orders(spark, sf_dir) -> Dataset:
    return Dataset.from_frame(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def _labelled_parts(parts: dict[str, Dataset], *columns: str) -> DataFrame:
    out = None
    for k, p in parts.items():
        one = _numbered(p, *columns).withColumn("part", F.lit(k))
        out = one if out is None else out.unionAll(one)
    return out


@_register(f"SELECT CASE WHEN rn < cut THEN rn ELSE rn - cut END AS pos, o_orderkey, CASE WHEN rn < cut THEN 'train' ELSE 'test' END AS part FROM (SELECT *, CAST(floor(n * 0.8 + 0.5) AS BIGINT) AS cut FROM {_ORN})")
def split_80_20(spark, sf_dir):
    return _labelled_parts(dict(zip(("train", "test"), _orders(spark, sf_dir).split(0.8))), "o_orderkey")


@_register(f"SELECT CASE WHEN rn < cut THEN rn ELSE rn - cut END AS pos, o_orderkey, CASE WHEN rn < cut THEN 'train' ELSE 'test' END AS part FROM (SELECT *, n - CAST(floor(n * 0.25 + 0.5) AS BIGINT) AS cut FROM {_ORN})")
def tts_unshuffled(spark, sf_dir):
    return _labelled_parts(_orders(spark, sf_dir).train_test_split(shuffle=False), "o_orderkey")


@_register(f"SELECT CASE WHEN rn < 1000 THEN rn ELSE rn - 1000 END AS pos, o_orderkey, CASE WHEN rn < 1000 THEN 'train' ELSE 'test' END AS part FROM {_ORN}")
def tts_train_size(spark, sf_dir):
    return _labelled_parts(_orders(spark, sf_dir).train_test_split(test_size=None, train_size=1000, shuffle=False), "o_orderkey")


@_register(
    """WITH l AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS rk, count(*) OVER (PARTITION BY quality) AS g, count(*) OVER () AS n FROM labels),
a AS (SELECT DISTINCT quality, g, CAST(floor(n * 0.25 + 0.5) AS BIGINT) AS t, n FROM l),
f AS (SELECT quality, g, g * t // n AS base, row_number() OVER (ORDER BY g * t % n DESC, quality) AS r, t - sum(g * t // n) OVER () AS more FROM a),
c AS (SELECT quality, g - (base + CASE WHEN r <= more THEN 1 ELSE 0 END) AS cut FROM f)
SELECT row_number() OVER (PARTITION BY rk >= cut ORDER BY quality, rk) - 1 AS pos, doc_id, quality, CASE WHEN rk < cut THEN 'train' ELSE 'test' END AS part FROM l JOIN c USING (quality)"""
)
def tts_stratified(spark, sf_dir):
    d = Dataset.from_frame(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _labelled_parts(d.train_test_split(stratify_by="quality", shuffle=False), "doc_id", "quality")


@_register(f"SELECT CAST(fold AS INTEGER) AS fold, doc_id, CASE WHEN rn >= fold * (n // 3) AND rn < (fold + 1) * (n // 3) THEN 'test' ELSE 'train' END AS part FROM {_RN}, (VALUES (0), (1), (2)) f(fold)")
def kfold_3(spark, sf_dir):
    folds, out = sampler.k_fold(_docs(spark, sf_dir, "doc_id"), 3, shuffle=False), None
    for i, fold in enumerate(folds):
        for part, d in fold.items():
            one = d.df.select(F.lit(i).alias("fold"), "doc_id", F.lit(part).alias("part"))
            out = one if out is None else out.unionAll(one)
    return out


@_register("SELECT CASE WHEN rn < cut THEN rn ELSE rn - cut END AS pos, doc_id, CASE WHEN rn < cut THEN 'train' ELSE 'test' END AS part FROM (SELECT *, n - CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS cut FROM " + _RN + ")")
def sampler_tts(spark, sf_dir):
    return _labelled_parts(sampler.train_test_split(_docs(spark, sf_dir, "doc_id"), shuffle=False), "doc_id")


@_register(
    """WITH s AS (SELECT lang, count(*) AS g, sum(count(*)) OVER () AS n FROM documents GROUP BY lang),
r AS (SELECT lang, CAST(floor(g / n * 97 + 0.5) AS BIGINT) AS share FROM s),
o AS (SELECT lang, share, sum(share) OVER () - 97 AS over_by, coalesce(sum(share) OVER (ORDER BY share DESC, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT lang, share - least(share, greatest(0, CAST(over_by - before AS BIGINT))) AS n_sampled FROM o WHERE share - least(share, greatest(0, CAST(over_by - before AS BIGINT))) > 0"""
)
def stratified_counts(spark, sf_dir):
    return sampler.stratified(_docs(spark, sf_dir, "doc_id", "lang"), 97, "lang", seed=1).df.groupBy("lang").agg(F.count("*").alias("n_sampled"))


@_register("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_distinct")
def random_sample_size(spark, sf_dir):
    return sampler.random(_docs(spark, sf_dir, "doc_id"), 100, seed=3).df.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@_register("SELECT doc_id, true AS moved FROM documents")
def sampler_shuffle(spark, sf_dir):
    """Every row once, and not in the order given."""
    made = sampler.shuffle(_docs(spark, sf_dir, "doc_id"), 5).with_position()
    ranked = made.join(_docs(spark, sf_dir, "doc_id").with_position().select("doc_id", F.col("pos").alias("rank")), "doc_id")
    return ranked.select("doc_id", F.lit(not ranked.where("pos != rank").isEmpty()).alias("moved"))


# -- vector search ----------------------------------------------------------------------------------------------------

_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)"
_V = "CAST(embedding AS DOUBLE[])"
#: Vectors scaled by their ids: on the plain ones, which have unit length, all metrics rank alike.
_SCALED = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 5))"


def _knn(spark, sf_dir, metric: str, scaled: bool = False) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    query = df.where("vec_id = 7").select("embedding").first()[0]
    if scaled:
        df = df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5)))
    top = search.top_k(df, "embedding", query, 10, metric, tie="vec_id")
    return top.select("vec_id", (F.round("score", 6) + 0.0).alias("score"))


@_register(f"SELECT vec_id, round(list_cosine_similarity({_V}, q), 6) + 0.0 AS score FROM embeddings, {_Q} ORDER BY list_cosine_similarity({_V}, q) DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@_register(f"SELECT vec_id, round(-pow(list_distance({_V}, q), 2), 6) + 0.0 AS score FROM embeddings, {_Q} ORDER BY list_distance({_V}, q), vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@_register(f"SELECT vec_id, round(list_inner_product({_V}, q), 6) + 0.0 AS score FROM embeddings, {_Q} ORDER BY list_inner_product({_V}, q) DESC, vec_id LIMIT 10")
def knn_inner_product(spark, sf_dir):
    return _knn(spark, sf_dir, "inner_product")


@_register(f"SELECT vec_id, round(list_inner_product(v, q), 6) + 0.0 AS score FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings), {_Q} ORDER BY list_inner_product(v, q) DESC, vec_id LIMIT 10")
def knn_inner_product_scaled(spark, sf_dir):
    return _knn(spark, sf_dir, "inner_product", scaled=True)


@_register(f"SELECT vec_id, round(-pow(list_distance(v, q), 2), 6) + 0.0 AS score FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings), {_Q} ORDER BY list_distance(v, q), vec_id LIMIT 10")
def knn_l2_scaled(spark, sf_dir):
    return _knn(spark, sf_dir, "l2", scaled=True)


@_register(f"SELECT vec_id, round(list_cosine_similarity({_V}, q), 6) + 0.0 AS score FROM embeddings, {_Q} ORDER BY list_cosine_similarity({_V}, q) DESC, vec_id LIMIT 5")
def index_nearest_examples(spark, sf_dir):
    d = Dataset.from_frame(_table(spark, sf_dir, "embeddings"), "vec_id").add_index("embedding")
    query = d.frame.where("vec_id = 7").select("embedding").first()[0]
    scores, rows = d.get_nearest_examples("embedding", query, 5)
    return spark.createDataFrame([(r["vec_id"], round(s, 6) + 0.0) for s, r in zip(scores, rows)], "vec_id long, score double")


# Many queries: every row whose id is divisible by 20, against all rows.


def _knn_many_sql(metric: str, scaled: bool = False, k: int = 10) -> str:
    score, order = {"cosine": ("list_cosine_similarity(e.v, q.v)", "DESC"), "l2": ("list_distance(e.v, q.v)", "ASC"), "inner_product": ("list_inner_product(e.v, q.v)", "DESC")}[metric]
    shown = f"-pow({score}, 2)" if metric == "l2" else score
    return f"""WITH e AS (SELECT vec_id, {_SCALED if scaled else _V} AS v FROM embeddings), q AS (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {order}, e.vec_id) AS rank, e.vec_id, round({shown}, 6) + 0.0 AS score FROM e, q) WHERE rank <= {k}"""


def _knn_many(spark, sf_dir, metric: str, scaled: bool = False) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    queries = df.where("vec_id % 20 = 0")
    if scaled:
        df = df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5)))
    top = search.top_k_many(df, "embedding", queries, "vec_id", "embedding", 10, metric, tie="vec_id")
    return top.select("query_id", "rank", "vec_id", (F.round("score", 6) + 0.0).alias("score"))


@_register(_knn_many_sql("cosine"))
def knn_many_cosine(spark, sf_dir):
    return _knn_many(spark, sf_dir, "cosine")


@_register(_knn_many_sql("l2"))
def knn_many_l2(spark, sf_dir):
    return _knn_many(spark, sf_dir, "l2")


@_register(_knn_many_sql("inner_product"))
def knn_many_inner_product(spark, sf_dir):
    return _knn_many(spark, sf_dir, "inner_product")


@_register(_knn_many_sql("inner_product", scaled=True))
def knn_many_inner_product_scaled(spark, sf_dir):
    return _knn_many(spark, sf_dir, "inner_product", scaled=True)


@_register(_knn_many_sql("l2", scaled=True))
def knn_many_l2_scaled(spark, sf_dir):
    return _knn_many(spark, sf_dir, "l2", scaled=True)


@_register(_knn_many_sql("cosine", k=5))
def index_nearest_many(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings")
    d = Dataset.from_frame(df, "vec_id").dense().add_index("embedding")
    found = d.indices["embedding"].search_many(df.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.join(d.frame.select(search.POS, "vec_id"), search.POS).select("query_id", "rank", "vec_id", (F.round("score", 6) + 0.0).alias("score"))


# -- conversations, answers, preferences ------------------------------------------------------------------------------


def _talks(spark, sf_dir) -> DataFrame:
    return conversations.assemble(_table(spark, sf_dir, "conversations"), "conv_id", "turn")


@_register("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id")
def conversation_assemble(spark, sf_dir):
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return _talks(spark, sf_dir).select("conv_id", F.size("messages").alias("n_messages"), F.array_join(line, "\n").alias("dialogue"))


@_register("SELECT conv_id, CAST(count(*) FILTER (role IN ('user', 'assistant')) // 2 AS INTEGER) AS turns, arg_max(text, turn) AS last_text, arg_min(text, turn) FILTER (role = 'system') AS system_text FROM conversations GROUP BY conv_id")
def conversation_facts(spark, sf_dir):
    m = F.col("messages")
    return _talks(spark, sf_dir).select("conv_id", conversations.turn_count(m).alias("turns"), conversations.last_message(m)["content"].alias("last_text"), conversations.system_prompt(m).alias("system_text"))


@_register("SELECT conv_id, turn, CASE r WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE r END AS role FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS r FROM conversations)")
def role_normalise(spark, sf_dir):
    given = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", conversations.role(given).alias("role"))


@_register("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user') GROUP BY conv_id")
def dialogue_text_round_trip(spark, sf_dir):
    """Dialogues written as text with speakers' marks, read back, and their user turns."""
    talks = _talks(spark, sf_dir).select("conv_id", F.filter("messages", lambda m: m["role"] != "system").alias("m"))
    text = F.array_join(F.transform("m", lambda m: F.concat(F.when(m["role"] == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), m["content"])), "")
    back = talks.select("conv_id", conversations.from_text(text).alias("c")).where(F.exists("c", lambda m: m["role"] == "user"))
    return back.select("conv_id", conversations.user_prompt(F.col("c")).alias("prompt"))


@_register("SELECT doc_id, CAST(CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score FROM labels")
def preference_score(spark, sf_dir):
    name = F.when(F.col("toxic") == 1, " Rejected").when(F.col("quality") == 1, "MODEL_A ").otherwise("tie")
    return _table(spark, sf_dir, "labels").select("doc_id", preference.label_score(name).alias("score"))


_ANSWER = "'She has <<' || (doc_id % 4) || '+2=5>> then ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '#### $' || doc_id || ',000.5' END"


@_register(
    f"SELECT doc_id, CASE WHEN contains(a, '####') THEN TRY_CAST(regexp_extract(trim(regexp_replace(split_part(a, '####', 2), '[,$]', '', 'g')), '^[+-]?\\d+(\\.\\d+)?') AS DOUBLE) END AS answer, CAST(len(string_split(a, '<<')) AS INTEGER) AS steps, 'easy' AS difficulty "
    f"FROM (SELECT doc_id, {_ANSWER} AS a FROM documents)"
)
def answer_extract(spark, sf_dir):
    a = F.col("a")
    df = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWER).alias("a"))
    return df.select("doc_id", answers.numerical_answer(a).alias("answer"), answers.count_steps(a).alias("steps"), answers.difficulty_of_steps(a).alias("difficulty"))


_BOXED = "CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN doc_id % 4 = 1 THEN 'so \\boxed{ \\frac{' || doc_id || '}{2} } and \\boxed{9}' ELSE '\\boxed{' || doc_id || '}' || CASE WHEN doc_id % 4 = 3 THEN ' #### 7 ' ELSE '' END END"


@_register(
    f"SELECT doc_id, nullif(trim(regexp_extract(s, '\\\\boxed\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)\\}}', 1)), '') AS boxed, CASE WHEN contains(s, '####') THEN trim(split_part(s, '####', 2)) ELSE nullif(trim(regexp_extract(s, '\\\\boxed\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)\\}}', 1)), '') END AS final "
    f"FROM (SELECT doc_id, {_BOXED} AS s FROM documents)"
)
def boxed_extract(spark, sf_dir):
    s = F.col("s")
    df = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_BOXED.replace("\\", "\\\\")).alias("s"))
    return df.select("doc_id", answers.boxed_answer(s).alias("boxed"), answers.final_answer(s).alias("final"))


@_register("SELECT 'gsm8k_' || rn AS id, 'Q' || doc_id AS question, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id || '000.5' AS DOUBLE) END AS answer FROM " + _RN)
def shape_grade_school(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id").map({"question": F.concat(F.lit("Q"), F.col("doc_id")), "answer": F.expr(_ANSWER)})
    made = shapes.grade_school_math(d.with_position())
    return made.select("id", F.col("input.question").alias("question"), F.col("expected.answer").alias("answer"))


@_register("SELECT 'helpsteer_' || rn AS id, CASE WHEN doc_id % 5 - 2 < 0 THEN 'a' ELSE 'b' END AS preferred FROM " + _RN + " WHERE doc_id % 5 <> 2")
def shape_preferences(spark, sf_dir):
    context = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")))
    d = _docs(spark, sf_dir, "doc_id", "lang").map({"context": context, "response1": F.lit("x"), "response2": F.lit("y"), "overall_preference": (F.col("doc_id") % 5 - 2).cast("int")})
    return shapes.preferences(d.with_position(), "helpsteer3").select("id", F.col("expected.preferred").alias("preferred"))


# -- files ------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that executors share, as a path; shared folders that are not mounted are refused."""
    base = shared_folder(spark)
    if not base.startswith(("file:/", "/")):
        raise ValueError("these queries write files with Python and need a mounted shared folder")
    path = "/" + base.removeprefix("file:").lstrip("/")
    os.makedirs(folder := f"{path}/sparkset-files-{uuid.uuid4().hex}")
    return folder


_ROUND_TRIP = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang, source, n_chars FROM documents"


def _facts(spark, sf_dir) -> Dataset:
    return _docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars")


@_register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.csv"
    sinks.to_csv(_docs(spark, sf_dir, "doc_id", "text"), path)
    return _numbered(formats.from_csv(spark, path), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


@_register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.jsonl"
    sinks.to_jsonl(_docs(spark, sf_dir, "doc_id", "text"), path)
    return _numbered(formats.from_json(spark, path), "doc_id", "text")


@_register(_ROUND_TRIP)
def json_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.json"
    sinks.to_json(_facts(spark, sf_dir), path)
    return _numbered(formats.from_json(spark, path), "doc_id", "lang", "source", "n_chars")


@_register(_ROUND_TRIP)
def parquet_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.parquet"
    sinks.to_parquet(_facts(spark, sf_dir), path, max_rows=300)
    return _numbered(formats.from_parquet(spark, path), "doc_id", "lang", "source", "n_chars")


@_register(_ROUND_TRIP)
def arrow_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.arrow"
    sinks.to_arrow(_facts(spark, sf_dir), path, compression="zstd", batch_rows=200)
    return _numbered(formats.from_arrow(spark, path), "doc_id", "lang", "source", "n_chars")


@_register("SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, line FROM (SELECT doc_id, i, trim(lines[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE line <> ''")
def text_lines(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.txt"
    sinks.to_text(_docs(spark, sf_dir, "doc_id", "text"), path)
    return _numbered(formats.from_text(spark, path, column="line"), "line")


@_register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang FROM documents")
def parquet_positions(spark, sf_dir):
    return _numbered(Dataset.from_parquet(spark, f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]), "doc_id", "lang")


@_register("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# -- lazy and streaming -----------------------------------------------------------------------------------------------


@_register("SELECT event_id, value * 2 AS twice FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY event_id LIMIT 500")
def iterable_filter_map_take(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kind = df.agg(F.min("event_type")).first()[0]
    lazy = IterableDataset.from_dataset(Dataset.from_frame(df, "event_id")).filter(F.col("event_type") == kind).map({"twice": F.col("value") * 2})
    return lazy.data.take(500).df.select("event_id", "twice")


@_register("SELECT event_id, value * 2 AS twice FROM events WHERE value > 10")
def stream_filter_map(spark, sf_dir):
    """Files as a stream, run until all that is there is read."""
    folder, batch = _scratch(spark), _table(spark, sf_dir, "events")
    stream = IterableDataset.read_files(spark, "parquet", f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/event[s].parquet", batch.schema)
    made = stream.filter(F.col("value") > 10).map({"twice": F.col("value") * 2})
    made = IterableDataset(stream=made.stream.select("event_id", "twice"))
    made.start("parquet", f"file://{folder}/state", f"file://{folder}/out").awaitTermination()
    return spark.read.schema("event_id long, twice double").parquet(f"file://{folder}/out")


@_register("SELECT doc_id, false AS too_early FROM documents")
def buffer_shuffle(spark, sf_dir):
    """Every row once, and none more than a buffer before its place."""
    d = _docs(spark, sf_dir, "doc_id")
    made = IterableDataset.from_dataset(d).shuffle_partitions(64, seed=9).data.with_position()
    placed = made.join(d.with_position().select("doc_id", F.col("pos").alias("rank")), "doc_id")
    return placed.select("doc_id", (F.col("rank") - F.col("pos") > 63).alias("too_early"))


# -- caches -----------------------------------------------------------------------------------------------------------


@_register("SELECT doc_id FROM documents WHERE n_chars % 3 = 0")
def filter_cached(spark, sf_dir):
    """A filter whose rows are written by the first run and read by the second."""
    cache, d = TableCache(spark, _scratch(spark)), _docs(spark, sf_dir, "doc_id", "n_chars")
    keep = F.col("n_chars") % 3 == 0
    d.filter(keep, cache=cache)
    return d.filter(keep, cache=cache).df.select("doc_id")


@_register("SELECT doc_id, 2 * n_chars AS twice FROM documents")
def map_cached_by_name(spark, sf_dir):
    """A map found by the fingerprint that its first run was given, whatever the function is now."""
    cache, d = TableCache(spark, _scratch(spark)), _docs(spark, sf_dir, "doc_id", "n_chars")
    d.map({"twice": F.col("n_chars") * 2}, cache=cache, new_fingerprint="twice")
    return d.map({"twice": F.lit(0)}, cache=cache, new_fingerprint="twice").df.select("doc_id", "twice")


@_register(_knn_many_sql("cosine"))
def index_add_many(spark, sf_dir):
    """An index of the rows with even ids, to which the others are added; every row whose id is divisible by 20 asks it."""
    df = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn(search.POS, F.col("vec_id").cast("long"))
    index = search.VectorIndex.build(df.where("vec_id % 2 = 0"), "embedding").add(df.where("vec_id % 2 = 1"), "embedding")
    found = index.search_many(df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "rank", F.col(search.POS).cast(df.schema["vec_id"].dataType).alias("vec_id"), (F.round("score", 6) + 0.0).alias("score"))


# -- catalogue --------------------------------------------------------------------------------------------------------


@_register("SELECT domain, CAST(n AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{d}', {n})" for d, n in registry.stats()["domain"].items()) + ") v(domain, n)")
def registry_stats(spark, sf_dir):
    return registry.as_frame(spark).groupBy("domain").agg(F.count("*").alias("n"))


@_register("SELECT n, test, CAST(shard AS BIGINT) AS shard FROM (VALUES " + ", ".join(f"({n}, {allocate.split_counts(n, 0.5)[1]}, {allocate.shard_bounds(n, 3, 0)[1]})" for n in range(1, 12)) + ") v(n, test, shard)")
def split_arithmetic(spark, sf_dir):
    """Closed forms of split and shard sizes, against the library's."""
    n = F.col("n")
    half = F.floor(n * 0.5 + 0.5).cast("int")
    return spark.range(1, 12).select(F.col("id").cast("int").alias("n")).select("n", half.alias("test"), (F.floor(n / 3) + F.when(n % 3 > 0, 1).otherwise(0)).cast("long").alias("shard"))


