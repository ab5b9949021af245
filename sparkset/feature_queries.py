"""Queries of types, formats, fingerprints, indexes, hubs and lazy pipelines, with the SQL that gives the same rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sparkset import session
from sparkset.catalog_queries import _RN, _docs, _knn_many_sql, _register, _scratch, _table
from sparkset.functions import features as ft
from sparkset.operators import search
from sparkset.operators.dataset import Dataset
from sparkset.sources import formats, hub, loader, sinks
from sparkset.streaming.iterable import IterableDataset


def _nations(spark, sf_dir) -> Dataset:
    return Dataset.from_frame(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", name="nations")


# -- lazy pipelines ---------------------------------------------------------------------------------------------------


@_register("SELECT doc_id, 'doc ' || lang AS name FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE n_chars % 2 = 1) WHERE k > 3")
def lazy_python_steps(spark, sf_dir):
    """Python functions of a lazy dataset's rows, on the executors."""
    lazy = IterableDataset.from_dataset(_docs(spark, sf_dir, "doc_id", "lang", "n_chars"))
    made = lazy.filter(lambda r: r["n_chars"] % 2 == 1).map(lambda r: {"doc_id": r["doc_id"], "name": None if r["lang"] is None else "doc " + r["lang"]}, schema="doc_id long, name string")
    return made.skip(3).to_dataset().df.select("doc_id", "name")


@_register("SELECT CAST((rn - rn % 7) // 7 AS BIGINT) AS batch, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM " + _RN + " GROUP BY 1")
def lazy_batches(spark, sf_dir):
    batches = IterableDataset.from_dataset(_docs(spark, sf_dir, "doc_id")).batch(7)
    return spark.createDataFrame([(i, len(b), min(r["doc_id"] for r in b)) for i, b in enumerate(batches)], "batch long, n long, first_id long")


@_register("SELECT n_nationkey AS k, 10 * n_regionkey AS r, 'seen' AS note FROM nation WHERE n_regionkey <> 2")
def lazy_to_dataset(spark, sf_dir):
    lazy = IterableDataset(make=lambda rows=_nations(spark, sf_dir).to_list(): rows).with_info(note="seen")
    kept = lazy.filter(lambda r: r["n_regionkey"] != 2).map(lambda r: {"k": r["n_nationkey"], "r": 10 * r["n_regionkey"], "note": lazy.info["note"]})
    return kept.to_dataset(spark, "k long, r long, note string").df


# -- rows and formats -------------------------------------------------------------------------------------------------


@_register("SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1) AS there, false AS other, false AS fewer_columns")
def row_membership(spark, sf_dir):
    d = _nations(spark, sf_dir)
    asked = [{"n_nationkey": 3, "n_regionkey": 1}, {"n_nationkey": 3, "n_regionkey": 99}, {"n_nationkey": 3}]
    return spark.createDataFrame([tuple(row in d for row in asked)], "there boolean, other boolean, fewer_columns boolean")


@_register("SELECT n_nationkey, n_regionkey FROM nation")
def columns_as_lists(spark, sf_dir):
    lists = _nations(spark, sf_dir).to_dict()
    return spark.createDataFrame(list(zip(lists["n_nationkey"], lists["n_regionkey"])), "n_nationkey long, n_regionkey long")


@_register(" UNION ALL ".join(f"SELECT '{name}' AS format, CAST(sum(n_nationkey) AS BIGINT) AS total, count(*) AS n FROM nation" for name in ("rows", "pandas", "arrow", "custom")))
def formatted_batches(spark, sf_dir):
    """The same rows as dicts, pandas frames, Arrow tables and by a function."""
    d, out = _nations(spark, sf_dir), []
    takers = {"rows": lambda b: [r["n_nationkey"] for r in b], "pandas": lambda b: b["n_nationkey"].tolist(), "arrow": lambda b: b.column("n_nationkey").to_pylist(), "custom": lambda b: b}
    for name, take in takers.items():
        options = {"transform": lambda rows: [r["n_nationkey"] for r in rows], "batched": True} if name == "custom" else {}
        keys = [int(k) for b in d.with_format(name, **options).iter(4) for k in take(b)]
        out.append((name, sum(keys), len(keys)))
    return spark.createDataFrame(out, "format string, total long, n long")


@_register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'base64:' || base64(encode(lang) || '\\xFF'::BLOB) END AS raw FROM documents")
def bytes_in_json_lines(spark, sf_dir):
    """Bytes are written as text, or as base64 where they are not UTF-8."""
    path = f"{_scratch(spark)}/bytes.jsonl"
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("lang", "UTF-8")).otherwise(F.concat(F.encode("lang", "UTF-8"), F.lit(bytearray(b"\\xff".decode("unicode_escape").encode("latin-1")))))
    sinks.to_jsonl(_docs(spark, sf_dir, "doc_id", "lang").map({"raw": raw}).select(["doc_id", "raw"]), path)
    return formats.from_json(spark, path).df.select("doc_id", "raw")


# -- types ------------------------------------------------------------------------------------------------------------


@_register("SELECT doc_id, hex(encode(lang)) AS bytes FROM documents")
def cast_to_binary(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang").cast_column("lang", ft.binary).df.select("doc_id", F.hex("lang").alias("bytes"))


@_register("""SELECT * FROM (VALUES ('int8', 'tinyint', 'int8'), ('int16', 'smallint', 'int16'), ('int32', 'int', 'int32'), ('int64', 'bigint', 'int64'), ('uint8', 'smallint', 'uint8'),
('uint16', 'int', 'uint16'), ('uint32', 'bigint', 'uint32'), ('uint64', 'decimal(20,0)', 'uint64'), ('float16', 'float', 'float16'), ('float32', 'float', 'float32'), ('float64', 'double', 'float64'),
('bool', 'boolean', 'bool'), ('string', 'string', 'object'), ('binary', 'binary', 'object')) v(dtype, spark_type, numpy_type)""")
def value_types(spark, sf_dir):
    return spark.createDataFrame([(x, ft.Value(x).spark_type().simpleString(), str(ft.Value(x).numpy_dtype())) for x in ft.DTYPES], "dtype string, spark_type string, numpy_type string")


@_register("SELECT * FROM (VALUES ('n_nationkey', 'int64'), ('n_regionkey', 'int64'), ('name', 'string'), ('score', 'float64')) v(name, dtype)")
def inferred_types(spark, sf_dir):
    row = _nations(spark, sf_dir).to_list()[0] | {"name": "x"}
    inferred = ft.Features.infer(row).put("score", ft.float64)
    return spark.createDataFrame([(k, inferred[k].dtype) for k in inferred.column_names], "name string, dtype string")


# -- identity and settings --------------------------------------------------------------------------------------------


@_register("SELECT true AS same_plan, true AS other_filter, true AS other_order, true AS other_table")
def fingerprints_differ(spark, sf_dir):
    small = lambda n=5: _nations(spark, sf_dir).filter(F.col("n_nationkey") < n)
    one, others = small().fingerprint, [small(6).fingerprint, small().sort("n_regionkey").fingerprint, _docs(spark, sf_dir, "doc_id").fingerprint]
    return spark.createDataFrame([(one == small().fingerprint, *(one != x for x in others))], "same_plan boolean, other_filter boolean, other_order boolean, other_table boolean")


@_register("SELECT false AS by_default, true AS switched_on, false AS offline")
def settings(spark, sf_dir):
    """Caching by default, switched on, and switched on but offline."""
    names, out = [session.PREFIX + "cache.enabled", session.PREFIX + "offline"], []
    for values in ((), ("true",), ("true", "true")):
        for name, value in zip(names, values):
            spark.conf.set(name, value)
        out.append(session.caching_enabled(spark))
    for name in names:
        spark.conf.unset(name)
    return spark.createDataFrame([tuple(out)], "by_default boolean, switched_on boolean, offline boolean")


# -- indexes and hubs -------------------------------------------------------------------------------------------------


@_register(_knn_many_sql("cosine", k=5))
def index_saved_and_loaded(spark, sf_dir):
    df, path = _table(spark, sf_dir, "embeddings"), f"{session.shared_folder(spark)}/sparkset-index-{os.urandom(8).hex()}"
    d = Dataset.from_frame(df, "vec_id").dense().add_index("embedding")
    d.save_index("embedding", path)
    loaded = d.drop_index("embedding").load_index("embedding", path)
    found = loaded.indices["embedding"].search_many(df.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.join(d.frame.select(search.POS, "vec_id"), search.POS).select("query_id", "rank", "vec_id", (F.round("score", 6) + 0.0).alias("score"))


@_register("SELECT * FROM (VALUES ('README.md'), ('second/test/data-00000-of-00001.parquet')) v(path)")
def hub_deletes_a_configuration(spark, sf_dir):
    client, d = hub.FolderClient(f"{_scratch(spark)}/hub"), _nations(spark, sf_dir)
    hub.push(d, "me/nations", client, config="first")
    hub.push(d, "me/nations", client, config="second", split="test")
    hub.delete("me/nations", client, "first")
    return spark.createDataFrame([(p,) for p in client.list_files("me/nations")], "path string")


@_register("SELECT 'gsm8k_' || rn AS id, split FROM " + _RN + ", (VALUES ('train'), ('test')) s(split) WHERE rn < 4")
def sampled_splits_by_name(spark, sf_dir):
    """A catalogued dataset, two splits of it, the first rows of each."""
    folder = _scratch(spark)
    os.makedirs(f"{folder}/openai/gsm8k/main")
    rows = _docs(spark, sf_dir, "doc_id").map({"question": F.lit("q"), "answer": F.lit("#### 1")}).select(["question", "answer"])
    for split in ("train", "test"):
        sinks.to_jsonl(rows, f"{folder}/openai/gsm8k/main/{split}.jsonl")
    source = hub.HubSource(hub.FolderClient(folder), f"{folder}/cache")
    parts = [loader.load(spark, "gsm8k", source, split, sample_size=4).df.select("id", F.lit(split).alias("split")) for split in ("train", "test")]
    return parts[0].unionAll(parts[1])
