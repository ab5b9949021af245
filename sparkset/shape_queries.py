"""More registered queries: row access, samples that record themselves, containers, formats, row shapes and scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sparkset.catalog_queries import _RN, _by_lang, _docs, _facts, _numbered, _register, _scratch, _table, _talks
from sparkset.functions import answers, cast, preference, shapes
from sparkset.functions import conversations as cv
from sparkset.functions import features as ft
from sparkset.operators import sampler
from sparkset.operators.dataset import Dataset
from sparkset.operators.splits import SplitDict
from sparkset.sources import builder, formats, hub, loader, sinks
from sparkset.streaming.iterable import IterableDataset

# -- rows and containers ----------------------------------------------------------------------------------------------


@_register(f"SELECT CASE WHEN rn = 3 THEN 'new' ELSE lang END AS lang, doc_id FROM {_RN} WHERE rn <> n - 1")
def row_update_and_pop(spark, sf_dir):
    _, rest = _docs(spark, sf_dir, "doc_id", "lang").update(3, {"lang": "new"}).pop(-1)
    return rest.df


@_register(f"SELECT rn AS i, doc_id FROM {_RN} WHERE rn IN (0, 4) UNION ALL SELECT -1, doc_id FROM {_RN} WHERE rn = n - 1")
def row_access(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id")
    return spark.createDataFrame([(i, d[i]["doc_id"]) for i in (0, 4, -1)], "i long, doc_id long")


@_register(f"SELECT rn - 2 AS pos, doc_id FROM {_RN} WHERE rn BETWEEN 2 AND 11")
def sampler_skip_take(spark, sf_dir):
    return _numbered(sampler.take(sampler.skip(_docs(spark, sf_dir, "doc_id"), 2), 10), "doc_id")


@_register("SELECT doc_id FROM documents WHERE n_chars > 5000")
def sampler_filter(spark, sf_dir):
    return sampler.filter(_docs(spark, sf_dir, "doc_id", "n_chars"), F.col("n_chars") > 5000).select(["doc_id"]).df


@_register("SELECT lang AS split, count(*) AS n_rows FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') AND doc_id % 2 = 0 GROUP BY lang")
def dict_filter_rename(spark, sf_dir):
    d = _by_lang(spark, sf_dir).filter(F.col("doc_id") % 2 == 0).rename_split("en", "english").rename_split("english", "en").rename_split("absent", "x")
    return d.map(lambda x: x.select(["doc_id"])).counted()


@_register("SELECT lang AS split, count(*) AS n_rows FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang")
def dict_write_read(spark, sf_dir):
    path = f"file://{_scratch(spark)}/splits"
    _by_lang(spark, sf_dir).delete("en").delete("es").write(path)
    return SplitDict.read(spark, path).counted()


@_register("SELECT batch, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents) GROUP BY batch")
def iterate_batches(spark, sf_dir):
    """Formatted batches, pulled by the driver."""
    d = _docs(spark, sf_dir, "doc_id").set_format("numpy")
    rows = [(i, len(b["doc_id"]), int(b["doc_id"].sum())) for i, b in enumerate(d.iter(64))]
    return spark.createDataFrame(rows, "batch long, n long, ids long")


@_register("SELECT i, i * i AS square FROM (SELECT unnest(range(0, 100)) AS i)")
def generator_rows(spark, sf_dir):
    return Dataset.from_generator(spark, lambda: ({"i": i, "square": i * i} for i in range(100))).df


@_register("SELECT i FROM (SELECT unnest(range(1, 40, 2)) AS i)")
def lazy_generator(spark, sf_dir):
    lazy = IterableDataset.from_generator(lambda: ({"i": i} for i in range(10**9))).filter(lambda r: r["i"] % 2 == 1)
    return spark.createDataFrame(lazy.take(20), "i long")


# -- files ------------------------------------------------------------------------------------------------------------


@_register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def tsv_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/documents.tsv"
    sinks.to_csv(_facts(spark, sf_dir), path, delimiter="\t")
    return _numbered(formats.parse(spark, path), "doc_id", "lang", "source", "n_chars")


@_register("SELECT doc_id, lang, source, n_chars FROM documents")
def sharded_jsonl(spark, sf_dir):
    path = f"file://{_scratch(spark)}/documents"
    sinks.to_jsonl(_facts(spark, sf_dir), path, sharded=True)
    return formats.parse(spark, path, "jsonl").df.select("doc_id", "lang", "source", "n_chars")


@_register("SELECT row_number() OVER (ORDER BY part, doc_id) - 1 AS pos, doc_id FROM (SELECT 0 AS part, doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id FROM documents WHERE lang = 'fr')")
def mixed_files(spark, sf_dir):
    """A JSON lines file and a Parquet folder as one dataset."""
    d, folder = _docs(spark, sf_dir, "doc_id", "lang"), _scratch(spark)
    sinks.to_jsonl(d.filter(F.col("lang") == "de").select(["doc_id"]), f"{folder}/a.jsonl")
    sinks.to_parquet(d.filter(F.col("lang") == "fr").select(["doc_id"]), f"file://{folder}/b.parquet")
    return _numbered(formats.parse(spark, [f"{folder}/a.jsonl", f"file://{folder}/b.parquet"]), "doc_id")


@_register("SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows FROM documents GROUP BY ALL")
def repository_splits(spark, sf_dir):
    """Files of a repository, resolved to splits by their names."""
    d, folder = _docs(spark, sf_dir, "doc_id"), _scratch(spark)
    os.makedirs(f"{folder}/data")
    for name, test in (("train", F.col("doc_id") % 4 != 0), ("test", F.col("doc_id") % 4 == 0)):
        sinks.to_jsonl(d.filter(test), f"{folder}/data/{name}-00000.jsonl")
    return loader.load_dataset(spark, folder).counted()


@_register("SELECT 'gsm8k_' || rn AS id, CAST(doc_id AS DOUBLE) AS answer FROM " + _RN)
def load_by_name_and_config(spark, sf_dir):
    """A catalogued dataset: of a repository with several configurations, the one that the catalogue names."""
    d, folder = _docs(spark, sf_dir, "doc_id"), _scratch(spark)
    for config, shift in (("default", 1), ("main", 0), ("zebra", 2)):
        os.makedirs(f"{folder}/openai/gsm8k/{config}")
        rows = d.map({"question": F.lit("q"), "answer": F.concat(F.lit("#### "), (F.col("doc_id") + shift).cast("string"))}).select(["question", "answer"])
        sinks.to_jsonl(rows, f"{folder}/openai/gsm8k/{config}/train.jsonl")
    made = loader.load(spark, "gsm8k", hub.HubSource(hub.FolderClient(folder), f"{folder}/cache"))
    return made.with_position().select("id", F.col("expected.answer").alias("answer"))


@_register("SELECT doc_id, lang FROM documents")
def hub_round_trip(spark, sf_dir):
    """Shards pushed to a hub in a folder, and loaded from it."""
    folder = _scratch(spark)
    client = hub.FolderClient(f"{folder}/hub")
    hub.push(_docs(spark, sf_dir, "doc_id", "lang"), "me/documents", client, max_shard_bytes=10_000)
    return loader.load_dataset(spark, "me/documents", split="train", source=hub.HubSource(client, f"{folder}/cache")).df


class _Halves(builder.DatasetBuilder):
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def info(self):
        return builder.DatasetInfo(description="even and odd nations")

    def split_generators(self, downloads, config):
        return [builder.SplitGenerator(n, {"rest": r}) for n, r in (("even", 0), ("odd", 1))]

    def generate_examples(self, spark, options):
        return _table(spark, self.sf_dir, "nation").where(F.col("n_nationkey") % 2 == options["rest"]).select("n_nationkey", "n_name")


@_register("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS split, count(*) AS n_rows FROM nation GROUP BY ALL")
def builder_splits(spark, sf_dir):
    return builder.build(spark, _Halves(sf_dir)).counted()


# -- features and scalars ---------------------------------------------------------------------------------------------


@_register("SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS name, quality AS code FROM labels")
def class_label_codes(spark, sf_dir):
    label = ft.ClassLabel(names=["low", "high"])
    df = _table(spark, sf_dir, "labels").select("doc_id", F.get(F.array(*map(F.lit, label.names)), F.col("quality")).alias("name"))
    return df.select("doc_id", "name", cast.cast_column_expr(F.col("name"), df.schema["name"].dataType, label).alias("code"))


@_register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id + n_chars END AS total FROM documents")
def cast_sequence(spark, sf_dir):
    """Lists of digits as lists of whole numbers; a list with a word in it does not fit."""
    df = _table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "word").otherwise(F.col("n_chars").cast("string"))).alias("x"))
    made = Dataset.from_frame(df, "doc_id").cast_column("x", ft.Sequence(ft.int64), errors="null").df
    return made.select("doc_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@_register("SELECT doc_id, doc_id % 2 = 0 AS ok, CASE WHEN doc_id % 2 = 0 THEN lang END AS en FROM documents")
def translation_pairs(spark, sf_dir):
    """Parallel lists of languages and texts, checked and read as maps."""
    two, one = F.array(F.lit("en"), F.lit("de")), F.array("lang")
    pair = F.struct(two.alias("languages"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(one).alias("translation"))
    df = _table(spark, sf_dir, "documents").select("doc_id", pair.alias("t"))
    ok = cast.valid(F.col("t"), df.schema["t"].dataType, ft.TranslationVariableLanguages())
    return df.select("doc_id", ok.alias("ok"), F.when(ok, F.try_element_at(F.map_from_arrays(F.col("t.languages"), F.when(ok, F.col("t.translation"))), F.lit("en"))).alias("en"))


@_register("SELECT i, CAST(c AS INTEGER) AS choice FROM (VALUES (0, 0), (1, 3), (2, 2), (3, 0), (4, 0)) v(i, c)")
def choice_codes(spark, sf_dir):
    df = spark.sql("SELECT * FROM VALUES (0, 'A'), (1, 'D'), (2, '2'), (3, 'none'), (4, NULL) AS v(i, a)")
    return df.select("i", answers.choice_index(F.col("a")).alias("choice"))


@_register("SELECT doc_id, CASE WHEN len(text) < 100 THEN 'easy' WHEN len(text) < 300 THEN 'medium' ELSE 'hard' END AS difficulty, len(text) > 100 AS is_long FROM documents")
def code_difficulty(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", answers.code_difficulty(t).alias("difficulty"), answers.has_long_reasoning(t).alias("is_long"))


# -- row shapes -------------------------------------------------------------------------------------------------------


@_register("SELECT 'chat_' || (row_number() OVER (ORDER BY conv_id) - 1) AS id, CAST(count(*) FILTER (role IN ('user', 'assistant')) // 2 AS INTEGER) AS turns FROM conversations GROUP BY conv_id")
def shape_chats(spark, sf_dir):
    d = Dataset.from_frame(_talks(spark, sf_dir), "conv_id")
    return shapes.chats(d.with_position()).select("id", F.col("metadata.turn_count").alias("turns"))


@_register("SELECT 'open_thoughts_' || (row_number() OVER (ORDER BY conv_id) - 1) AS id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS prompt, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS reasoning FROM conversations GROUP BY conv_id")
def shape_reasoning(spark, sf_dir):
    said = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    d = Dataset.from_frame(_talks(spark, sf_dir).select("conv_id", said.alias("conversations")), "conv_id")
    return shapes.reasoning(d.with_position()).select("id", F.col("input.prompt").alias("prompt"), F.col("expected.reasoning").alias("reasoning"))


@_register("SELECT 'mmlu_' || source || '_test_' || rn AS id, lang AS first_choice, CAST(doc_id % 4 AS INTEGER) AS expected FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents WHERE source IN ('src1', 'src2'))")
def shape_multiple_choice(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "source", "lang").filter(F.col("source").isin("src1", "src2"))
    d = d.map({"subject": F.col("source"), "question": F.lit("?"), "choices": F.array("lang", "source"), "answer": F.get(F.array(*map(F.lit, "ABCD")), (F.col("doc_id") % 4).cast("int"))})
    return shapes.multiple_choice(d.with_position()).select("id", F.col("input.choices")[0].alias("first_choice"), "expected")


@_register("SELECT 'humaneval_' || rn AS id, CAST(doc_id AS VARCHAR) AS task_id, '\"\"\"Doc ' || lang AS description FROM " + _RN)
def shape_function_synthesis(spark, sf_dir):
    prompt = F.concat(F.lit('def f():\n  """Doc '), F.col("lang"), F.lit("\n  pass"))
    d = _docs(spark, sf_dir, "doc_id", "lang").map({"prompt": prompt, "canonical_solution": F.lit("x"), "task_id": F.col("doc_id").cast("string")})
    return shapes.function_synthesis(d.with_position()).select("id", F.col("metadata.task_id").alias("task_id"), F.col("input.description").alias("description"))


@_register("SELECT 'math500_' || rn AS id, CAST(n_chars AS VARCHAR) AS expected, source AS type FROM " + _RN)
def shape_competition_math(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "n_chars", "source").map({"problem": F.lit("p"), "solution": F.concat(F.lit("so \\boxed{"), F.col("n_chars"), F.lit("}")), "subject": F.col("source")})
    return shapes.competition_math(d.with_position()).select("id", "expected", F.col("metadata.type").alias("type"))


@_register("SELECT 'feedback_' || rn AS id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_scores FROM " + _RN)
def shape_rubrics(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id").map({"instruction": F.lit("i"), "criteria": F.lit("c"), "score1_description": F.lit("bad"), "orig_score5_description": F.when(F.col("doc_id") % 2 == 0, "good")})
    return shapes.rubrics(d.with_position()).select("id", F.size("expected.rubric").alias("n_scores"))


@_register("SELECT 'deepcoder_' || rn AS id, text AS problem, 'python' AS language FROM " + _RN)
def shape_code_tasks(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text").rename_column("text", "prompt")
    return shapes.code_tasks(d.with_position()).select("id", F.col("input.problem").alias("problem"), F.col("input.language").alias("language"))


@_register("SELECT 'caltech101_' || rn AS id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, lang AS expected FROM " + _RN)
def shape_images(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text", "lang").map({"image": F.encode("text", "UTF-8"), "label": F.col("lang")})
    return shapes.images(d.with_position(), "caltech101").select("id", F.octet_length("input.image.bytes").alias("n_bytes"), "expected")


@_register("SELECT 'documents_' || rn AS id, text AS input, lang AS expected FROM " + _RN)
def shape_local(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text", "lang").rename_column("lang", "label")
    return shapes.local(d.with_position(), "documents").select("id", "input", "expected")


@_register("SELECT conv_id, arg_max(text, (len(text), -turn)) AS best, arg_min(text, (len(text), -turn)) AS worst FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def ranked_responses(spark, sf_dir):
    """The longest and the shortest turn of each conversation, as responses scored by length."""
    turn = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("model"), F.col("text").alias("response"), F.char_length("text").alias("score"))))
    df = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn.alias("r"))
    c = preference.from_ranked(F.lit("p"), F.col("r"))
    return df.select("conv_id", c.alias("c")).where("c is not null").select("conv_id", F.col("c.response_a").alias("best"), F.col("c.response_b").alias("worst"))


@_register("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS typed FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def typed_contents(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), "text")))
    df = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return df.where(F.exists("p", lambda x: x["type"] == "text")).select("conv_id", cv.typed_text(F.col("p")).alias("typed"))
