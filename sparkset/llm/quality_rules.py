"""Quality rules whose limits follow each language and source.

Every measure of a document is a whole number and falls into a bucket of a log-linear histogram (relative width
1/32). The histogram is a quantile sketch that merges by adding counts: sketches of (language, source) add up to
those of languages, and these to that of the corpus. Limits come from the quartiles of the finest sketch with enough
documents and are joined to the documents to filter them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkset.llm.shared import WORD_BREAK, keep, read_texts, words

#: Words in a window that may repeat within a text.
WINDOW = 5
#: Documents a sketch needs before its own limits hold.
ENOUGH = 50
#: A limit lies this many interquartile ranges beyond the quartile, and at least the slack of its measure.
RANGES = 3
#: Measures and their slack: symbols and repeated lines per 1000 words; capitals per 1000 characters; hundredths of a
#: character per word (limited on both sides). Words in repeated windows are left to the base rule.
SLACK = {"symbols": 100, "lines": 100, "capitals": 150, "length": 150}


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The id, the group columns and the counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [id_col, *groups]
    df = documents.select(*carried, text.alias("text_"), words(F.col(text_col)).alias("words_"))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = lambda i, k: F.get("words_", i + k)
    n = F.size("words_")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    df = df.select(
        *carried,
        n.cast("long").alias("n_words"),
        (F.char_length("text_") - F.regexp_count("text_", F.lit(WORD_BREAK[:-1]))).cast("long").alias("word_chars"),
        F.regexp_count("text_", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text_", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("lines_"),
        grams.alias("grams_"),
    )
    counted = [c for c in df.columns if c not in ("lines_", "grams_")]
    # only texts with a repeated window are sorted, to bring equal windows side by side
    ordered = F.when(F.size(F.array_distinct("grams_")) < F.size("grams_"), F.sort_array(F.transform("grams_", lambda x, i: F.struct(x.alias("g"), i.alias("i")))))
    df = df.select(*counted, (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), ordered.alias("ordered_"))
    twins = F.filter("ordered_", lambda e, j: (e["g"] == F.get("ordered_", j - 1)["g"]).eqNullSafe(True) | (e["g"] == F.get("ordered_", j + 1)["g"]).eqNullSafe(True))
    df = df.select(*counted, "n_dup_lines", F.array_sort(F.transform(twins, lambda e: e["i"])).alias("spots_"))
    covered = F.transform("spots_", lambda x, j: F.least(F.coalesce(F.get("spots_", j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*counted, "n_dup_lines", F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    per = lambda top, bottom, times: F.expr(f"{times} * {top} div greatest({bottom}, 1)")
    return {
        "symbols": per("n_symbols", "n_words", 1000),
        "lines": per("n_dup_lines", "n_words", 1000),
        "capitals": per("n_capitals", "word_chars", 1000),
        "length": per("word_chars", "n_words", 100),
    }


def sketch_bucket(value: Column) -> Column:
    """Bucket of a whole number from 0: itself below 64, then 32 buckets for each doubling."""
    shift = F.char_length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function("shiftright", value, shift)).cast("long")


def bucket_value(bucket: Column) -> Column:
    """Smallest number in a bucket."""
    shift = F.floor(bucket / 32).cast("int") - 1
    return F.when(bucket < 64, bucket).otherwise(F.call_function("shiftleft", bucket - shift * 32, shift)).cast("long")


def limits(measured_rows: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Limits of each group: columns low_<measure> and high_<measure>, from the sketches of documents that pass the base rules."""
    good = measured_rows.where(~base_failed())
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), sketch_bucket(v).alias("bucket")) for k, v in measures().items()]))
    sketch = keep(good.select(*groups, pairs.alias("p")).groupBy(*groups, "p.measure", "p.bucket").agg(F.count("*").alias("n")))
    found = None
    for level in range(len(groups), -1, -1):
        by = [f"g{i}" for i in range(level)] + ["measure"]
        merged = sketch.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups[:level])], "measure", "bucket", "n").groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
        total = F.sum("n").over(Window.partitionBy(*by))
        ranked = merged.select(*by, "bucket", so_far.alias("upto"), total.alias("total"))
        quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), bucket_value(F.col("bucket"))))  # noqa: B023, E731
        table = ranked.groupBy(*by).agg(F.first("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
        spread = RANGES * (F.col("q3") - F.col("q1")) + F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("measure")]
        table = table.where(F.col("total") >= ENOUGH if level else F.lit(True))
        pick = lambda k, side: F.max(F.when(F.col("measure") == k, side))
        columns = [c for k in SLACK for c in (pick(k, F.col("q1") - spread).alias(f"low{level}_{k}"), pick(k, F.col("q3") + spread).alias(f"high{level}_{k}"))]
        table = table.groupBy(*by[:-1]).agg(*columns)
        if found is None:
            found = sketch.select(*groups).distinct()
        on = [found[g].eqNullSafe(table[f"g{i}"]) for i, g in enumerate(groups[:level])]
        if level:
            found = found.join(table, on, "left").drop(*by[:-1])
        else:  # the corpus has one row
            corpus = table.first()
            found = found.select("*", *[F.lit(corpus[c] if corpus else None).cast("long").alias(c) for c in table.columns])
    names = [f"{side}_{k}" for k in SLACK for side in ("low", "high")]
    finest = lambda name: F.coalesce(*[F.col(name.replace("_", f"{level}_", 1)) for level in range(len(groups), -1, -1)])
    return found.select(*groups, *[finest(x).alias(x) for x in names])


def apply_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The id, the counts of ``measured``, ``base_failed`` and ``kept`` of each row.

    A row that fails a base rule is not kept; any other is kept unless a measure lies beyond its group's limit. Null texts
    have no words and fail; null languages and sources are groups like others; repeated rows stay; null ids are carried along.
    Other columns are not read.
    """
    rows = keep(measured(documents, id_col, text_col, groups))
    table = keep(limits(rows, groups))
    names = [f"limit_{i}" for i in range(len(groups))]
    table = table.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], *table.columns[len(groups) :])
    joined = rows.join(table, [rows[g].eqNullSafe(table[n]) for g, n in zip(groups, names)], "left")
    within = F.lit(True)
    for k, v in measures().items():
        within &= (v <= F.col(f"high_{k}")) & ((v >= F.col(f"low_{k}")) if k == "length" else F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(id_col, *counts, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(True))).alias("kept"))


def filter_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``documents`` that the rules keep, all columns; rows that share an id stay if one of them is kept, those without an id go."""
    kept = apply_rules(documents.select(id_col, text_col, *groups), id_col, text_col, groups).where("kept").select(id_col).distinct()
    return documents.join(kept.hint("merge"), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    return apply_rules(read_texts(spark, sf_dir, "documents"))


def _oracle() -> str:
    per = {"symbols": "1000 * n_symbols // greatest(n_words, 1)", "lines": "1000 * n_dup_lines // greatest(n_words, 1)", "capitals": "1000 * n_capitals // greatest(word_chars, 1)", "length": "100 * word_chars // greatest(n_words, 1)"}
    union = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {v} AS v, {SLACK[k]} AS slack FROM good" for k, v in per.items())
    bucket = "CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END"
    value = "CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 32 - 1) * 32) << (bucket // 32 - 1) END"
    levels = []
    for level, cols in ((2, "lang, source, "), (1, "lang, NULL AS source, "), (0, "NULL AS lang, NULL AS source, ")):
        by = {2: "lang, source, ", 1: "lang, ", 0: ""}[level]
        levels.append(f"""SELECT {level} AS level, {cols}measure, any_value(total) AS total, any_value(slack) AS slack,
            min(CASE WHEN 4 * upto >= total THEN {value} END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN {value} END) AS q3
          FROM (SELECT {by}measure, bucket, slack, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total
                FROM (SELECT {by}measure, bucket, slack, count(*) AS n FROM sketch GROUP BY {by}measure, bucket, slack)) GROUP BY {by}measure""")
    beyond = " OR ".join(f"(t.measure = '{k}' AND ({per[k]} > t.high{f' OR {per[k]} < t.low' if k == 'length' else ''}))" for k in per)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM t) GROUP BY r),
m AS (SELECT doc_id, lang, source, w.r, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN c ON w.r = c.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed),
sketch AS (SELECT lang, source, measure, slack, {bucket} AS bucket FROM ({union})),
levels AS (SELECT *, q1 - {RANGES} * (q3 - q1) - slack AS low, q3 + {RANGES} * (q3 - q1) + slack AS high FROM ({" UNION ALL ".join(levels)}) WHERE total >= {ENOUGH} OR level = 0),
fit AS (SELECT good.r, max(t.level) AS level, t.measure FROM good JOIN levels t
        ON (t.level = 0 OR good.lang IS NOT DISTINCT FROM t.lang) AND (t.level < 2 OR good.source IS NOT DISTINCT FROM t.source) GROUP BY good.r, t.measure),
bad AS (SELECT DISTINCT good.r FROM good JOIN fit ON good.r = fit.r JOIN levels t ON t.level = fit.level AND t.measure = fit.measure
        AND (t.level = 0 OR good.lang IS NOT DISTINCT FROM t.lang) AND (t.level < 2 OR good.source IS NOT DISTINCT FROM t.source) WHERE {beyond})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad ON b.r = bad.r"""


ORACLE = _oracle()
