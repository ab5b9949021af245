"""Line deduplication by winnowing over line hashes.

Lines with a word are hashed by their words. A window starts at a line and ends as soon as it holds ``min_words`` words;
the rightmost smallest hash in it is a fingerprint. Two runs of equal lines with that many words begin with
equal windows and so share a fingerprint, whatever stands around them.

Fingerprints are joined on their hash. Around each one that occurs twice, the match is extended to both sides by all
windows that hold it: those that start at each line before it, and those that end at each line after it. A run that is
repeated is the union of such windows, and a window is a later repeat if the same lines stand earlier, in
the order of ids and then lines. So no two rows are compared with each other, however many hold a passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import keep, let, map_arrow, own_column, read_texts, release, slices

MIN_WORDS = 50


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last number, word count and hash of each line that has a word; those without one after it count to it."""
    at, counts, hashes = [], [], []
    lines = (text or "").encode().split(b"\n")
    for i, line in enumerate(lines):
        if words := line.split():
            at.append(i)
            counts.append(len(words))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
    spans = np.array([at, [*(i - 1 for i in at[1:]), len(lines) - 1][: len(at)]], np.int64)
    return spans, np.array(counts, np.int64), np.array(hashes, np.uint64)


def windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the windows that start at a line, and of those that end at a line."""
    upto = np.concatenate(([0], np.cumsum(counts)))
    starts = np.flatnonzero(upto[-1] - upto[:-1] >= min_words)
    ends = np.searchsorted(upto, upto[starts] + min_words) - 1
    return starts, ends


def winnow(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that are fingerprints, and first and last line of all windows."""
    starts, ends = windows(counts, min_words)
    if not len(starts):
        return starts, starts, ends
    prints = sorted({b - int(np.argmin(hashes[a : b + 1][::-1])) for a, b in zip(starts.tolist(), ends.tolist())})
    back_ends, back_starts = (len(counts) - 1 - x for x in windows(counts[::-1], min_words))
    both = np.unique(np.stack((np.concatenate((starts, back_starts)), np.concatenate((ends, back_ends))), 1), axis=0)
    return np.array(prints), both[:, 0], both[:, 1]


def _find_prints(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            out: list[tuple] = []
            for key, key2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                (begin, end), counts, hashes = line_hashes(text.as_py())
                prints, first, last = winnow(hashes, counts, min_words)
                names = np.array([xxhash.xxh64_intdigest(hashes[a : b + 1].tobytes()) for a, b in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
                # windows are in order of both ends: those that hold a line are neighbours
                for p, low, high in zip(prints.tolist(), np.searchsorted(last, prints).tolist(), np.searchsorted(first, prints, "right").tolist()):
                    around = [{"name": n, "first": a, "last": b} for n, a, b in zip(names[low:high].tolist(), begin[first[low:high]].tolist(), end[last[low:high]].tolist())]
                    out.append((int(hashes[p].view(np.int64)), key, key2, around))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.types[0]), pa.array(columns[2], pa.int64()), pa.array(columns[3], kind)], names=["print", "k1", "k2", "around"])

    return run


def _merge_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the runs of each row."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        out = []
        for runs in batch.column(2).to_pylist():
            merged: list[dict] = []
            for r in sorted(runs, key=lambda r: r["first"]):
                if merged and r["first"] <= merged[-1]["last"] + 1:
                    merged[-1]["last"] = max(merged[-1]["last"], r["last"])
                else:
                    merged.append(dict(r))
            out.append(merged)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], names=batch.schema.names)


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def repeated_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``k1`` (the id), ``k2`` (a hash of the text) and ``runs`` (first and last line of each later repeated run) of rows that have one."""
    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k1"), _row_key(F.col(text_col)).alias("k2"), F.col(text_col).cast("string").alias("text"))
    prints = keep(map_arrow(source, _find_prints(min_words), f"print long, k1 {kind}, k2 long, around array<struct<name:long,first:long,last:long>>"))
    shared = keep(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    window = keep(prints.join(shared, "print").select("k1", "k2", F.explode("around").alias("w")).select("w.name", "k1", "k2", "w.first", "w.last").distinct())
    release(prints)
    earliest = keep(window.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("e")).where("n > 1").select("name", "e"))
    later = window.join(earliest, "name").where(F.struct("k1", "k2", "first") != F.col("e"))
    runs = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    found = keep(map_arrow(runs, _merge_runs, runs.schema))
    release(window)
    return found


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with later repeated runs of lines deleted from the text, and the columns ``n_lines`` and ``n_removed``.

    A run is consecutive lines with ``min_words`` words together; lines without a word neither count nor part a run, and
    share the lot of the line before them. Lines are equal if their words are. What stands first, by id, stays. Null texts
    stay null, and a text that is one repeated run becomes empty; rows with a null id are left as they are, and rows
    with the same id and text are treated alike. A column named like a new one is replaced.
    """
    carried = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    a, b, found = (own_column(documents, n) for n in ("k1_", "k2_", "runs_"))
    runs = repeated_runs(documents.select(id_col, text_col), id_col, text_col, min_words)
    # the runs grow with the documents: always a merge join, whatever their size is here
    runs = runs.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("runs").alias(found)).hint("merge")
    df = documents.select(*[F.col(f"`{c}`") for c in carried])
    df = df.join(runs, (F.col(f"`{id_col}`") == F.col(a)) & (_row_key(F.col(f"`{text_col}`")) == F.col(b)), "left")
    text = F.col(f"`{text_col}`").cast("string")
    left = let(F.col(found), lambda r: F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.exists(r, lambda x: i.between(x["first"], x["last"]))), "\n"))
    lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
    removed = F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1), F.lit(0).cast("long"))
    return df.select(*[F.when(F.col(found).isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in carried], lines.alias("n_lines"), removed.alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs."""
    return dedup_lines(read_texts(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    return rf"""
WITH l AS (SELECT doc_id, i - 1 AS n, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
u AS (SELECT doc_id, n, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
r AS (SELECT doc_id, n, len(w) AS c, array_to_string(w, ' ') AS s, row_number() OVER o AS k, sum(len(w)) OVER o AS upto FROM u WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
p AS (SELECT a.doc_id, a.k AS a, b.k AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.c >= {MIN_WORDS}),
w AS (SELECT doc_id, a, min(b) AS b FROM p GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM p GROUP BY doc_id, b),
named AS (SELECT w.doc_id, a, b, string_agg(s, chr(10) ORDER BY k) AS name FROM w JOIN r ON r.doc_id = w.doc_id AND k BETWEEN a AND b GROUP BY w.doc_id, a, b),
later AS (SELECT doc_id, a, b FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT r.doc_id, k FROM later JOIN r ON r.doc_id = later.doc_id AND k BETWEEN a AND b),
state AS (SELECT l.doc_id, l.n, l.line, max(r.k) OVER (PARTITION BY l.doc_id ORDER BY l.n) AS k FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.n = r.n),
marked AS (SELECT state.*, gone.k IS NOT NULL AS removed FROM state LEFT JOIN gone ON state.doc_id = gone.doc_id AND state.k = gone.k),
made AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT removed), '') AS text, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, made.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN made ON d.doc_id = made.doc_id"""


ORACLE = _oracle()
