"""Benchmark decontamination: a BM25 index of test items, asked by every passage of the training texts.

The index holds the test items; a passage is the query, and BM25 adds up the impacts that its distinct terms have in
an item. The threshold of an item is the least score that a passage has which verifies it: its score for its own text, less
the largest impacts of as many terms as the shingles that may be missing can hide. Items are stored
in blocks, and items that need alike scores share a block. Of each term the index has a posting list of blocks, with its largest impact in each.

As in block-max WAND, lists are walked only where they can matter, for all passages of a stretch of text at once. The terms with the longest lists, which are
the common ones of small impact, are taken at their largest impact anywhere at first; the lists of the others are walked and their block
maxima added up. Where that reaches what an item of the block needs, the block is a pivot: there the long lists are looked up too, and if the block maxima
still add up, the items of the block are scored. All other blocks are skipped. Nothing above the threshold is lost.

Passages overlap by half and are at least twice as long as the longest item, so an item stands in some passage whole.
Retrieved items are verified: the passage must hold the item's question and its answer (its last sentence), each
by the share of its five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import map_arrow, read_table, read_texts, slices

K1, B = 1.2, 0.75
#: Share of shingles that verifies a question or an answer.
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
PASSAGE = 96
#: Bounds of passages and blocks that are added up at once.
AT_ONCE = 100_000
#: Bytes of items that are broadcast at once; more items are asked in several passes.
MOST_BYTES = 16_000_000

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, without ASCII punctuation."""
    return (text or "").encode().lower().translate(None, _PUNCTUATION).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words up to its last sentence, and those of its last sentence; an item of one sentence is all question."""
    body = text.strip()
    cut = max(body.rfind(". ", 0, len(body) - 1), body.rfind("\n", 0, len(body) - 1), body.rfind("? ", 0, len(body) - 1))
    question, answer = (terms_of(body[: cut + 1]), terms_of(body[cut + 1 :])) if cut >= 0 else (terms_of(body), [])
    return (question, answer) if question else (answer, [])


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def most_missing(part: list[bytes]) -> int:
    """Terms of a part that can be absent from a passage that verifies it.

    A word is absent only if all shingles that hold it are. Runs of missing shingles hide no more words than they are,
    and if a shingle occurs twice, no more than two terms for each.
    """
    distinct = len(shingles(part))
    missing = int((1 - OVERLAP) * distinct + 1e-9) if len(part) >= SHINGLE else 0
    return missing if distinct == max(1, len(part) - SHINGLE + 1) else 2 * missing


class Index:
    """Inverted index of items. ``frequency`` and ``statistics`` describe all items, of which this index may hold a part."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[bytes, int], n_items: int, mean_length: float):
        self.ids = [i for i, _ in items]
        texts = [terms_of(t) for _, t in items]
        parts = [question_and_answer(t) for _, t in items]
        self.parts = [(shingles(q), shingles(a)) for q, a in parts]
        self.term: dict[bytes, int] = {}
        rows: list[tuple[int, int, float]] = []
        for item, words in enumerate(texts):
            for w in sorted(set(words)):
                tf, df = words.count(w), frequency[w]
                idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
                rows.append((self.term.setdefault(w, len(self.term)), item, impact))
        n_terms, n = len(self.term), len(items)
        t, item, impact = (np.array(x) for x in zip(*rows)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        by_item = np.searchsorted(item, np.arange(n + 1))  # rows are in order of items
        needed = np.full(n, np.inf)
        for i in range(n):
            if texts[i]:
                own = np.sort(impact[by_item[i] : by_item[i + 1]])
                needed[i] = own[: max(0, len(own) - sum(map(most_missing, parts[i])))].sum() - 1e-9
        # items that need alike scores share a block
        self.blocks = max(1, -(-n // BLOCK))
        place = np.empty(n, np.int64)
        place[np.argsort(needed, kind="stable")] = np.arange(n)
        self.at = np.argsort(place)
        self.needed = np.full(self.blocks * BLOCK, np.inf)
        self.needed[place] = needed
        self.block_needed = self.needed.reshape(self.blocks, BLOCK).min(1) - 1e-4
        block = place[item] // BLOCK if n else item
        order = np.argsort(block * (n_terms + 1) + t, kind="stable")
        self.key, self.place, self.impact = (block * (n_terms + 1) + t)[order], (place[item] % BLOCK if n else item)[order], impact[order]
        # posting lists: blocks of each term, and its largest impact in each
        self.n_terms = n_terms
        order = np.argsort(t * self.blocks + block, kind="stable")
        listed = (t * self.blocks + block)[order]
        first = np.flatnonzero(np.concatenate(([True], listed[1:] != listed[:-1]))) if len(listed) else np.empty(0, np.int64)
        self.list_block = listed[first] % self.blocks
        self.list_max = np.maximum.reduceat(impact[order], first) if len(first) else np.empty(0)
        self.list_at = np.searchsorted(listed[first], np.arange(n_terms + 1) * self.blocks)
        self.list_size = np.diff(self.list_at)
        long = np.flatnonzero(2 * self.list_size > self.blocks)
        self.term_max = np.maximum.reduceat(self.list_max, self.list_at[:-1]) if n_terms else np.empty(0)
        self.long_row = np.full(n_terms, -1)
        self.long_row[long] = np.arange(len(long))
        self.long_max = np.zeros((len(long), self.blocks))  # at most twice as large as the lists
        if len(long):
            own, row = spread(self.list_at[long], self.list_size[long])
            self.long_max[row, self.list_block[own]] = self.list_max[own]
        self.half = max(PASSAGE // 2, *map(len, texts), 1) if texts else PASSAGE // 2
        self.stretch = max(16, AT_ONCE // self.blocks)

    def retrieve(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Items of a block that a passage with these distinct terms reaches, and their scores."""
        keys = block * (self.n_terms + 1) + terms
        low = np.searchsorted(self.key, keys)
        postings, _ = spread(low, np.searchsorted(self.key, keys, "right") - low)
        score = np.bincount(self.place[postings], self.impact[postings], minlength=BLOCK)
        return [(int(self.at[block * BLOCK + i]), float(score[i])) for i in np.flatnonzero(score >= self.needed[block * BLOCK :][:BLOCK])]

    def alive(self, ids: np.ndarray) -> np.ndarray:
        """(passage, block) of the blocks whose maxima reach what the block needs. A passage is two halves; a term counts once in it."""
        half = np.arange(len(ids)) // self.half
        passages = max(1, int(half[-1]))
        known = ids < self.n_terms
        first, second = known & (half < passages), known & (half > 0)
        codes = np.concatenate((half[first] * self.n_terms + ids[first], (half[second] - 1) * self.n_terms + ids[second]))
        passage, term = np.divmod(np.unique(codes), max(1, self.n_terms))
        row = self.long_row[term]
        short, long = row < 0, row >= 0
        postings, of = spread(self.list_at[term[short]], self.list_size[term[short]])
        bound = np.bincount(passage[short][of] * self.blocks + self.list_block[postings], self.list_max[postings], minlength=passages * self.blocks)
        most = np.bincount(passage[long], self.term_max[term[long]], minlength=passages)
        pivots = np.flatnonzero((bound.reshape(passages, self.blocks) + most[:, None] >= self.block_needed).ravel())
        if not len(pivots):
            return np.empty((0, 2), np.int64)
        # there the long lists are looked up
        row, at = row[long], np.searchsorted(passage[long], np.arange(passages + 1))
        where, block = np.divmod(pivots, self.blocks)
        probed, of = spread(at[where], at[where + 1] - at[where])
        exact = bound[pivots] + np.bincount(of, self.long_max[row[probed], block[of]], minlength=len(pivots))
        return np.stack((where, block), 1)[exact >= self.block_needed[block]]

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Verified items of a text: item to score, share of the question and share of the answer, of its best passage."""
        words, found = terms_of(text), {}
        if not words or not self.ids:
            return found
        ids = np.fromiter(map(self.term.get, words, repeat(self.n_terms)), np.int64, len(words))
        # stretches of whole passages: of each, the last half begins the next
        for begin in range(0, max(1, len(ids) - self.half), self.stretch * self.half):
            for passage, block in self.alive(ids[begin : begin + (self.stretch + 1) * self.half]).tolist():
                at = slice(begin + passage * self.half, begin + (passage + 2) * self.half)
                for item, score in self.retrieve(np.unique(ids[at]), block):
                    here, (question, answer) = words[at], self.parts[item]
                    held = shingles_in(here)
                    q, a = share(question, held, here), share(answer, held, here)
                    if q >= OVERLAP and a >= OVERLAP and (item not in found or (q + a, score) > (sum(found[item][1:]), found[item][0])):
                        found[item] = (score, q, a)
        return found


def spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the numbers first, first + 1, ..., as many as counted; and the item of each."""
    item = np.repeat(np.arange(len(counts)), counts)
    return first[item] + np.arange(len(item)) - (np.cumsum(counts) - counts)[item], item


def shingles_in(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def share(wanted: set[tuple[bytes, ...]], here: set[tuple[bytes, ...]], words: list[bytes]) -> float:
    """Share of a part's shingles that a passage holds; a part under five words must stand in it as it is. No part: all."""
    if not wanted:
        return 1.0
    if len(wanted) == 1 and len(only := next(iter(wanted))) < SHINGLE:
        return float(any(tuple(words[i : i + len(only)]) == only for i in range(len(words) - len(only) + 1)))
    return len(wanted & here) / len(wanted)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of parts of the items, each under ``MOST_BYTES``; statistics are over all items."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // MOST_BYTES + 1
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        texts = [(r["item"], r["text"]) for r in own]
        if parts == 1:
            counted: dict[bytes, int] = {}
            lengths = []
            for _, t in texts:
                w = terms_of(t)
                lengths.append(len(w))
                for x in set(w):
                    counted[x] = counted.get(x, 0) + 1
            yield Index(texts, counted, len(texts), max(1.0, sum(lengths) / max(1, len(lengths))))
            continue
        clean = F.split(F.trim(F.translate(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _PUNCTUATION.decode(), "")), r"[\x20\x09-\x0D]+")
        term = items.select("item", F.explode(F.array_distinct(clean)).alias("term"))
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).select(F.explode(clean).alias("term")).distinct()
        df = {r["term"].encode(): r["n"] for r in term.join(mine, "term").groupBy("term").agg(F.count("*").alias("n")).collect()}
        total, mean = items.agg(F.count("*"), F.avg(F.size(clean))).first()
        yield Index(texts, {w: df.get(w, 1) for _, t in texts for w in terms_of(t)}, total, max(1.0, mean))


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item that it holds: ``id_col``, ``item_col``, ``score``, ``question_overlap``, ``answer_overlap``.

    Whole texts are read, in one pass over the documents for each ``MOST_BYTES`` of items. Null and empty texts and items match nothing; repeated
    rows give repeated matches, and null ids are carried along. Other columns are not read.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source, out = documents.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), None
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                rows = [(d, index.ids[i], *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for i, m in sorted(index.matches(t.as_py()).items())]
                if rows:
                    docs, ids, *values = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.types[0]), pa.array(ids), *[pa.array(v, pa.float64()) for v in values]], names=["doc", "item", "score", "question_overlap", "answer_overlap"])

        found = map_arrow(source, run, f"doc {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", "question_overlap", "answer_overlap")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text holds no test item; all columns stay. Rows are judged one by one, whatever their ids."""
    at = documents.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        documents = map_arrow(documents, run, documents.schema)
    return documents


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Test items found in all documents; figures to six digits."""
    found = contaminated(read_texts(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def _oracle() -> str:
    quoted = _PUNCTUATION.decode().replace("'", "''")
    terms = lambda c: f"list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{quoted}', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return rf"""
WITH i AS (SELECT item_id, trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body, {terms("coalesce(text, '')")} AS w FROM benchmark),
c AS (SELECT *, substr(body, 1, greatest(len(body) - 1, 0)) AS head FROM i),
qa AS (SELECT item_id, CASE WHEN regexp_matches(head, '(?s)(\. |\? |\n)') THEN regexp_extract(head, '(?s)^(.*)(?:\. |\? |\n)', 1) END AS g, body FROM c),
part AS (SELECT item_id, {terms("coalesce(g, body)")} AS q, {terms("CASE WHEN g IS NULL THEN '' ELSE substr(body, len(g) + 2) END")} AS a FROM qa),
half AS (SELECT item_id, 'q' AS kind, CASE WHEN len(q) > 0 THEN q ELSE a END AS w FROM part UNION ALL SELECT item_id, 'a', CASE WHEN len(q) > 0 THEN a ELSE [] END FROM part),
ps AS (SELECT DISTINCT item_id, kind, l, array_to_string(w[j:j + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS j FROM (SELECT *, least({SHINGLE}, len(w)) AS l FROM half WHERE len(w) > 0))),
pn AS (SELECT item_id, kind, count(*) AS n FROM ps GROUP BY ALL),
stats AS (SELECT count(*) AS items, greatest(1, avg(len(w))) AS mean, greatest({PASSAGE // 2}, max(len(w))) AS half FROM i),
it AS (SELECT item_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT item_id, len(w) AS n, unnest(w) AS t FROM i) GROUP BY ALL),
impact AS (SELECT item_id, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / mean)) AS v FROM it JOIN (SELECT t, count(*) AS df FROM it GROUP BY t) USING (t), stats),
d AS (SELECT doc_id, {terms("coalesce(text, '')")} AS w, half FROM documents, stats),
p AS (SELECT doc_id, k, w[k * half + 1:(k + 2) * half] AS w FROM (SELECT *, unnest(range(0, greatest(1, (len(w) + half - 1) // half - 1))) AS k FROM d WHERE len(w) > 0)),
pg AS (SELECT DISTINCT doc_id, k, l, array_to_string(w[j:j + l - 1], ' ') AS s FROM (SELECT doc_id, k, w, l, unnest(range(1, len(w) - l + 2)) AS j FROM p, (SELECT DISTINCT l FROM ps))),
m AS (SELECT doc_id, k, item_id, kind, count(*) AS n FROM pg JOIN ps USING (l, s) GROUP BY ALL),
share AS (SELECT doc_id, k, m.item_id, m.kind, m.n / pn.n AS share FROM m JOIN pn ON m.item_id = pn.item_id AND m.kind = pn.kind),
ok AS (SELECT q.doc_id, q.k, q.item_id, q.share AS q, CASE WHEN pn.n IS NULL THEN 1.0 ELSE coalesce(a.share, 0) END AS a FROM share q LEFT JOIN pn ON pn.item_id = q.item_id AND pn.kind = 'a'
       LEFT JOIN share a ON a.doc_id = q.doc_id AND a.k = q.k AND a.item_id = q.item_id AND a.kind = 'a' WHERE q.kind = 'q' AND q.share >= {OVERLAP}),
scored AS (SELECT ok.doc_id, ok.k, ok.item_id, any_value(q) AS q, any_value(a) AS a, sum(v) AS score FROM ok JOIN (SELECT DISTINCT doc_id, k, unnest(w) AS t FROM p) t ON ok.doc_id = t.doc_id AND ok.k = t.k JOIN impact ON impact.item_id = ok.item_id AND impact.t = t.t WHERE a >= {OVERLAP} GROUP BY ALL)
SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY q + a DESC, score DESC, k) = 1"""


ORACLE = _oracle()
