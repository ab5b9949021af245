"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes only have to be told apart to the depth of the string length L (200 bytes). The suffix at a position
starts in the bucket of its q-gram, and a bucket is refined by the identifiers that its suffixes have at later
offsets: the identifier of 2q bytes at i comes from those of q bytes at i and at i + q, and so on, each round
reusing the identifiers that the round before has updated. An identifier is a 64-bit name made from the two
before it, so tasks agree on it without ranking all suffixes; it takes the place of the bucket's pointer.

Buckets with one suffix are finished early, at three depths. Each window of L bytes falls to the smallest q-gram
identifier in it, so equal windows fall to equal identifiers, at the same distance; consecutive windows with the
same one form a segment. (1) Segments are grouped by that first bucket; one that is alone is finished. (2) Segments with
the same bytes are settled at once. Of each content, one segment goes on if its bucket also holds others: its windows are
cut into blocks by their distance from the q-gram, and a block is grouped by the bytes that all its windows
share; one that is alone is finished, and blocks with the same bytes are settled. (3) Only the windows of the
other blocks are grouped one by one, by the bytes at both ends of their block.
"""

from __future__ import annotations


from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkset.llm.shared import keep, map_arrow, own_column, read_texts, release, slices

LENGTH = 200
#: Bytes of a text handled at once.
CHUNK = 1 << 21
#: Windows in a block.
BLOCK = 32

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x += b * _K2
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def _byte_names() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _K1
    return _mix(x, x ^ _K2)


_NAMES = _byte_names()


def bucket_names(data: np.ndarray, length: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(width, identifiers of the ``width`` bytes that start at each position), from the q-gram (q = length / 8) to ``length``."""
    q = length // 8
    names, width, levels = _NAMES[data], 1, []
    for goal in (q, length):
        while width < goal:
            step = min(width, goal - width)
            names, width = _mix(names[:-step], names[step:]), width + step
            if width >= q:
                levels.append((width, names))
    return levels or [(1, names)]


def _name_of(levels: list[tuple[int, np.ndarray]], at: np.ndarray, width: int) -> np.ndarray:
    """Names of the ``width`` bytes at the given positions, from two names of the widest level that fits."""
    w, names = max((x for x in levels if x[0] <= width), key=lambda x: x[0])
    return _mix(names[at], names[at + width - w])


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = best(x[:-step], x[step:]), done + step
    return x


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of one stretch of bytes: first bucket, name of the content, and where it lies, packed."""
    levels = bucket_names(data, length)
    (q, grams), whole = levels[0], levels[-1][1]
    width = length - q + 1
    least = _sliding(grams, width, np.minimum)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    counts = np.diff(np.concatenate((starts, [len(least)])))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    holders = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)  # q-grams that are smallest in some window
    recur = np.concatenate(([False], (grams[holders[1:]] == grams[holders[:-1]]) & (np.diff(holders) <= width)))
    run = np.cumsum(~recur) - 1  # each run of windows has one smallest q-gram, or one that recurs
    tied = np.zeros(len(starts), bool)
    tied[run[recur]] = True
    distances = holders[~recur] - starts
    if counts.max() > width:  # cut runs into segments as long as one q-gram can hold
        pieces = -(-counts // width)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, counts, tied, distances = (np.repeat(x, pieces) for x in (starts, counts, tied, distances))
        starts, counts = starts + nth * width, np.minimum(counts - nth * width, width)
    distances = np.where(tied, 0, distances)  # not asked for: their windows stand alone
    content = _mix(whole[starts], whole[starts + counts - 1]) + counts.astype(np.uint64)
    return least[starts], content, _packed(starts, distances, counts, tied)


def _stretches(n: int, length: int, chunk: int) -> Iterator[tuple[int, int]]:
    """Windows of n bytes in chunks: each chunk has the bytes of its windows."""
    for at in range(0, n - length + 1, chunk):
        yield at, min(n, at + chunk + length - 1)


def _packed(starts, distances, counts, tied) -> np.ndarray:
    """First window, distance from it to the q-gram, number of windows, and whether windows in the segment may be equal."""
    return ((starts.astype(np.int64) << 9 | distances) << 9 | counts) << 1 | tied


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 19, at >> 10 & 511, at >> 1 & 511


def _find_segments(length: int, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = []
            size = 0
            for key, key2, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                for a, b in _stretches(len(data), length, chunk):
                    bucket, content, at = segments(data[a:b], length)
                    n = len(at)
                    out.append([bucket, content, np.full(n, key), np.full(n, key2), at + (a << 19)])
                    size += n
                if size > 200_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts)]
    columns[:2] = [x.view(np.int64) for x in columns[:2]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["bucket", "content", "k1", "k2", "at"])


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the numbers first, first + 1, ..., as many as counted; and the item of each."""
    item = np.repeat(np.arange(len(counts)), counts)
    return first[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts), item


def _deal_blocks(length: int, block: int, chunk: int):
    """The blocks of the segments that are refined: rows of BLOCKS."""
    core = length - block + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            for row in range(batch.num_rows):
                k1, k2, packed, spots = (batch.column(i)[row].as_py() for i in range(4))
                text = unpack(packed)
                data = np.frombuffer(text, np.uint8)
                spots = np.array([(s["at"], s["bucket"], s["tied"]) for s in spots], np.int64).reshape(-1, 3)
                starts, distances, counts = _unpacked(spots[:, 0])
                for a, b in _stretches(len(data), length, chunk):
                    near = (starts >= a) & (starts < a + chunk)
                    if not near.any():
                        continue
                    levels = bucket_names(data[a:b], length)
                    whole = levels[-1][1]
                    single, several = near & (spots[:, 2] > 0), near & (spots[:, 2] == 0)
                    # windows of buckets with ties stand alone
                    at, item = _spread(starts[single], counts[single])
                    zero = np.zeros(len(at), np.int64)
                    yield _blocks(spots[single, 1][item], zero - 1, whole[at - a], whole[at - a], k1, k2, at, zero, zero, [b""] * len(at), [b""] * len(at))
                    gram, high = (starts + distances)[several], distances[several]
                    low = high - counts[several] + 1
                    nth, item = _spread(low // block, high // block - low // block + 1)
                    gram, low, high = gram[item], np.maximum(low[item], nth * block), np.minimum(high[item], nth * block + block - 1)
                    first, last, inner = gram - high, gram - low, gram - nth * block
                    names = _name_of(levels, inner - a, core)
                    ends = _mix(whole[first - a], whole[last - a]) + (high - low).astype(np.uint64)
                    left = [text[x:y] for x, y in zip(first.tolist(), inner.tolist())]
                    right = [text[x:y] for x, y in zip((inner + core).tolist(), (last + length).tolist())]
                    yield _blocks(spots[several, 1][item], nth * block, names, ends, k1, k2, gram, high, low, left, right)

    return run


#: first bucket; least distance of a block's windows from the q-gram; name of the bytes they all have; name of all bytes; row;
#: where the q-gram is; largest and least distance of those that there are; bytes before and after the common ones.
BLOCKS = "bucket long, block int, core long, full long, k1 long, k2 int, gram long, high int, low int, left binary, right binary"


def _blocks(bucket, block, core, full, k1, k2, gram, high, low, left, right) -> pa.RecordBatch:
    n, short = len(gram), lambda x: pa.array(x.astype(np.int32))
    columns = [pa.array(bucket), short(block), pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(np.full(n, k1, np.int64)), pa.array(np.full(n, k2, np.int32)), pa.array(gram), short(high), short(low), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])


def _pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed: they cross the network twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        packed = pa.array([pack(x.as_py() or b"") for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, *batch.columns[3:]], names=batch.schema.names)


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open runs; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[first], ends[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(ends) - 1]))]


def _cut(id_col: str, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            sizes, removed, spans, left = [], [], [], []
            for packed, covered in zip(batch.column(1), batch.column(2)):
                data = unpack(packed.as_py())
                sizes.append(len(data))
                if not covered.is_valid:
                    removed.append(0)
                    spans.append([])
                    left.append(data)
                    continue
                both = np.array(covered.as_py(), np.int64)
                a, b = _runs(both >> 9, (both >> 9) + (both & 511) - 1 + length)
                edges = np.concatenate(([0], np.stack((a, b), 1).ravel(), [len(data)])).tolist()
                removed.append(int((b - a).sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                left.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere in the texts.

    Returns ``id_col``, ``n_bytes``, ``n_removed``, ``spans`` (array of the maximal removed runs: start and end
    byte) and ``kept`` (binary: the other bytes, which may no longer be UTF-8) of each row. Strings are judged on
    the input, overlapping ones count, and none crosses rows. Null texts count as empty; repeated rows repeat
    each other and lose their common strings; null ids are carried along; other columns are not read.
    ``length`` must be from 8 to 511. ``chunk`` is how many windows of a text are handled at once; results don't depend on it.
    """
    if not 8 <= length <= 511:
        raise ValueError("length must be from 8 to 511")
    kind = documents.schema[id_col].dataType
    long_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) if isinstance(kind, IntegralType) else F.xxhash64(id_col)
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    # rows are told apart by id and content, so that ids that occur twice do no harm
    row_id = own_column(documents.select(id_col), "row_id")
    source = documents.select(long_id.alias("k1"), F.hash(text).alias("k2"), text.alias("bytes"), F.col(id_col).alias(row_id))
    keys, tied = ["k1", "k2"], F.max(F.col("at").bitwiseAND(F.lit(1))).alias("tied")
    run_of = lambda first, count: (first * 512 + count).alias("run")
    segment = keep(map_arrow(source.where(F.octet_length("bytes") >= length).select(*keys, "bytes"), _find_segments(length, chunk), "bucket long, content long, k1 long, k2 int, at long"))

    open_bucket = keep(segment.groupBy("bucket").agg(F.count("*").alias("n"), tied).where("n > 1 or tied = 1").select("bucket"))
    shared = keep(segment.join(open_bucket, "bucket"))
    release(segment)
    content = keep(shared.groupBy("bucket", "content").agg(F.count("*").alias("n"), F.min(F.struct(*keys, "at")).alias("one"), tied))
    settled = shared.join(content.where("n > 1").select("bucket", "content"), ["bucket", "content"])
    settled = keep(settled.select(*keys, run_of(F.expr("at div 524288"), F.expr("at div 2 % 512"))))
    release(shared)

    mixed = keep(content.groupBy("bucket").agg(F.count("*").alias("n"), F.max("tied").alias("tied")).where("n > 1 or tied = 1").select("bucket", "tied"))
    spots = content.select("bucket", "one").join(mixed, "bucket").groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.at", "bucket", "tied")).alias("spots"))
    packed = source.select(*keys, "bytes", row_id)
    packed = map_arrow(packed, _pack_texts, packed.schema)
    block = keep(map_arrow(packed.select(*keys, "bytes").join(spots, keys), _deal_blocks(length, max(1, min(BLOCK, length // 8)), chunk), BLOCKS))
    release(content)
    same = ["bucket", "block", "core"]
    met = keep(block.groupBy(*same).agg(F.count("*").alias("n"), (F.min("full") == F.max("full")).alias("alike")).where("n > 1").select(*same, "alike"))
    met_block = keep(block.join(met, same))
    release(block)
    alike = met_block.where("alike").select(*keys, run_of(F.col("gram") - F.col("high"), F.col("high") - F.col("low") + 1))

    # a window takes from the left end as many bytes as its distance exceeds the block's least, and the rest from the right
    window = met_block.where("not alike").select(*same, *keys, "gram", "left", "right", F.explode(F.sequence("low", "high")).alias("distance"))
    before = F.col("distance") - F.col("block")
    after = max(1, min(BLOCK, length // 8)) - 1 - before
    ends = F.concat(F.substring("left", F.octet_length("left") - before + 1, before), F.substring("right", F.lit(1), after))
    window = keep(window.select(*same, "distance", F.xxhash64(ends).alias("ends"), *keys, (F.col("gram") - F.col("distance")).alias("first")))
    equal = keep(window.groupBy(*same, "distance", "ends").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    found = window.join(equal, [*same, "distance", "ends"]).select(*keys, run_of(F.col("first"), F.lit(1)))

    covered = keep(settled.unionAll(alike).unionAll(found).groupBy(*keys).agg(F.collect_list("run").alias("covered")))
    for table in (settled, met_block, window):
        release(table)
    out = packed.join(covered, keys, "left").select(F.col(row_id).alias(id_col), "bytes", "covered")
    return map_arrow(out, _cut(id_col, length), f"`{id_col}` {kind.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op8_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    """Digest of what remains of all documents."""
    return remove_repeats(read_texts(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + {LENGTH - 1}]) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
m AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM r UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, max(octet_length(b)) FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id),
k AS (SELECT p.doc_id, string_agg(CASE WHEN y >= x THEN hex(b[x:y]) ELSE '' END, '' ORDER BY x) AS h FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
n AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
