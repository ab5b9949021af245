"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Give each bit position i a non-zero vector m(i) of radius + 1 bits; for each non-zero
vector v, table v keeps the positions with odd <m(i), v>. The m(i) of at most ``radius`` differing positions
span less than the whole space, so some v is orthogonal to them all: in its table the two fingerprints agree on
every position kept. Every pair within the radius thus meets in a bucket of some table.

A task compares the members of a bucket, up to ``BUCKET`` of them. Larger buckets are counted before and not gathered: their members
meet at midpoints. Two values within the radius have a value between them that lies within half the radius of both, and all values
around one midpoint are within the radius of each other; so each member names the values around it, whatever the size of
its buckets a fixed number (2081 at radius 4), and is linked to the least member that names the same one. No bucket is capped.

Texts of which four shingles in five are alike differ in few bits if shingles are short and in many if they are long, and a large radius needs many tables. So
``keep_first``, which wants five-word shingles to be alike, finds pairs of texts by fingerprints of word pairs, within a radius of 6 (127 tables), and verifies
each link by the exact share of five-word shingles that the two texts have in common. Large groups of copies are then one. Pairs of texts of different groups that
the trees of the buckets don't ask, or that no table brings together, meet by a prefix of their shingles, in one order of all shingles: of two sets of which so much is common, each has one
of these among its first fifth. So no pair that is alike goes without a link: of those within the radius, or, as the pipeline wants it, whatever their fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkset.llm.components import connected_components
from sparkset.llm.shared import keep, map_arrow, own_column, read_texts, release, slices

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints by which ``keep_first`` finds pairs: words in a shingle and differing bits.
FOUND = (2, 6)
#: Words in the shingles that verify a pair, and the share of the shingles of both that both must have.
VERIFIED = (5, 0.8)
#: Shingles of ``COMMON`` texts or more stand last in the order of shingles, up to so many of them: a choice of cost alone, any order finds the same links.
COMMON, MOST_COMMON = 32, 262_144
#: Ranges by which halves of hashes are counted, a power of two, and halves that a task gathers before it sends them.
RANGES, HELD = 4096, 4_000_000
#: Pairs that a member of a prefix bucket is given in each round; the last round has all that are then of different groups.
ROUNDS = (4, None)
#: Members of a bucket that a task compares with each other; those of larger buckets meet at midpoints.
BUCKET = 65_536

_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles, A-Z lower-cased, in order and with repeats; of fewer words the whole sequence, and none of an empty text."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit integer; 0 where it has no words."""
    hashes = shingle_hashes(text, shingle, seed)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS_OF) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a signed long) of each row."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    return map_arrow(documents.select(F.col(id_col), F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, fp long")


@cache
def table_masks(radius: int = RADIUS) -> tuple[int, ...]:
    """Masks of the tables: the positions that each keeps."""
    vectors = (1 << radius + 1) - 1
    # by steps of four, the first vectors dealt out span the space: each mask keeps about half of the positions
    return tuple(sum(((i * 4 % vectors + 1 & v).bit_count() & 1) << i for i in range(64)) for v in range(1, vectors + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spread(group: np.ndarray, radius: int, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A tree for each set of members that are linked, directly or through others: pairs within the radius, by their names if there are any."""
    rest, called, out = group, group if names is None else names, []
    while len(rest) > 1:
        front, rest, called = [(rest[0], called[0])], rest[1:], called[1:]
        while front and len(rest):
            at, name = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                front += zip(rest[near], called[near])
                out += [(int(name), int(x)) for x in called[near]]
                rest, called = rest[~near], called[~near]
    return out


def _linked_in_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    """Rows (mask, key, fp and perhaps name) to links (a, b), pairs within the radius that join all members of a bucket which the radius joins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def linked_now() -> list[tuple[int, int]]:
            fp, *names = (np.concatenate(x) for x in zip(*held)) if held else [np.empty(0, np.uint64)]
            return spread(fp, radius, *names)

        for batch in batches:
            mask, key, *values = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            values = [v.view(np.uint64) for v in values]
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(mask)]))
            links: list[tuple[int, int]] = []
            # the first and last group may go on in other batches; of those between, only the ones with several members matter
            for g in sorted({0, len(starts) - 1} | set(np.flatnonzero(ends - starts > 1).tolist())) if len(mask) else []:
                part, here = [v[starts[g] : ends[g]] for v in values], (int(mask[starts[g]]), int(key[starts[g]]))
                if here != at:
                    links += linked_now()
                    at, held = here, []
                held.append(part)
            if links:
                yield _link_batch(links)
        if links := linked_now():
            yield _link_batch(links)

    # members of a bucket stand in one order in all tables, so that these give the same links again and again
    return map_arrow(buckets.repartition("mask", "key").sortWithinPartitions(*buckets.columns), run, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.unique(np.array(links, np.uint64).view(np.int64), axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


@cache
def around(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that differ between a value and those within half the radius of it, and, for an odd radius, one further; and which are the nearer."""
    reach = -(-radius // 2)
    flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(64), n)]
    return np.array(flips, np.uint64), np.array([x.bit_count() <= radius // 2 for x in flips])


def _linked_at_midpoints(members: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), pairs within the radius that join all members which the radius joins, by the values between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, nearer = around(radius)
        for batch in slices(batches, 16):
            fp, name = (batch.column(i).to_numpy() for i in range(2))
            middle = (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(middle), pa.array(np.repeat(name, len(flips))), pa.array(np.tile(nearer, len(fp)))], names=["middle", "name", "near"])

    name = F.col("name" if "name" in members.columns else "fp").alias("name")
    named = keep(map_arrow(members.select("fp", name), run, "middle long, name long, near boolean"))
    least = named.groupBy("middle").agg(F.min(F.when(F.col("near"), F.col("name"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null").select("middle", "a")
    found = keep(named.join(least, "middle").where("a != name").select("a", F.col("name").alias("b")).distinct())
    release(named)
    return found


def linked(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between values of ``fp``, or of ``name`` if there is one: pairs within the radius whose components are those of all such pairs."""
    values = [c for c in ("fp", "name") if c in distinct.columns]
    deal = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in table_masks(radius)]))
    rows = distinct.select(*values, deal.alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), *values)
    large = keep(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("mask", "key"))
    if large.isEmpty():
        release(large)
        return keep(_linked_in_buckets(rows, radius).distinct())
    small = _linked_in_buckets(rows.join(large, ["mask", "key"], "left_anti"), radius)
    at_midpoints = _linked_at_midpoints(rows.join(large, ["mask", "key"], "left_semi").select(*values).distinct(), radius)
    found = keep(small.unionAll(at_midpoints).distinct())
    release(large)
    release(at_midpoints)
    return found


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id that links reach) of each row.

    Null and blank texts have fingerprint zero, which links like any other; rows repeat as in the input; null ids
    are carried along and never become a component's id unless it has no other. Other columns are not read.
    """
    docs = keep(fingerprints(documents, id_col, text_col))
    distinct = keep(docs.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    links = linked(distinct, radius, bucket)
    stars = connected_components(links)
    release(links)
    member = keep(distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    release(distinct)
    release(stars)
    component = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = keep(member.select("fp", "root").join(component, "root").select("fp", "component_id"))
    release(member)
    return docs.join(label, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = VERIFIED[0]) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; of fewer words the whole sequence, and none of an empty text."""
    return np.unique(shingle_hashes(text, shingle))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def parities(found: np.ndarray) -> bytes:
    """Bits of a set, some more than it has shingles: bit i is 1 if an odd number of shingles have the remainder i."""
    bits = max(64, 1 << len(found).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_be_alike(n_a: int, a: bytes, n_b: int, b: bytes) -> bool:
    """False only if two sets of these sizes and parities can't be alike: each bit that differs is a shingle at least that only one of them has."""
    x, y = (np.frombuffer(p, np.uint8) for p in (a, b))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    least = VERIFIED[1]
    return int(np.bitwise_count(x ^ y).sum()) <= (n_a + n_b) * (1 - least) / (1 + least) + 1e-9


def _sets(texts: DataFrame) -> DataFrame:
    """Texts (name, first and text) to name, first, ``fp`` of word pairs, ``n`` and ``bits`` (size and parities of the set) and ``shingles``, a table made by ``keep``."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [t.as_py() for t in batch.column(2)]
            fp = np.fromiter((fingerprint(t, FOUND[0]) for t in held), np.uint64, len(held)).view(np.int64)
            sets = [shingle_set(t) for t in held]
            made = [pa.array(fp), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["name", "first", "fp", "n", "bits", "shingles"])

    return keep(map_arrow(texts, cut, f"name long, first {texts.schema['first'].dataType.simpleString()}, fp long, n long, bits binary, shingles binary"))


def _both(links: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Links (a, b) and these columns of the sets of both ends."""
    side = lambda end: sets.select(F.col("name").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]).hint("merge")
    return links.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{end}" for end in "ab" for c in columns])


def _verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links whose sets of shingles are alike by ``VERIFIED``, a table made by ``keep``. Parities, a fortieth of the sets, tell most others; only for the rest are whole sets moved."""
    least = VERIFIED[1]

    def may(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [may_be_alike(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = lambda x: np.frombuffer(x.as_py(), np.uint64)
            alike = [similarity(read(x), read(y)) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    links = keep(map_arrow(_both(links, sets, "n", "bits"), may, "a long, b long"))
    asked = keep(sets.select("name", "shingles").join(links.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "name", "left_semi"))
    found = keep(map_arrow(_both(links, asked, "shingles"), compare, "a long, b long"))
    release(links)
    release(asked)
    return found


def _shingles_of(x: pa.Scalar) -> np.ndarray:
    """A text's set of shingles; an empty one has a shingle that no text has, by which empty ones meet."""
    found = np.frombuffer(x.as_py(), np.uint64)
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent upper halves of shingles' hashes, sorted, and the place of each by its number of texts, from 1. Halves take less disk and give an order as well.

    Tasks send the halves of a range as one row, four bytes each, not a row a half."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def ranges() -> pa.RecordBatch:
            halves = np.sort(np.concatenate(held))
            at = halves >> np.uint32(32 - RANGES.bit_length() + 1)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(at[cuts], pa.int64()), pa.array([x.tobytes() for x in np.split(halves, cuts[1:])], pa.binary())], names=["range", "halves"])

        for batch in slices(batches, 64):
            held += [(_shingles_of(x) >> np.uint64(32)).astype(np.uint32) for x in batch.column(0)]
            if sum(map(len, held)) >= HELD:
                yield ranges()
                held = []
        if held:
            yield ranges()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # of one range, which may go on in the next batch

        def frequent() -> pa.RecordBatch:
            halves, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[n >= COMMON], pa.int64()) for x in (halves, n)], names=["half", "n"])

        for batch in batches:
            for here, halves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != at:
                    if held:
                        yield frequent()
                    at, held = here, []
                held.append(halves)
        if held:
            yield frequent()

    ranges_of = map_arrow(sets.select("shingles"), run, "range long, halves binary").repartition("range").sortWithinPartitions("range")
    counted = keep(map_arrow(ranges_of, count, "half long, n long"))
    halves = counted.orderBy(F.desc("n"), "half").limit(MOST_COMMON).select("half").toArrow()["half"].to_numpy().view(np.uint64)
    release(counted)
    order = np.argsort(halves)
    return halves[order], len(halves) - order


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, common ones last, of which any set that is alike has one among its own first."""
    (halves, places), half = common, found >> 32
    place = np.zeros(len(found), np.int64)
    if len(halves):
        at = np.searchsorted(halves, half).clip(max=len(halves) - 1)
        place = np.where(halves[at] == half, places[at], 0)
    return found[np.lexsort((found, place))][: len(found) - int(np.ceil(VERIFIED[1] * len(found) - 1e-9)) + 1]


def _prefixes(sets: DataFrame) -> DataFrame:
    """Rows (token, name, n, place) of the prefixes' shingles that more than one text has: n of the set, place of the shingle in it. A table made by ``keep``."""
    common = _common(sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [_shingles_of(x) for x in batch.column(1)]
            first = [prefix(x, common) for x in held]
            if first:
                sizes = [len(x) for x in first]
                made = [np.concatenate(first).view(np.int64), np.repeat(batch.column(0).to_numpy(), sizes), np.repeat([len(x) for x in held], sizes), np.concatenate([np.arange(x) for x in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["token", "name", "n", "place"])

    rows = map_arrow(sets.select("name", "shingles"), run, "token long, name long, n long, place long")
    return keep(_of_several(rows, "name"))


def _of_several(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose token has several values of ``column``."""
    token = Window.partitionBy("token")
    return rows.withColumns({"low_": F.min(column).over(token), "high_": F.max(column).over(token)}).where("low_ != high_").drop("low_", "high_")


def bucket_pairs(name: np.ndarray, root: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray, radius: int | None = None, most: int | None = None) -> list[tuple[int, int]]:
    """Pairs of a token's members that have different roots, are within the radius and may be alike by their sizes and places; at most ``most`` a member, of the most equal sizes."""
    roots, counts = np.unique(root, return_counts=True)
    top, out = roots[counts.argmax()], []
    for i in np.flatnonzero(root != top).tolist():
        shared = np.minimum(n - place, n[i] - place[i])
        met = (root == top) | (np.arange(len(root)) > i)
        if radius is not None:
            met &= np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= radius
        may = np.flatnonzero(met & (root != root[i]) & (np.minimum(n, n[i]) / np.maximum(n, n[i]) >= VERIFIED[1]) & (shared / (n + n[i] - shared) >= VERIFIED[1]))
        if most is not None and len(may) > most:
            may = may[np.argsort(np.abs(n[may] - n[i]), kind="stable")[:most]]
        out += [(min(int(name[i]), x), max(int(name[i]), x)) for x in name[may].tolist()]
    return out


def _met_by_prefixes(rows: DataFrame, radius: int | None, most: int | None) -> DataFrame:
    """Rows (token, name, root, fp, n, place) to pairs (a, b) of different roots that a token brings together, a table made by ``keep``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of one token, which may go on in the next batch

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = np.unique(np.array(pairs, np.int64), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        pairs: list[tuple[int, int]] = []
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy() for i in range(6)])
            for part in np.split(table, np.flatnonzero(np.diff(table[0])) + 1, axis=1) if batch.num_rows else []:
                if held and held[0][0, 0] != part[0, 0]:
                    pairs += bucket_pairs(*np.concatenate(held, axis=1)[1:], radius, most)
                    held = []
                held.append(part)
            if len(pairs) > 10_000:
                yield made(pairs)
                pairs = []
        if held:
            pairs += bucket_pairs(*np.concatenate(held, axis=1)[1:], radius, most)
        if pairs:
            yield made(pairs)

    several = _of_several(rows.select("token", "name", "root", "fp", "n", "place"), "root").sortWithinPartitions("token", "name")
    return keep(map_arrow(several, run, "a long, b long").distinct())


def _groups(sets: DataFrame, radius: int | None) -> DataFrame:
    """``node`` and ``root`` of every text that alike ones link to a smaller name, a table made by ``keep``."""
    distinct = sets.select("name", "fp")
    links = linked(distinct, FOUND[1])
    verified = [_verified(links, sets)]
    release(links)
    stars = connected_components(verified[0])
    prefixes = _prefixes(sets)
    for most in ROUNDS:
        rooted = distinct.join(stars.withColumnRenamed("node", "name"), "name", "left").select("name", "fp", F.coalesce("root", "name").alias("root"))
        pairs = _met_by_prefixes(prefixes.join(rooted, "name"), radius, most)
        verified.append(_verified(pairs, sets))
        release(pairs)
        if not verified[-1].isEmpty():
            release(stars)
            stars = connected_components(reduce(DataFrame.unionAll, verified))
    release(prefixes)
    for table in verified:
        release(table)
    return stars


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = FOUND[1]) -> DataFrame:
    """The first row, by id, of each group of near-duplicates; rows without an id stay.

    Any two texts are linked if they have enough five-word shingles in common (``VERIFIED``), A-Z lower-cased, and their fingerprints of word pairs are within
    ``radius`` (at least that of ``FOUND``), or anywhere if it is None; groups are what links join. Fingerprints find most links, prefixes of the shingles the rest. Equal texts are one, null and blank ones a group. One id may stand on several texts: each is
    judged in its own group, and of one group's texts with the first id one stays.
    """
    row, mark = own_column(documents, "row_"), own_column(documents, "mark_")
    if radius is not None and radius < FOUND[1]:
        raise ValueError(f"a radius of {radius} is below {FOUND[1]}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = documents.withColumn(row, F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))))
    texts = named.where(F.col(row).isNotNull()).select(F.col(f"{row}.text").alias("name"), F.col(row).alias("first"), text.alias("text"))
    sets = _sets(texts.groupBy("name").agg(F.min("first").alias("first"), F.first("text").alias("text")))  # texts move once
    stars = _groups(sets, radius)
    first = keep(sets.select("name", "first").join(stars.withColumnRenamed("node", "name"), "name", "left").groupBy(F.coalesce("root", "name")).agg(F.min("first").alias(mark)).select(mark))
    release(sets)
    release(stars)
    first = first.hint("merge")  # it grows with the documents
    return named.join(first, F.col(row) == F.col(mark), "left_semi").dropDuplicates([row]).drop(row).unionByName(documents.where(F.col(id_col).isNull()))


def op10_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_duplicates(read_texts(spark, sf_dir, "documents"))
