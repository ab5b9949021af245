"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece of text has one BPE encoding, and the encoding of the whole is reached by following,
from the end, the last token of each prefix. A token can be the last one of a prefix when it is a suffix of it
(found by the suffix automaton of the vocabulary) and when it is compatible with the last token of what stands
before it: merging the two as BPE would, no merge crosses their border. Exactly one token passes both tests.

The driver builds the encoder and broadcasts it; its size depends on the vocabulary alone. As it is built, the bytes of each token are merged one by
one: only tokens that come out are matched, and a piece that is one of them is looked up. Other pieces of many texts are encoded in order: what was found of a prefix
serves all pieces that begin with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import map_arrow, read_texts, slices
from sparkset.llm.suffix_automaton import SuffixAutomaton

#: How the public byte-level vocabularies cut text before merging (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and pairs of tokens, that a worker adds before it forgets those not met since it last did; this bounds its memory.
REMEMBERED = 110_000
#: Longer pieces are encoded but not remembered.
LONGEST_REMEMBERED = 64
#: Characters of the texts whose pieces are encoded together.
TOGETHER = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 stands for itself, the rest from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixEncoder:
    """Encoder and decoder of one vocabulary, made from the text of its JSON file."""

    def __init__(self, vocabulary_json: str):
        spec = json.loads(vocabulary_json)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("vocabularies that add a space before the text are not supported")
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.token_bytes: dict[int, bytes] = {i: t for t, i in self.id_of.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (self.id_of[as_bytes(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.id_of[self.token_bytes[left] + self.token_bytes[right]]
            self.merge_rank[left, right] = rank
            self.made_from.setdefault(whole, (rank, left, right))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.old_compatible: dict[tuple[int, int], bool] = {}
        #: Tokens that merging their own bytes makes; no other one is ever the last token of a prefix.
        self.whole = {token: i for token, i in self.id_of.items() if self._merged(token) == [i]}
        self.automaton = SuffixAutomaton(self.whole.items())
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        named = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.added_pattern = regex.compile(f"({named})") if named else None
        self.find_pieces = regex.compile(PIECES).findall
        self.packed: dict[str, bytes] = {}
        self.old_packed: dict[str, bytes] = {}

    def _merged(self, token: bytes) -> list[int]:
        """Encoding by merges, one after the other."""
        ids = [self.id_of[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 1:
            rank, at = min((self.merge_rank.get(pair, len(self.merge_rank)), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == len(self.merge_rank):
                break
            ids[at : at + 2] = [self.id_of[self.token_bytes[ids[at]] + self.token_bytes[ids[at + 1]]]]
        return ids

    def are_compatible(self, left: int, right: int) -> bool:
        """True if BPE leaves the border between the two tokens in place.

        The tokens are taken apart, latest merge first. Whenever the tokens at the border could merge, that merge
        must come no earlier than the one just undone, which in BPE had then been made already.
        """
        pair = left, right
        known = self.compatible.get(pair)
        if known is None:
            known = self.old_compatible.get(pair)
            if known is None:
                known = self._border_stands(left, right)
            if len(self.compatible) >= REMEMBERED:
                self.compatible, self.old_compatible = {}, self.compatible
            self.compatible[pair] = known
        return known

    def _border_stands(self, left: int, right: int) -> bool:
        a, b, bound, a_undone = left, right, len(self.merge_rank), False
        while True:
            rank = self.merge_rank.get((a, b))
            # at equal rank the leftmost pair merges first: the crossing one stands right of what a lost, left of what b lost
            if rank is not None and (rank < bound or rank == bound and not a_undone):
                return False
            last_a, last_b = self.made_from.get(a, (-1, 0, 0)), self.made_from.get(b, (-1, 0, 0))
            if last_a[0] < 0 and last_b[0] < 0:
                return True
            # of two merges of one rank, the right one was made last
            if last_a[0] > last_b[0]:
                bound, a, a_undone = last_a[0], last_a[2], True
            else:
                bound, b, a_undone = last_b[0], last_b[1], False

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.whole.get(piece)
        return next(self._by_prefixes([piece])) if whole is None else [whole]

    def _by_prefixes(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodings of pieces, one after the other. What is known of the prefix that a piece has in common with the piece before is not computed again."""
        step, links, longest, ends, known = self.automaton.step, self.automaton.links, self.automaton.longest, self.automaton.ends, self.compatible
        test = self.are_compatible
        # of each prefix, by its length: its last token, where that starts, the automaton's state and the length of the suffix read
        last, start, states, lengths = [-1], [0], [0], [0]
        previous = b""
        for piece in pieces:
            n, at = len(piece), 0
            for x, y in zip(piece, previous):
                if x != y:
                    break
                at += 1
            previous = piece
            if len(last) <= n:
                more = n + 1 - len(last)
                last += [-1] * more
                start += [0] * more
                states += [0] * more
                lengths += [0] * more
            state, length = states[at], lengths[at]
            for end in range(at + 1, n + 1):
                c = piece[end - 1]
                follows = step.get(state << 8 | c)
                while follows is None:
                    state = links[state]
                    if state < 0:
                        raise ValueError("the vocabulary has no token for a byte")
                    length = longest[state]
                    follows = step.get(state << 8 | c)
                state, length = follows, length + 1
                states[end], lengths[end] = state, length
                for size, token in ends[state]:
                    if size > length:
                        continue
                    before = end - size
                    if before:
                        fits = known.get((last[before], token))
                        if not (test(last[before], token) if fits is None else fits):
                            continue
                    last[end], start[end] = token, before
                    break
            ids = []
            while n:
                ids.append(last[n])
                n = start[n]
            ids.reverse()
            yield ids

    def _cut(self, text: str) -> list[str]:
        """Pieces and added tokens of a text; a piece never is the string of an added token."""
        parts = self.added_pattern.split(text) if self.added_pattern else [text]
        return self.find_pieces(text) if len(parts) == 1 else [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.find_pieces(part))]

    def _packed_pieces(self, asked: set[str]) -> dict[str, bytes]:
        """Packed ids of these pieces and added tokens; those not remembered are encoded in order, so that they share prefixes."""
        if len(self.packed) >= REMEMBERED:
            self.packed, self.old_packed = {}, self.packed
        out = {p: self.added[p].to_bytes(4, "little") for p in asked & self.added.keys()}
        for remembered in (self.packed, self.old_packed):
            out |= {p: remembered[p] for p in (asked - out.keys()) & remembered.keys()}
        new = {p.encode(): p for p in asked - out.keys()}
        for piece in new.keys() & self.whole.keys():
            out[new.pop(piece)] = self.whole[piece].to_bytes(4, "little")
        ordered = sorted(new)
        for piece, ids in zip(ordered, self._by_prefixes(ordered)):
            out[new[piece]] = pack(f"<{len(ids)}I", *ids)
        for p in asked - self.packed.keys() - self.added.keys():
            if len(self.packed) >= REMEMBERED:
                break
            if len(p) <= LONGEST_REMEMBERED:
                self.packed[p] = out[p]
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text. Texts are taken together until they have ``TOGETHER`` characters, so that their pieces are looked up once."""
        held: list[list[str]] = []
        size = 0

        def encoded() -> Iterator[bytes]:
            packed = self._packed_pieces(set().union(*held)).__getitem__
            return (b"".join(map(packed, pieces)) for pieces in held)

        for text in texts:
            held.append(self._cut(text))
            size += len(text)
            if size >= TOGETHER:
                yield from encoded()
                held, size = [], 0
        if held:
            yield from encoded()

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder_of(vocabulary_json: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary_json)


def encode_decode(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary: the token ids as little-endian unsigned 32-bit integers) and ``decoded`` of every text.

    Null texts count as empty and have no ids; null ids of rows are carried along; repeated rows stay. Other
    columns of ``documents`` are not read. The driver reads the vocabulary file and broadcasts the encoder, whose
    size does not depend on the data. Strings of added tokens in a text become those tokens.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(encoder_of(f.read()))
    kind = documents.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for part in slices(batches):
            packed = list(encoder.encode_all(t.as_py() or "" for t in part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(packed, pa.binary()), pa.array(map(encoder.decode_packed, packed), pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    source = documents.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(source, run, f"`{id_col}` {kind.simpleString()}, ids binary, decoded string")


def token_count(ids):
    return (F.octet_length(ids) / 4).cast("long")


def op9_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts of all documents."""
    import public_tokenizers

    coded = encode_decode(read_texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        token_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
