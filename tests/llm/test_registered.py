"""Each registered query of the subpackage by its name: columns, types and digests, against code that shares nothing with the operators."""

import hashlib
import html.parser
import re
import struct
import zlib

import pytest
import xxhash
from conftest import SF

import __spark_entry__ as entry

#: Columns that a contract fixes, with their types.
COLUMNS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op7_quality_knn": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_suffix_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_bpe_roundtrip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_simhash_components": "doc_id bigint, fingerprint string, component_id bigint",
}


def run(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(COLUMNS[name])
    return df.collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op3(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    got = {r["page_id"]: r for r in run(spark, "op3_url_filter")}
    pages = table(spark, "pages")
    assert len(got) == len(pages)
    for p in pages:
        after = (p["url"] or "").split("://", 1)
        host, path = re.match(r"([^/?#]*)([^?#]*)", after[1], re.S).groups() if len(after) == 2 else ("", "")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        r, rule = got[p["page_id"]], max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (rules[rule] if rule else "block" if r["score"] >= 2 / 3 else "allow")


class Article(html.parser.HTMLParser):
    """Blocks of the article of the test tables' pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.held, self.blocks = 0, "", []
        self.feed(page)
        self.close()

    def cut(self):
        if text := " ".join(self.held.split()):
            self.blocks.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.cut()
        self.inside += tag == "article"
        self.held += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.held += data * (self.inside > 0)


def test_op5(spark):
    got = {r["page_id"]: r for r in run(spark, "op5_main_text")}
    pages = table(spark, "pages")
    assert len(got) == len(pages)
    for p in pages:
        text = "\n".join(Article(p["html"] or "").blocks)
        assert (got[p["page_id"]]["url"], got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (p["url"], text, len(text))


def test_op7(spark):
    rows = run(spark, "op7_quality_knn")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in table(spark, "documents"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_op9(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op9_bpe_roundtrip")}
    want = {}
    for d in table(spark, "documents"):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        digests = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode()
        want[d["doc_id"]] = (len(ids), *(hashlib.sha256(x).hexdigest() for x in digests))
    assert got == want


def test_op10(spark):
    prints = {}
    for d in table(spark, "documents"):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in d["text"] or "")) if w]
        parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        prints[d["doc_id"]] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    ids = sorted(prints)
    component = {i: i for i in ids}
    for a in ids:  # in order of ids: a component's name is its smallest
        for b in ids:
            if b > a and (prints[a] ^ prints[b]).bit_count() <= 4 and component[a] != component[b]:
                low, high = sorted((component[a], component[b]))
                component = {i: low if c == high else c for i, c in component.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op10_simhash_components")} == {i: (f"{prints[i]:016x}", component[i]) for i in ids}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_suffix_repeats"])
def test_types(spark, name):
    assert len(run(spark, name)) == len(table(spark, "documents"))
