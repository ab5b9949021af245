"""Each stage of the pipeline against brute force, on what the stage before has kept."""

import struct

import pytest
from conftest import SF
from test_small_ops import brute_lines

import corpus_pipeline as cp
from sparkset.llm import decontaminate, quality_knn, simhash
from sparkset.llm.shared import keep, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = read_table(spark, SF, "documents"), [None]
    out[0] = docs.orderBy("doc_id").collect()
    for _, stage in cp.STAGES:
        docs = keep(stage(spark, docs, SF))
        out.append(docs.orderBy("doc_id").collect())
    return out


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_columns_and_order(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[1:5])
    assert all(set(ids(b)) <= set(ids(a)) for a, b in zip(stages, stages[1:]))
    assert cp.run(spark, SF).count() == len(stages[-1])


def test_quality_stage(spark, stages):
    docs = read_table(spark, SF, "documents")
    model = quality_knn.fit(docs, read_table(spark, SF, "labels").where(~quality_knn.held_out()))
    import numpy as np

    scores = model.score(np.stack([quality_knn.term_shares(r["text"]) for r in stages[0]]))
    assert ids(stages[1]) == [r["doc_id"] for r, s in zip(stages[0], scores) if s >= quality_knn.THRESHOLD]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    kept = set(ids(stages[1]))
    assert all(d in kept for d, quality in labels.items() if quality == 1)


def test_line_stage(stages):
    want = brute_lines([r["text"] for r in stages[1]], 50)
    assert [r["text"] for r in stages[2]] == [want[i] for i in range(len(stages[1]))]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def grouped(n, alike):
    """The first member of each member's group, by all pairs."""
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and alike(i, j):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_duplicate_stage(stages):
    rows = stages[2]
    prints, sets = [simhash.fingerprint(r["text"], simhash.FOUND[0]) for r in rows], [simhash.shingle_set(r["text"]) for r in rows]
    group = grouped(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= simhash.FOUND[1] and simhash.similarity(sets[i], sets[j]) >= simhash.VERIFIED[1])
    assert ids(stages[3]) == [rows[g]["doc_id"] for g in sorted(set(group))]


def test_near_duplicate_stage_against_similarity(spark):
    """Of a larger table: what goes is like something that stays, and most near copies by five-word shingles go."""
    rows = read_table(spark, SF.replace("0.001", "0.01"), "documents").orderBy("doc_id").collect()
    kept = {r["doc_id"] for r in simhash.keep_first(read_table(spark, SF.replace("0.001", "0.01"), "documents")).collect()}
    words = [(r["text"] or "").lower().split() for r in rows]
    cut = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    place = {}
    for i, c in enumerate(cut):
        for s in c:
            place.setdefault(s, []).append(i)
    best = [0.0] * len(rows)  # similarity to the most alike row
    copies, wrong = [], []
    for i, c in enumerate(cut):
        shared = {}
        for s in c:
            for j in place[s]:
                if j != i:
                    shared[j] = shared.get(j, 0) + 1
        alike = {j: n / (len(c) + len(cut[j]) - n) for j, n in shared.items()}
        best[i] = max(alike.values(), default=0.0)
        if any(x >= 0.8 and j < i for j, x in alike.items()):
            copies.append(rows[i]["doc_id"])
    wrong = [r["doc_id"] for r, b in zip(rows, best) if r["doc_id"] not in kept and b < 0.8]
    caught = sum(d not in kept for d in copies) / len(copies)
    assert not wrong and caught >= 0.8, (wrong, caught)


def test_decontamination_stage(spark, stages):
    items = [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    parts = [[decontaminate.shingles(p) for p in decontaminate.question_and_answer(t)] for t in items]
    half = max(decontaminate.PASSAGE // 2, *(len(decontaminate.terms_of(t)) for t in items))

    def leaks(text):
        w = decontaminate.terms_of(text)
        for at in range(0, max(1, len(w) - half), half):
            here = w[at : at + 2 * half]
            held = decontaminate.shingles_in(here)
            if here and any(all(decontaminate.share(p, held, here) >= 0.8 for p in both) for both in parts):
                return True
        return False

    assert ids(stages[4]) == [r["doc_id"] for r in stages[3] if not leaks(r["text"])]


def test_token_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for before, after in zip(stages[4], stages[5]):
        given = library.encode(before["text"], add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(after['ids']) // 4}I", after["ids"])) == given and after["n_tokens"] == len(given) and after["decoded"] == before["text"]


def test_empty_and_odd_documents(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, "a", 0), (3, "some words " * 40, "en", "a", 1), (3, "some words " * 40, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            docs = keep(stage(spark, docs, SF))
            docs.count()
