"""Ids, packing and splitting, against the public library, round trips and brute force."""

import random
import unicodedata

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from evigraph.llm import bpe, encode, packing, splitting  # noqa: E402

PATH = f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE}"
REFERENCE = Tokenizer.from_file(PATH)
REFERENCE.encode_special_tokens = True
ENCODER = bpe.Encoder()
BUDGETS = [("a", 64, 8), ("b", 256, 32)]
TEXTS = ["", "a", "Бұл оқиға 1973 ж. күзінде болған. Келесі жыл.\n\nЖаңа абзац, мына жерде.", "那年冬天我们失去了一半的羊群。" * 60, "x" * 3000, "मैं यहाँ हूँ। " * 80, "word, word. " * 300, " \n\n \t " * 50, "é́👍🏽" * 200, "1328 303291 43 " * 90]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    assert ENCODER.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*TEXTS, "<|endoftext|>", "it's   we'll  \n", "aaaa" * 200])
def test_ids_of_hard_texts(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode(text, add_special_tokens=False).ids
    assert b"".join(ENCODER.vocabulary.token_bytes[i] for i in ids).decode() == text


def test_forgetting_words_changes_nothing():
    small = bpe.Encoder(keep=5)
    texts = ["one two three four five six", "seven eight one two", "six six six"]
    for _ in range(2):
        assert [small.flat(n).tolist() for n in small.numbers(texts)] == [ENCODER.encode(t) for t in texts]
        assert [small.encode(t) for t in texts] == [ENCODER.encode(t) for t in texts]


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hi", "x"), (2, None, "x"), (3, "", "x"), (4, "hi", "y")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_ids(df).collect()}
    assert got == {1: ENCODER.encode("hi"), 2: [], 3: [], 4: ENCODER.encode("hi")}
    assert rows(encode.token_sizes(df)) == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert rows(encode.encode_ids(df.limit(0))) == []


def test_chunks_bound_characters():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "t": ["aaa", None, "bbbbbb", "c"]})
    assert [k for k, _ in encode.chunks([b], limit=4)] == [[1, 2], [3], [4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_keeps_capacity_and_wastes_little(sizes):
    sizes = sorted(sizes, reverse=True)
    where = packing.pack(sizes, 64)
    used: dict[int, int] = {}
    for s, w in zip(sizes, where, strict=True):
        used[w] = used.get(w, 0) + s
    assert len(where) == len(sizes) and all(u <= 64 for u in used.values())
    # no two sequences could be one: else an item opened a sequence without need
    low = sorted(used.values())[:2]
    least = -(-sum(sizes) // 64)
    assert len(used) <= max(2 * least, 1) and (len(low) < 2 or len(used) <= least or sum(low) > 0)


def brute_take(sizes, capacity):
    """The rule by a plain scan: the cheapest sequence with room, in order of number on ties."""
    n = -(-sum(sizes) // capacity)
    room, price, out = [capacity] * n, [0.0] * n, []
    for s in sizes:
        fits = [i for i in range(len(room)) if room[i] >= s]
        i = min(fits, key=lambda i: (price[i], i)) if fits else len(room)
        if not fits:
            room.append(capacity)
            price.append(0.0)
        room[i] -= s
        price[i] += packing.cost(s)
        out.append(i)
    return out


def test_packing_equals_plain_scan():
    rng = random.Random(5)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 80))), reverse=True)
        assert packing.pack(sizes, 50) == brute_take(sizes, 50)


def test_pack_documents_is_whole(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 64), (3, 130), (4, 0), (5, None), (6, 60), (7, 4)], "doc_id long, n_tokens long")
    got = packing.pack_documents(sizes, [("t", 64, 8)]).collect()
    total: dict[int, int] = {}
    fill: dict[str, int] = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        if r["container_id"]:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert total == {1: 10, 2: 64, 3: 130, 4: 0, 5: 0, 6: 60, 7: 4}
    assert max(fill.values()) <= 64
    assert sorted((r["piece"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 3) == [(0, 0, 64), (1, 64, 64), (2, 128, 2)]
    assert all(r["container_id"] is None for r in got if r["doc_id"] in (4, 5))
    assert packing.pack_documents(sizes.limit(0), [("t", 64, 8)]).count() == 0
    assert packing.pack_documents(sizes, []).count() == 0


def test_pack_documents_in_many_shards(spark):
    sizes = spark.range(500).selectExpr("id as doc_id", "id % 50 + 1 as n_tokens")
    got = packing.pack_documents(sizes, [("t", 64, 8), ("u", 128, 8)], shard_items=60)
    assert got.where("budget_id = 't'").agg({"n_tokens": "sum"}).first()[0] == sizes.agg({"n_tokens": "sum"}).first()[0]
    assert got.groupBy("container_id").sum("n_tokens").where("container_id like 't%' and `sum(n_tokens)` > 64").count() == 0
    assert got.groupBy("budget_id", "doc_id").count().where("count <> 1").count() == 0


def pieces_of(texts, budgets=BUDGETS):
    return [r for b in splitting.split_chunk(bpe.Encoder(), list(range(len(texts))), texts, budgets) for r in b.to_pylist()]


def test_pieces_cover_their_text_within_the_limit():
    got = pieces_of(TEXTS)
    limit, overlap = {b: m for b, m, _ in BUDGETS}, {b: o for b, _, o in BUDGETS}
    by: dict[tuple, list] = {}
    for r in got:
        by.setdefault((r["budget_id"], r["doc_id"]), []).append(r)
        assert r["text"] == TEXTS[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert r["n_tokens"] <= limit[r["budget_id"]] and ENCODER.size(r["text"]) <= limit[r["budget_id"]]
    for (b, d), rs in by.items():
        rs.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rs] == list(range(1, len(rs) + 1))
        assert rs[0]["start_char"] == 0 and rs[-1]["end_char"] == len(TEXTS[d]) and rs[-1]["end_token"] == ENCODER.size(TEXTS[d])
        for x, y in zip(rs, rs[1:], strict=False):
            assert x["end_token"] - y["start_token"] == y["shared_tokens"]
            assert y["start_char"] <= x["end_char"]
            assert y["shared_tokens"] <= overlap[b] + 4
    assert {d for _, d in by} == {d for d, t in enumerate(TEXTS) if ENCODER.size(t) > 64}


def test_cuts_prefer_strong_boundaries():
    text = "\n\n".join(["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 3] * 8)
    got = [r for r in pieces_of([text], [("b", 256, 0)]) if r["piece"] > 1]
    assert got and all(r["boundary"] == bpe.PARAGRAPH for r in got)
    got = [r for r in pieces_of(["Some words stand here. " * 400], [("b", 64, 0)]) if r["piece"] > 1]
    assert all(r["boundary"] == bpe.SENTENCE for r in got)


def brute_bisect(units, strength, lo, hi, limit):
    """The same tree by plain recursion, without overlaps."""
    t = units
    if t[hi] - t[lo] <= limit:
        return [(lo, hi)]
    a, b = t[lo], t[hi]
    inside = [i for i in range(lo + 1, hi) if a + (b - a) / 4 <= t[i] <= b - (b - a) / 4]
    if not inside:
        inside = [max(lo + 1, min(hi - 1, int(np.searchsorted(t, (a + b) / 2))))]
    cut = max(inside, key=lambda i: (strength[i], -abs(2 * t[i] - a - b), -i))
    return brute_bisect(t, strength, lo, cut, limit) + brute_bisect(t, strength, cut, hi, limit)


def test_bisection_equals_plain_recursion():
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "a, ", "end. ", "\n", "\n\n", "Тексту ", "三月。"]) for _ in range(1500))
    tree = splitting.Bisection(bpe.Encoder(), [text], 16)
    got = sorted((int(a), int(b)) for _, _, los, his in tree.leaves([("x", 64, 0)]) for a, b in zip(los, his, strict=True))
    assert got == brute_bisect(tree.tokens, tree.strength, 0, len(tree.tokens) - 1, 64)


def test_split_frame_and_bad_budgets(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "long text. " * 200, "x")], "doc_id long, text string, piece string")
    assert {r["doc_id"] for r in splitting.split_documents(df, BUDGETS).collect()} == {4}
    assert splitting.split_documents(df.limit(0), BUDGETS).count() == 0
    # a bad budget neither ends the query nor takes the others along
    bad = [("none", None, 2), ("zero", 0, 2), ("same", 8, 8), ("tiny", 1, 0), *BUDGETS]
    got = splitting.split_documents(df, bad).select("budget_id", "n_tokens").collect()
    assert {r[0] for r in got} == {"same", "tiny", *(b for b, _, _ in BUDGETS)}
    assert max(r[1] for r in got if r[0] == "same") <= 8 and max(r[1] for r in got if r[0] == "tiny") == 1


def test_combining_marks_survive():
    text = unicodedata.normalize("NFD", "é" * 400)
    assert "".join(r["text"] for r in pieces_of([text], [("x", 64, 0)])) == text
