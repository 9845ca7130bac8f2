from __future__ import annotations

import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.bpe import Automaton, Ranked, encode_documents
from millrace.llm.packing import CAPACITY, cuts, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), Automaton(PATH), Ranked(PATH)


def test_ids_and_round_trip(both):
    reference, automaton, ranked = both
    rng = random.Random(3)
    parts = ["a" * k for k in range(1, 9)] + ["the", " ", "  ", "\n", "\t", "'s", "é", "中文", "12", "½", "!!", " ", "​", "\x1c", "\x85", "😀", "<|endoftext|>", "abab", "\r\n", "\x00", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = reference.encode(text, add_special_tokens=False).ids
        got = automaton.encode(text)
        assert got == struct.pack(f"<{len(ids)}I", *ids) == ranked.encode(text), text
        assert automaton.decode(got) == reference.decode(ids, skip_special_tokens=False)


def test_words_side_by_side_and_alone_give_the_same_ids(both, monkeypatch):
    from millrace.llm import bpe

    reference, automaton, _ = both
    rng = random.Random(9)
    words = list({"".join(rng.choice("aeioubcdrstlnéß中") for _ in range(rng.randint(1, 20))) for _ in range(3000)})
    longest = max(automaton.labels, key=len).decode()
    words += [longest, longest * 3, "a" * 47, "a" * 48, "a" * 49, "é" * 24, "\x00", "x\x00\x00"]
    got = automaton.encode_pieces(words)
    monkeypatch.setattr(bpe, "ARC_BITS", 4)  # answers about arcs drive each other out
    small = Automaton(PATH)
    for w in words:
        ids = reference.encode(w, add_special_tokens=False).ids
        assert got[w] == automaton.encode_piece(w.encode()) == struct.pack(f"<{len(ids)}I", *ids), w
    assert small.encode_pieces(words) == got


def test_a_full_cache_keeps_what_a_batch_uses(both, monkeypatch):
    from millrace.llm import bpe

    reference, automaton, _ = both
    monkeypatch.setattr(bpe, "CACHE", 20)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdef12,") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        want = [reference.encode(t, add_special_tokens=False).ids for t in texts]
        assert automaton.encode_all(texts) == [struct.pack(f"<{len(i)}I", *i) for i in want]


def test_long_piece(both):
    reference, automaton, _ = both
    for text in ("a" * 3000, "=" * 3000, "ab" * 1500, " " * 500):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


DOCS = [(1, "one two three"), (2, None), (3, ""), (4, "x " * 6000), (1, "one two three"), (5, "é\n<|endoftext|> z"), (None, "lost")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, ids string, start int")


def test_encode_documents(spark, both):
    out = encode_documents(docs(spark), PATH).collect()
    assert len(out) == len(DOCS)
    for r, (i, t) in zip(sorted(out, key=lambda r: str(r["doc_id"])), sorted(DOCS, key=lambda r: str(r[0])), strict=True):
        ids = both[0].encode(t or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["decoded"] == (t or "")
    assert encode_documents(docs(spark, []), PATH).count() == 0


def test_cuts_cover():
    for n in range(1, 3 * CAPACITY):
        pieces = cuts(n)
        assert sum(p for p, _ in pieces) == n and all(p * k <= CAPACITY for p, k in pieces)


def test_packing(spark, both):
    rng = random.Random(1)
    rows = DOCS[:6] + [(100 + i, " ".join(rng.choice(("alpha", "beta", "of", "gamma")) for _ in range(rng.randint(0, 3000)))) for i in range(120)]
    out = [r.asDict() for r in pack_documents(docs(spark, rows).repartition(3), PATH).collect()]
    lengths = {}
    for i, t in rows:
        lengths.setdefault(i, []).append(len(both[0].encode(t or "", add_special_tokens=False).ids) + 1)
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t in rows if len(lengths[i]) == 1}
    for r in out:  # each piece holds the ids of its stretch
        if r["doc_id"] in texts:
            ids = [*both[0].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) and len(ids) == r["length"]
    assert by_doc.keys() == lengths.keys()
    for i, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(lengths[i])
        if len(lengths[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == lengths[i][0]
                at += p["length"]
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= CAPACITY
        padding += 0 if at & (at - 1) == 0 else CAPACITY - at
    assert padding < 0.02 * sum(map(sum, lengths.values()))
    assert pack_documents(docs(spark, []), PATH).count() == 0
