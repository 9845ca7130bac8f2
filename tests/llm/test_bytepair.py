"""Byte-level BPE by column functions against the library, and its round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import registry
from millrace.llm.bytepair import NEW_LETTERS, NEW_NUMBERS, encode_documents, pair_cells

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzzed(n):
    rng = random.Random(8)
    parts = ["a" * k for k in range(1, 9)] + ["the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "中文", "12", "½", "!!", "\u00a0", "\u200b", "\x1c", "\x85", "😀", "<|endoftext|>", "abab", "\r\n", "\x00", "ſ", "Straße", "naïve", "ﬁ", "\u3000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("words", [0, 500])
def test_equals_the_library(spark, library, words):
    newer = [chr(int(r.split("-")[k], 16)) for r in (NEW_LETTERS + " " + NEW_NUMBERS).split() for k in (0, -1)]
    texts = [*fuzzed(700), None, "", "=" * 300, "ab" * 150, " " * 200, *[f"a{c}1{c} !{c}" for c in newer]]
    rows = [(i, t, "clash", "decoded") for i, t in enumerate(texts)] + [(None, "lost id", "", ""), (5, texts[5], "", ""), (5, texts[5], "", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)
    got = [(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in encode_documents(frame, PATH, words=words, one_in=1).collect()]
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = registry.QUERIES["op13_bytepair"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), digest(",".join(map(str, ids)).encode()), digest(texts[r["doc_id"]].encode()))


def test_pair_cells_hold_exactly_the_tokens():
    """The laid-over table gives a rank to every pair of pieces that makes a token, and none to any other pair."""
    ranks = {c: i for i, c in enumerate("abcd")} | {"ab": 4, "bc": 5, "abc": 6, "cd": 7, "abcd": 8, "dd": 9, "xx": 12}
    cells, shifts, bits = pair_cells(ranks)
    for a, left in ranks.items():
        for b, right in ranks.items():
            cell = cells[shifts[left] + right]
            found = None if cell is None else cell ^ (left << bits)
            assert (None if found is None or found >= 1 << bits else found) == ranks.get(a + b)


def test_ranks_without_a_byte_are_an_error(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(255)))
    with pytest.raises(ValueError, match="single bytes"):
        encode_documents(None, str(path))
