import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from weirflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_ids_are_those_of_the_merges(pair):
    c, reference = pair
    rng = random.Random(3)
    parts = ["a", "b", "  ", "the", "ing", " 1", "é", "日本", "\n", "\t", "<|endoftext|>", "'s", "!!!", "=-=", " ", "zz", "\u00a0", "🙂"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = c.encode(text)
        assert ids == reference.encode_ordinary(text) and c.decode(ids) == text.encode()
    for text in ("a" * 20_000, " " * 9_000, "ab=-" * 5_000):
        assert c.encode(text) == reference.encode_ordinary(text)


def test_backtracking_with_small_vocabularies():
    rng = random.Random(1)
    for trial in range(200):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 14:  # as training makes them: each joins two that exist
            made = rng.choice(tokens) + rng.choice(tokens)
            if made not in tokens:
                tokens.append(made)
        ranks = {t: i for i, t in enumerate(tokens)}
        c = bpe.Codec(ranks, r"(?s).+")
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            want = [ranks[piece]] if piece in ranks else bpe.merge_by_rank(piece, ranks)
            assert c.encode_piece(piece) == want, (trial, piece)


def test_a_small_memo_changes_nothing(pair):
    c, reference = pair
    small = bpe.Codec(c.ranks, public_tokenizers.PATTERN, 3)
    text = "many different words which do not fit into so small a memo, words which are many " * 3
    assert small.encode(text) == reference.encode_ordinary(text)
    assert len(small.memo) <= 3 and len(small.memo.old) <= 3 and len(small.pairs) <= 3


def test_what_is_found_again_stays_in_the_memo():
    made = []
    memo = bpe._Memo(lambda piece: made.append(piece) or [1], 4)
    for k in range(50):
        memo["hot"], memo[f"rare{k}"]
    assert made.count(b"hot") == 1 and len(made) == 51


def test_frame(spark, awkward, empty, pair):
    _, reference = pair
    got = sorted(str(tuple(r)) for r in bpe.encode_documents(awkward, PATH, public_tokenizers.PATTERN).collect())

    def row(r):
        ids = reference.encode_ordinary(r.text or "")
        return r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()

    assert got == sorted(str(row(r)) for r in awkward.collect())
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN, with_ids=True).count() == 0
