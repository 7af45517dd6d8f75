import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from strataframe.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library(spark, odd, plain):
    want = sorted((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect() for ids in [plain.encode_ordinary(r.text or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, spark).collect()) == want


def test_arrays_round_trip(spark, odd, plain):
    ids = bpe.encode(odd, spark)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == sorted((str(r.doc_id), plain.encode_ordinary(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), bytes(r.data)) for r in bpe.decode(ids, spark).collect()) == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())


def test_long_words_and_no_rows(spark, none, plain):
    m = bpe.Merges(open(FILE, "rb").read())
    for w in ("a" * 3000, "abcdefghij" * 300, "éü" * 400, "日本語" * 300, "the" * 60):
        assert m._encode_long(w.encode()) == plain.encode_ordinary(w)
        matrix = [[]]
        m._encode_matrix([w.encode()], [0], len(w.encode()), matrix)
        assert matrix[0] == m._encode_long(w.encode())
        assert m.encode_words([w.encode()[:120]]) == [m._encode_long(w.encode()[:120])] or m.rank.get(w.encode()[:120]) is not None
    assert bpe.round_trip(none, spark).count() == 0
