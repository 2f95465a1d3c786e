import random

import numpy as np
from tokenizers import Tokenizer

from paperloom.llm import bpe

ODD = [
    "", "Hello World's <|endoftext|>x <|STARTOFTEXT|>  it's it'LL 'RE", "a\x1cb \x1f\x85x y", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ß ẞ ﬁ é",
    "🤖👩‍👩‍👧 ñandú 日本語 ๒๓ 12345 ½ ²", "'s't're", "aaaa aaaaa aaaaaaaaaaaaa", "<|endoftext|><|startoftext|>", "\x00\x01 \x7f", "don't''s ___--==",
]


def test_equals_the_library():
    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.WordBpe(open(bpe.default_path(), encoding="utf-8").read())
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abcdeé 's.<|>12A\n") for _ in range(80)) for _ in range(300)]
    for t, (ids, decoded) in zip(texts, own.encode_all(texts), strict=True):
        e = lib.encode(t, add_special_tokens=False)
        assert ids == np.array(e.ids, "<u4").tobytes(), t
        assert decoded == lib.decode(e.ids, skip_special_tokens=False), t


def test_small_memory_gives_equal_results(monkeypatch):
    own = bpe.WordBpe(open(bpe.default_path(), encoding="utf-8").read())
    want = own.encode_all(ODD)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.WordBpe(open(bpe.default_path(), encoding="utf-8").read())
    assert [small.encode_all([t])[0] for t in ODD] == want


def test_rows_columns_and_round_trip(odd_docs, no_docs):
    out = bpe.encode_bpe(odd_docs, bpe.default_path())
    got = {r.doc_id: r for r in out.collect()}
    assert len(got[4].ids) > 100_000 and got[1].ids == b"" and got[1].decoded == "" and got[1]._t == "keep"
    again = {r.doc_id: r.decoded for r in bpe.decode_bpe(out.drop("decoded"), bpe.default_path()).collect()}
    assert again == {k: r.decoded for k, r in got.items()}
    assert bpe.encode_bpe(no_docs, bpe.default_path()).count() == 0
