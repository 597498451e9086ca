import hashlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from shelfspark.llm import bpe, token_counts  # noqa: E402
from tests.llm.util import docs  # noqa: E402

TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Hello, the world's 12 cats x　y"), (5, "a<|endoftext|>b <|ENDOFTEXT|> \x1c\x85z"),
    (6, "é ́ ΑΣ İstanbul ß 中文 🎉"), (None, "no id"), (None, "no id"), (7, "word " * 30000), (8, "x" * 5000), (4, "second text of a doc_id"),
]


def test_against_the_library(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    d = docs(spark, tmp_path, TEXTS)
    want = []
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), text))
    key = lambda r: (str(r[0]), r[1], r[3])
    whole = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_decode(d, path, texts=True).collect()]
    assert sorted(whole, key=key) == sorted(want, key=key)
    digests = [tuple(r) for r in bpe.encode_decode(d, path).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(digests, key=key) == sorted(((i, n, sha(a), sha(b.encode())) for i, n, a, b in want), key=key)


def test_empty_table(spark, tmp_path):
    d = docs(spark, tmp_path, [])
    assert bpe.encode_decode(d, P.path("word_bpe_49k.json")).count() == 0
    assert token_counts.count_tokens(d, ["a"]).count() == 0


def test_counts_against_plain_longest_match(spark, tmp_path):
    pieces = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    known = set(pieces)
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs(spark, tmp_path, TEXTS), pieces).collect())
    want = []
    for i, x in TEXTS:
        parts = [w for w in (x or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        want.append((str(i), len(parts), sum(token_counts.count_greedily("▁" + w, known) for w in parts)))
    assert got == sorted(want)


def test_automaton_with_unfinishable_prefixes():
    import random

    rng = random.Random(4)
    for _ in range(3000):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        assert token_counts.Automaton(pieces).count(word) == token_counts.count_greedily(word, set(pieces))
