"""Token ids of batches of texts: each distinct piece goes to the library once, in few calls; ids are those of the plain call."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skein.llm import tokens

PARTS = ["<|endoftext|>", *[" "] * 5, "\n", "\n", "\t", "\r\n", "  ", " ", "　", "᠎", " ", "\u0085", "\x1c", "\0"]
PARTS += ["word", "Word.", "Ünï,", "ſſ", "don't", "x1.", "...", "a.b", "中文", "İ", "Ġ", "Ċ", "é", "🙂", "b" * 700]


class Counted:
    """A tokenizer that notes how much text each call gives it."""

    def __init__(self, tool):
        self.tool, self.given = tool, []

    def encode_batch_fast(self, texts, **options):
        self.given += [len(t) for t in texts]
        return self.tool.encode_batch_fast(texts, **options)

    def encode(self, text, **options):
        self.given.append(len(text))
        return self.tool.encode(text, **options)


def test_distinct_pieces_are_encoded_once_in_few_calls():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(5000)]
    words += [f"{w}-{w[:3]}" for w in words[:2000]]
    texts = [" ".join(rng.sample(words, 300)) + "\n" + rng.choice(words) for _ in range(200)]
    tool = tokens.Encoder(*tokens.tokenizer_files())
    tool.model, tool.tokenizer = Counted(tool.model), Counted(tool.tokenizer)
    first, again = (tool.batch(pa.array(texts), 0) for _ in range(2))
    assert first.equals(again)
    given = tool.model.given + tool.tokenizer.given
    assert len(given) < 20
    distinct = {p for t in texts for p in ("\n" + t).replace("\n", " \n").split(" ")}
    assert sum(given) < 2 * sum(len(p) + 2 for p in distinct) < sum(map(len, texts)) / 2


@pytest.mark.parametrize(("cache", "call"), [(24 << 20, 256 << 10), (3000, 40), (0, 1)])
def test_batches_equal_the_plain_call(cache, call, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", cache)
    monkeypatch.setattr(tokens, "CALL_BYTES", call)
    path, pattern = tokens.tokenizer_files()
    plain, tool, rng = Tokenizer.from_file(path), tokens.Encoder(path, pattern), random.Random(7)
    for n in (0, 1, 2, 700, 700):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(PARTS) for _ in range(rng.randrange(7))) for _ in range(n)]
        told = tool.batch(pa.array(texts, pa.string()), 7).to_pylist()
        assert told == [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_batches_are_cut_and_joined(monkeypatch):
    """Rows stay in order, whatever the sizes of the batches that come, and one long text among short ones is whole."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", 4000)
    texts = [f"text {i}" for i in range(900)]
    texts[450] = "long " * 5000
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array(texts)], names=["doc_id", "text"])
    out = list(tokens.sized([rows.slice(0, 3), rows.slice(3, 0), rows.slice(3, 7), rows.slice(10)]))
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([rows]))
    assert 5 < len(out) < 60
    assert list(tokens.sized([rows.slice(0, 0)])) == []
