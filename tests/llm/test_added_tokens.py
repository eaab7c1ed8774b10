import random

import pytest
from tokenizers import Tokenizer

from tests.llm.test_tokens import check_packing
from weirflow.llm import tokens

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def default():
    """The library's own settings: the strings of added tokens are those tokens."""
    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


def test_added_tokens_are_one_id(default):
    rng = random.Random(8)
    path = tokens.vocabulary_path()
    texts = ["".join(rng.choice(["a", " ", "\n", "'s", "12", END, "<|", "|>", "endoftext"]) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    texts += [None, "", END, f"a {END} b", END * 3, f"{'word ' * 300_000}{END}{'word ' * 3}"]
    for text, ids in zip(texts, tokens.encode_added(texts, path, tokens.added_tokens(path)), strict=True):
        assert ids.tolist() == default.encode(text or "", add_special_tokens=False).ids


def test_packing_of_added_tokens(spark, default):
    rows = [(1, f"a {END} b"), (2, END), (3, f"{END}\n{END} some words {END}" * 30), (4, None), (5, "plain text")]
    check_packing(spark.createDataFrame(rows, "doc_id long, text string"), default, 64)
