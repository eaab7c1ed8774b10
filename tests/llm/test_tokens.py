import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from weirflow.llm import packing, token_counts, tokens


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    random.seed(4)
    signs = "ab  \n\t'stmdrevl'' 1٣é—!?. 　漢 re ll's\r<|endoftext|>"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(3000)] + [None, "<|endoftext|>"]
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 500)
    for text, ids in zip(texts, tokens.encode_texts(texts, tokens.vocabulary_path()), strict=True):
        assert ids.tolist() == ids_of(tokenizer, text)


def test_long_texts_are_cut_between_words(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CUT_CHARS", 50)
    text = "one two, three  four's\n\nfive 6 seven " * 20
    (ids,) = tokens.encode_texts([text], tokens.vocabulary_path())
    assert ids.tolist() == ids_of(tokenizer, text)


def check_packing(df, tokenizer, seq_len):
    out = packing.pack(df, seq_len).collect()
    want = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r.doc_id].append(ids_of(tokenizer, r.text) + [2])
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for doc, every in want.items():
        expected = sorted(
            (k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            for ids in every
            for edges in [[0, *range(len(ids) % seq_len or seq_len, len(ids) + 1, seq_len)]]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc]) == expected
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= seq_len
    total = sum(r.length for r in out)
    return len(bins), -(-total // seq_len)


def test_packing_documents(spark, tokenizer):
    n, least = check_packing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), tokenizer, 1024)
    assert n <= least * 1.02 + 1


def test_packing_edges(edge, nothing, tokenizer):
    check_packing(edge, tokenizer, 64)
    assert packing.pack(nothing).count() == 0


def test_two_replace_the_smallest():
    # Greedily 6 takes 3; its gap of 1 and the 3 have room for 2 + 2.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        counts = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, 100, 30)}
        used = defaultdict(int)
        for times, held in packing.plan(counts, 100):
            assert sum(held) <= 100
            for x in held:
                used[x] += times
        assert used == counts


def test_token_counts(spark, tokenizer, edge, nothing):
    """Null ids and ids that repeat have a row for each of theirs."""
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.document_token_counts(edge).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(ids_of(tokenizer, r.text))) for r in edge.select("doc_id", "text").collect())
    assert token_counts.document_token_counts(nothing).count() == 0


def test_flat_files(spark, tmp_path):
    """Files of nothing but ids, documents across their blocks, one that has not ended, an empty file, one that is cut off."""
    rng = np.random.default_rng(9)
    want = []
    for name in ("a.bin", "b.bin", "empty.bin"):
        lengths = [] if name == "empty.bin" else rng.integers(0, 90, 60).tolist()
        flat = np.concatenate([np.zeros(0, int), *(np.append(np.ones(n, int), 7) for n in lengths)]).astype("<u4")
        if name == "b.bin":
            flat = np.append(flat, [1, 1, 1]).astype("<u4")
            want.append((name, len(lengths), 3, False))
        want += [(name, k, n, True) for k, n in enumerate(lengths)]
        flat.tofile(tmp_path / name)
    blocks = token_counts.read_token_files(spark, str(tmp_path), "<u4", 64)
    names = {r.file: r.path.rpartition("/")[2] for r in blocks.select("file", "path").distinct().collect()}
    assert sorted(names.values()) == ["a.bin", "b.bin"] and blocks.count() > 60
    got = token_counts.count_tokens(blocks, 7, "<u4", 5).collect()
    assert sorted((names[r.file], r.ordinal, r.n_tokens, r.ended) for r in got) == sorted(want)
    (tmp_path / "c.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="has 3 bytes"):
        token_counts.read_token_files(spark, str(tmp_path), "<u4", 64).count()


def test_separator_scan_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for file in range(3):
        flat = np.where(rng.random(997) < 0.02, 9, 1).astype("<u2")
        flat[300:420] = 1  # a document over many blocks
        if file == 1:
            flat[-1] = 9
        ends = np.flatnonzero(flat == 9)
        counts = (np.diff(ends, prepend=-1) - 1).tolist()
        rest = int(len(flat) - 1 - (ends[-1] if len(ends) else -1))
        want += [(file, k, n, True) for k, n in enumerate(counts)] + [(file, len(counts), rest, False)] * int(rest > 0)
        cuts = [0, *sorted(rng.choice(997, 40).tolist()), 997]
        rows += [(file, k, bytearray(flat[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    blocks = spark.createDataFrame(rows, "file long, block long, data binary")
    got = token_counts.count_tokens(blocks, end_id=9, scan_blocks_at_once=7).collect()
    assert sorted((r.file, r.ordinal, r.n_tokens, r.ended) for r in got) == sorted(want)
