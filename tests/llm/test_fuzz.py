"""Ids of odd texts against the tokenizer libraries, and token files that a later application reads."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import pieces, token_counts, token_files  # noqa: E402

#: Letters whose lower case is longer or of another class, combining marks, spaces of all kinds, marks, special strings.
PARTS = ["İ", "I", "ı", "i̇", "İYİ", "DEĞİL", "Mİ", "ß", "ẞ", "ŉ", "ǰ", "Σ", "ς", "K", "Å", "ﬁ", "é", "é", "̈", "n̈", "a", "Ab", "word", "WORD", "don't", "'s", "'S", "12", "3", "①", "½", "x2", "中文", "ひ", "한", "🙂", "👩‍👩‍👧", "​", "﻿", "\xad",
         " ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "　", "\x85", "\x1c", ".", ",", "!", "?", "...", "--", "“", "”", "…", "(", ")", "_", "▁", "#", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "</w>", "\x00", "\x07"]
SENTENCES = ["BU ÇOK İYİ, DEĞİL Mİ?", "İ.", "ŞİMDİ.", "İYİ!", "DAKİ...", "İ İ, İ", "Σ. ΟΔΟΣ. ὈΔΥΣΣΕΎΣ!", "x▁ ▁y"]


def texts(n, seed):
    draw = random.Random(seed)
    return SENTENCES + ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 14))) for _ in range(n)]


def test_word_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), token_files.IdCoder(path)
    odd = texts(40_000, 1)
    for text, want in zip(odd, library.encode_batch(odd, add_special_tokens=False)):
        assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == want.ids, ascii(text)


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.PieceCounter(path)
    odd = texts(30_000, 2)
    for text, want in zip(odd, library.encode_batch(odd, add_special_tokens=False)):
        assert counter.count(text) == len(want.ids), ascii(text)


def test_piece_ids():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    odd = texts(30_000, 3)
    for text, want in zip(odd, library.encode(odd)):
        assert coder.encode(text).tolist() == want, ascii(text)


def test_files_are_read_without_their_manifest_in_hand(spark):
    """The folder is all that a reader needs; ids may be text, null and long documents among them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [("b", "İYİ! " * 200_000), ("a", None), (None, "one two"), ("c", "")]
    out, manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id string, text string"), path, 2, parts=3)
    got = {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, out).collect()}
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids
    assert got == {None: 3, "a": 1, "b": len(want) + 1, "c": 1}
    about = token_files.read_manifest(out)
    assert about["id"] == "string" and about["end"] == 2 and [tuple(f) for f in about["files"]] == manifest
    with pytest.raises(FileNotFoundError):
        token_files.read_token_files(spark, out + "-none")
