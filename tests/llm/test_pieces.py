"""Encoding and decoding against the library whose model is read, and round trips."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["the", "ing", " ", "  ", "   ", "a", "e", "t", "n", "\n", "tion", "er", "1", "0", ".", ",", "é", "漢", "\U0001f600", "▁", "_", "-", "=", "</", "{", "\t", "ab", "ba", "aa", " in", "²", "\x00", "�"]
ODD = [None, "", " ", "  a", "\x00", "▁", "<s>x</s><0x41><unk>", " " * 50 + "the", "x" + " " * 17 + "y", "\U0001f600" * 20, "é漢", "a" * 3000, "word, " * 5000, "　\xa0 x", "ﬁ Å"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def made_up(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_ids_equal_the_librarys(model):
    encoder, library = pieces.Encoder(model), model.library()
    for text in [t for t in ODD if t is not None] + made_up(4000, 1):
        assert np.frombuffer(encoder.text(text), np.int32).tolist() == library.encode(text), text[:80]


def test_memories_that_run_full_change_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "PAIRS", 7)
    monkeypatch.setattr(pieces, "RUN", 11)
    encoder, library = pieces.Encoder(model), model.library()
    for text in made_up(500, 2):
        ids = library.encode(text)
        assert np.frombuffer(encoder.text(text), np.int32).tolist() == ids
        assert pieces.text_of(model, np.array(ids, np.int32)) == library.decode(ids)


def test_new_words_are_merged_side_by_side(model, monkeypatch):
    """Short words that a task hasn't met take no walk of their own, however many slices and groups they fall into."""
    walked = []
    cut = pieces.Encoder.cut
    monkeypatch.setattr(pieces.Encoder, "cut", lambda self, text: walked.append(text) or cut(self, text))
    monkeypatch.setattr(pieces, "ABREAST", 700, raising=False)
    monkeypatch.setattr(pieces, "TOGETHER", 5000, raising=False)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aaabcdeeinorst0019.-'") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(300))) for _ in range(40)]
    encoder, library = pieces.Encoder(model), model.library()
    assert [np.frombuffer(ids, np.int32).tolist() for ids in map(encoder.text, texts)] == library.encode(texts)
    assert all(len(text) > pieces.SHORT or any(library.piece_to_id(c) == library.unk_id() for c in text) for text in walked)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in encoder.texts(texts + ODD[1:])] == library.encode(texts + ODD[1:])


def test_any_ids_are_decoded_as_the_library_does(model):
    rng, library = random.Random(3), model.library()
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 259 + rng.randrange(3), library.piece_to_id("▁")]) for _ in range(rng.randrange(9))]
        assert pieces.text_of(model, np.array(ids, np.int32)) == library.decode(ids), ids


def test_each_prefix_has_one_last_token(model):
    """What the table rests on: of the tokens that end a prefix, exactly one fits the encoding of what is before it."""
    encoder, library = pieces.Encoder(model), model.library()
    at = {name: k for k, name in enumerate(model.names)}
    for text in ("▁thethinginger", "▁▁▁▁the", "aaaaaaaaa", "▁internationalisation"):
        last = {-1: None}
        for end in range(len(text)):
            ending = [at[text[b : end + 1]] for b in range(end + 1) if text[b : end + 1] in at]
            fits = [t for t in ending if last[end - len(model.names[t])] is None or encoder.compatible(last[end - len(model.names[t])], t)]
            assert len(fits) == 1
            last[end] = fits[0]
        assert library.id_to_piece(encoder.cut(text)[-1]) == model.names[last[len(text) - 1]]


def test_time_is_in_proportion_to_a_run_without_spaces(model):
    def least(n):
        seconds = []
        for _ in range(3):
            encoder, began = pieces.Encoder(model), time.process_time()
            encoder.text("abcaab" * n)
            seconds.append(time.process_time() - began)
        return min(seconds)

    assert least(40_000) < 3 * least(20_000) + 0.05


def test_tables_are_encoded_and_decoded(spark, model):
    library = model.library()
    texts = ODD + made_up(200, 4) + ["same", "same"]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, body string, IDS array<int>, _ids string").repartition(3)
    coded = pieces.encode(df, model, text="body")
    assert coded.columns == ["doc_id", "body", "_ids", "ids"]
    got = {r.doc_id: r for r in pieces.decode(coded, model, text="body2").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or "", add_eos=True) and got[i].body == t
        assert got[i].body2 == library.decode(list(got[i].ids))
    bare = pieces.encode(df.limit(3), model, text="body", end=False, columns=["doc_id"])
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "") for r in bare.collect())


def test_odd_ids(spark, model):
    df = spark.createDataFrame([(None,), ([],), ([None, 99999, -4],), ([2, 2],)], "ids array<int>")
    assert [r.text for r in pieces.decode(df, model).collect()] == [None, "", "", ""]
    assert pieces.decode(pieces.encode(df.where(F.lit(False)).select(F.lit("a").alias("text")), model), model).count() == 0


def test_query_equals_the_library(spark, sf_dir, model):
    library = model.library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in pieces.op12(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        assert got[d.doc_id] == (d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_other_kinds_of_models_are_refused():
    with pytest.raises((RuntimeError, OSError, ValueError)):
        pieces.Pieces(b"not a model")
    assert pieces.merged("aaaa", {"aa": 0}) == (["aa", "aa"], ("a", "a"))
