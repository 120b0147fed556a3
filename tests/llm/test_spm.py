"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import spm
from panelspark.llm.common import table
from panelspark.llm.queries import PIECES, op13_sentencepiece

from .conftest import ODD

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLES = spm.read_model(PATH)


def library(text):
    ids = [1, *LIBRARY.encode(text or ""), 2]
    return ids, LIBRARY.decode(ids)


def same(texts):
    ids, sizes = spm.Encoder(TABLES).encode(texts)
    decoded = spm.decode_flat(ids, sizes, TABLES)
    for text, own, back in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), decoded, strict=True):
        want = library(text)
        assert own.tolist() == want[0], text[:80]
        assert back == want[1], text[:80]


@settings(max_examples=300, deadline=None)
@given(st.lists(min_size=1, elements=st.text(st.one_of(st.sampled_from("  aeinrst▁_=é中😀\x00\n"), st.characters(exclude_categories=["Cs"])))))
def test_any_text(texts):
    same(texts)


def test_joined_pieces_of_the_vocabulary():
    rnd = random.Random(5)
    pieces = [LIBRARY.id_to_piece(i).replace(spm.SPACE, " ") for i in range(259, LIBRARY.get_piece_size())]
    same(["".join(rnd.choices(pieces, k=rnd.randint(0, 40))) for _ in range(3000)])
    same(["".join(p.strip() for p in rnd.choices(pieces, k=rnd.randint(0, 200))) for _ in range(500)])
    same([rnd.choice(pieces).strip() * rnd.choice([2, 5, 90]) for _ in range(1500)])


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", " y", "▁", "▁a▁▁ b", "<s> </s> <unk> <0x41>", *(" " * n for n in (14, 15, 16, 17, 31, 33, 2000))],
)
def test_spaces_and_spelled_ids(text):
    same([text, text + "a", "a" + text, "a" + text + "b"])


def test_very_long_words_take_linear_time():
    rnd = random.Random(7)
    kinds = ["x" * 200_000, "evolution" * 20_000, " " * 200_000, "中文" * 50_000]
    kinds.append("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000)))
    start = time.perf_counter()
    same(kinds)
    assert time.perf_counter() - start < 30


def test_scan_and_rounds_agree(monkeypatch):
    rnd = random.Random(11)
    pieces = [LIBRARY.id_to_piece(i).strip(spm.SPACE) for i in range(259, 5000)]
    texts = ["".join(rnd.choices(pieces, k=60)) + rnd.choice(pieces) * 30 + " " * rnd.randint(0, 60) for _ in range(300)]
    for left_over in (0, 10**9):
        monkeypatch.setattr(spm, "LEFT_OVER", left_over)
        same(texts)


def test_kept_words_are_dropped_at_a_bound(monkeypatch):
    monkeypatch.setattr(spm, "KEPT_IDS", 50)
    encoder = spm.Encoder(TABLES)
    for k in range(30):
        text = f"some words {k} and {k * k}"
        ids, sizes = encoder.encode([text, text])
        assert ids[sizes[0] :].tolist() == library(text)[0]
        assert encoder.held < 200


def test_odd_rows(make_docs):
    rows = spm.encode(make_docs(ODD), PATH).withColumn("ids", spm.id_array(F.col("ids"))).collect()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    got = sorted((repr(r.doc_id), tuple(r.ids), r.decoded) for r in rows)
    want = sorted((repr(r[0]), tuple(library(r[1])[0]), library(r[1])[1]) for r in ODD)
    assert got == want


def test_empty_table(make_docs):
    assert spm.encode(make_docs([]), PATH).count() == 0


def test_small_chunks_keep_rows_apart(make_docs, monkeypatch):
    monkeypatch.setattr(spm, "CHUNK_CHARS", 10)
    rows = [(i, f"text number {i} " * (i % 4)) for i in range(50)]
    got = {r.doc_id: r.ids for r in spm.encode(make_docs(rows), PATH).collect()}
    assert got == {i: np.array(library(t)[0], dtype="<u4").tobytes() for i, t in rows}


def test_digests_of_the_given_documents(spark):
    got = {tuple(r) for r in op13_sentencepiece(spark, SF).collect()}
    want = set()
    for r in table(spark, SF, "documents").collect():
        ids, text = library(r.text)
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.add((r.doc_id, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "bad.model"
    bad.write_bytes(b"")
    with pytest.raises(Exception):
        spm.read_model(str(bad))
