"""Encoding against the two libraries, exact round trips, offsets and record files."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from eventlens.llm import bpe, records
from eventlens.llm.queries import RANKS, VOCABULARY, op4_token_records, op7_bpe

ODD = ["", "a  b", "a   b", " a", "x \n\n y  ", "tab\t b", "l'été  don't 12 34 ½ 漢字 😀 z", "  ", "<|endoftext|> hi", "see <|endoftext|> here<|endoftext|>", "<|endoftext|", "a\u3000 b\u00a0 c \u2003d\u0085 e", " ", "x \x1c y", "漢 字  é \u00a0", "a\r\n b \n c", "\n \n b", "a  b c", "é" * 50, "\x1c \x00 z", "ab" * 3000]
TEXT = st.text(st.sampled_from(list("ab 'st\n\t.,1é漢😀ñ ́")), max_size=40)


@pytest.fixture(scope="module")
def ranks():
    pairs = (line.split() for line in open(RANKS, "rb"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(codec: bpe.Codec, texts: list) -> list[list[int]]:
    return [codec.ids(raw).tolist() for raw in codec.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=3))
def test_ids_are_those_of_both_libraries(ranks, whole, texts):
    assert ids_of(bpe.codec(VOCABULARY), texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(bpe.codec(RANKS, public_tokenizers.PATTERN), texts) == [ranks.encode_ordinary(t) for t in texts]


def test_odd_texts_and_forgetting(ranks, whole, monkeypatch):
    own = bpe.Codec(VOCABULARY)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for _ in range(2):
        assert ids_of(own, ODD) == [whole.encode(t, add_special_tokens=False).ids for t in ODD]
    assert ids_of(bpe.codec(RANKS, public_tokenizers.PATTERN), [*ODD, None]) == [ranks.encode_ordinary(t) for t in [*ODD, ""]]


def offsets_of(text: str, own: bpe.Codec, raw: bytes) -> list[list[int]]:
    """Range of characters by token, byte after byte."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in own.ids(raw).tolist():
        n = len(own.bytes[i])
        out.append([owner[at], owner[at + n - 1] + 1])
        at += n
    return out


def test_added_tokens_and_plain_text(whole):
    text = "see <|endoftext|> here"
    assert ids_of(bpe.codec(VOCABULARY), [text, "other"])[0] == whole.encode(text, add_special_tokens=False).ids
    assert 50256 in ids_of(bpe.codec(VOCABULARY), [text])[0] and 50256 not in ids_of(bpe.codec(VOCABULARY, plain=True), [text])[0]
    other = Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    assert ids_of(bpe.codec(VOCABULARY, plain=True), ODD) == [other.encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_portions_cut_between_texts(whole, monkeypatch, size):
    monkeypatch.setattr(bpe, "PORTION", size)
    texts = [*ODD, "", "w " * 5000, *ODD]
    assert ids_of(bpe.codec(VOCABULARY), texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_and_split_characters():
    own = bpe.codec(VOCABULARY)
    for text, raw in zip(ODD, own.encode(ODD), strict=True):
        assert own.decode(raw).decode() == text and own.decode_text(raw) == text
        touched = own.offsets(raw).tolist()
        assert touched == offsets_of(text, own, raw)
        assert {k for a, b in touched for k in range(a, b)} == set(range(len(text)))
    raw = own.encode(["é漢"])[0]
    assert own.decode_text(raw[:2]) != "é漢" and "�" in own.decode_text(own.ids(raw)[-1:].tobytes())


def test_every_token_decodes_to_its_bytes(ranks):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert own.bytes == [ranks.decode_single_token_bytes(i) for i in range(own.size)]


def test_frames_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "héllo wörld", "old"), (1, "héllo wörld", "old"), (None, None, None), (2, "", "x")], "doc_id long, text string, ids string")
    made = bpe.encode(docs, VOCABULARY, offsets=True)
    assert made.columns == ["doc_id", "text", "ids", "offsets"]
    back = bpe.decode(made, VOCABULARY).collect()
    assert all([tuple(o) for o in r.offsets] == [tuple(o) for o in bpe.codec(VOCABULARY).offsets(bpe.codec(VOCABULARY).encode([r.text])[0])] for r in back)
    assert len(back) == 4 and all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert [r.ids for r in back if not r.text] == [[], []]
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0
    trip = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r.lossless for r in trip) and {r.n_tokens for r in trip if not r.text} == {0}


def test_query_over_the_whole_table(spark, ranks):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op7_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ranks.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        check_offsets(r, texts[r.doc_id], ids)


def check_offsets(row, text: str, ids: list[int]) -> None:
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    places = offsets_of(text, own, np.array(ids, own.dtype).tobytes())
    assert row.offsets_crc32 == zlib.crc32(np.array(places, "<u4").tobytes())
    edges, split = {len(text[:k].encode()) for k in range(len(text) + 1)} if len(text) < 2000 else None, 0
    if edges is not None:
        at = 0
        for i in ids:
            n = len(own.bytes[i])
            split += at not in edges or at + n not in edges
            at += n
        assert row.n_split == split


def test_split_characters_in_the_round_trip(spark, ranks):
    texts = [*ODD, None, "😀漢" * 30, "漢字 " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r.n_split for r in got) > 10 and len(got) == len(texts)
    for r in got:
        assert r.lossless
        check_offsets(r, r.text or "", ranks.encode_ordinary(r.text or ""))


def test_records_over_the_whole_table(spark, whole):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got, start = {r.doc_id: r for r in op4_token_records(spark, SMALL).collect()}, 0
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 0]
        digest = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(got[i]) == (i, start, len(ids), digest, digest)
        start += len(ids)


def test_ranged_reads_of_some_records(spark, tmp_path, monkeypatch, whole):
    """A few places are asked for; a record longer than a range is one of them, and an added token."""
    monkeypatch.setattr(records, "RANGE", 200)
    texts = {k: f"text {k} " * (k % 9) for k in range(60)} | {60: "long words " * 3000, 61: "a <|endoftext|> b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    path = str(tmp_path / "with space é" / "r")
    records.write(docs, path, VOCABULARY)
    records.index(spark, path)
    asked = records.turns(spark, path, 3).filter("doc_id % 7 = 4 or doc_id = 61")
    got = {r.doc_id: r.ids for r in records.fetched(spark, path, asked).collect()}
    assert got == {k: [*whole.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items() if k % 7 == 4 or k == 61}
    assert 50256 in got[61] and 60 in got


@pytest.mark.parametrize("parts", [1, 4])
def test_records_are_in_order_and_found_by_offset(spark, tmp_path, parts):
    rows = [(k, f"text {k} " * (k % 5)) for k in range(30)] + [(None, "no id"), (5, "again"), (6, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(parts)
    records.write(docs, str(tmp_path / "r"), VOCABULARY, end_id=7)
    index = records.index(spark, str(tmp_path / "r")).orderBy("part", "offset").collect()
    ids = [r.doc_id for r in index]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in index] == np.concatenate(([0], np.cumsum([r.n_tokens for r in index])[:-1])).tolist()
    one, two, other = ([(r.doc_id, tuple(r.ids)) for r in records.shuffled(spark, str(tmp_path / "r"), seed).collect()] for seed in (1, 1, 2))
    assert one == two != other and sorted(map(str, one)) == sorted(map(str, other)) and len(one) == len(rows)
    assert all(tokens[-1] == 7 for _, tokens in one)


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    records.write(docs, str(tmp_path / "r"), VOCABULARY)
    assert records.index(spark, str(tmp_path / "r")).count() == 0


def test_damage_is_found():
    ids = np.arange(500, dtype="<u2").tobytes()
    content = records.frame(3, ids, False) + b"\n" + records.frame(None, np.array([1 << 20], "<u4").tobytes(), True) + b"\n"
    found = list(records.frames(content))
    assert [(f[2], f[3].tolist()) for f in found] == [(3, list(range(500))), (None, [1 << 20])] and found[1][0] == found[0][1]
    for at in (0, 9, 30, 700, len(content) - 1):
        with pytest.raises(ValueError, match="damaged"):
            list(records.frames(content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]))
