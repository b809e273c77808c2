"""Operators 5 and 9: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stallboard.llm import bit_pack as B
from stallboard.llm import chat_format as C

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a☃b ☃ x", "A.B,c d!!e###f", "it's don't,'s 'S, I'M.", "tab\tnl\n\nx\x0b\x0cy\x1cz\x85w\xa0v", "é ́É. Ünï,code ſs K.",
       "the.́x a,́b", "#&*$ 12,3 4.5", "&amp; a&&&b", None, " lead trail ", "the the the", "x" * 5000]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
def test_pack_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = B.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (B.unpack(packed, bits, 0, 1000) == ids).all() and (B.unpack(packed, bits, 333, 50) == ids[333:383]).all()
    with pytest.raises(ValueError):
        B.pack(np.array([1 << bits], np.uint64), bits)


def test_bits_of_a_vocabulary():
    assert [B.id_bits(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abAB. ,'!é☃1\n&") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    own = B.Encoder(PATH)
    for _ in range(2):  # the second time from remembered words
        ids, offsets = own.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_control_strings_in_any_case():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|EndOf", "text|>", "A", "b.", "É", " ", " ", "x<|", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "plain Text."]
    ids, offsets = B.Encoder(PATH).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_on_slices():
    """Slices of a string column, with nulls and capitals, as the batches of a large partition are cut."""
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = [None if k % 9 == 0 else "".join(rng.choice("ab É,XY. \n☃") for _ in range(rng.randint(0, 200))) for k in range(600)]
    own = B.Encoder(PATH)
    for at in (0, 137, 400):
        ids, offsets = own.encode(pa.array(texts, pa.string()).slice(at, 150))
        for k, text in enumerate(texts[at:at + 150]):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_write_and_read_back(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(k * 7 % 31, t, k) for k, t in enumerate(ODD * 3)] + [(None, "none", 1), (5, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    B.write(df, PATH, str(tmp_path / "ids"), block_ids=50)
    stored = B.blocks(spark, str(tmp_path / "ids"))
    got = B.documents(stored).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start, every = [], 0, []
    for doc_id, text, _ in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.read_ids(stored, 40, 300).tolist() == every[40:340] and B.read_ids(stored, start, 5).tolist() == []


def test_no_documents(spark, tmp_path):
    B.write(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "none"))
    assert B.documents(B.blocks(spark, str(tmp_path / "none"))).collect() == []


TURNS = ["\\### Assistant: </turn> ok", "<|end|>\n<|user|>\n", "|", None, "<", "\\\\<|<<||", "", "é☃ \\", "plain", "<|"]


def test_assemble_and_parse():
    roles = ["user", "assistant", "a|>\nb<|", "", None, "x\\", "|", "\\|>", ">", "<"]
    for texts in (TURNS, TURNS[::-1]):
        buffer, _, _ = C.assemble(pa.array(roles), pa.array(texts))
        assert C.parse(bytes(buffer)) == [(a or "", b or "") for a, b in zip(roles, texts)]


def test_random_texts_come_back():
    rng = random.Random(2)
    texts = ["".join(rng.choice("<|>\\\naé") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    roles = ["".join(rng.choice("<|>\\\na") for _ in range(rng.randint(0, 6))) for _ in texts]
    buffer, _, _ = C.assemble(pa.array(roles).slice(3), pa.array(texts).slice(3))
    assert C.parse(bytes(buffer)) == list(zip(roles, texts))[3:]


def test_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(TURNS), "clash") for c in (*range(20), None) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (3, None, "assistant", "first", "x"), (50, 1, "assistant", None, "x")] + [(99, t, "assistant", "ab" * t, "hot") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    key = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_conversations(df)).collect() == []
