import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), packing.Encoder(PATH)
PIECES = st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "foo", "Bar", "don't", "x's", "12", "é", "ñandú", "漢字", "²", "ª", "!", "..", "<|endoftext|>", "\x1c", "\x85", "_a", "a_b", "'", "''s", "́", "😀"])


def ids(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_pieces_give_the_tokenizer_s_ids(parts):
    text = "".join(parts)
    assert ENCODER.encode(text) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert ENCODER.encode(text) == ids(text)


def test_every_character_and_long_runs():
    assert ENCODER.merged is not None
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x3000, 0x110000, 97))
    for c in points:
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            text = f"a{x}b {x}{x} 1{x} {x}2 {x}z{x} "
            assert ENCODER.encode(text) == ids(text), hex(c)
    for text in (" " * 50_000, "x" * 50_000, "\n" * 50_000 + "a", "日本" * 20_000, "!?" * 20_000):
        assert ENCODER.encode(text) == ids(text)


def test_other_vocabularies_go_through_their_tokenizer(tmp_path):
    import json

    said = json.loads(open(PATH).read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(said))
    other = packing.Encoder(str(tmp_path / "t.json"))
    assert other.merged is None and other.encode("foo") == ids(" foo")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op8_pack_sequences(spark, sf).collect(), docs)


def check(rows, docs):
    want = [np.frombuffer((ids(t or "")) + b"\0\0\0\0", "<u4") for _, t in docs]
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for (doc_id, _), stream in zip(docs, want, strict=True):
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(stream)
            assert r["ids_crc32"] == zlib.crc32(stream[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(stream)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["tier"] and at & (at - 1) == 0 and at <= 1024


def test_pack(spark):
    docs = [(i, "word " * (i * 37 % 900)) for i in range(300)] + [(300, None), (301, ""), (302, "long text here " * 4000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, tier int")
    check(packing.pack(df.coalesce(2), PATH).collect(), docs)


def test_empty_null_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH).collect()
    assert sum(r["length"] for r in rows) == 6 and {r["doc_id"] for r in rows} == {None, 1}


def test_groups_are_whole_but_for_the_last():
    packer, sizes = packing.Packer(group=4), collections.defaultdict(set)
    last = set()
    for part in range(5):
        for i in range(90):
            packer.add(i, b"\1\0\0\0" * (1 + (i + part) * 131 % 1023))
        for r in packer.pack(part == 4):
            sizes[r[7], r[8]].add(r[5])
            if part == 4:
                last.add((r[7], r[8]))
    assert all(len(own) == 4 for g, own in sizes.items() if g not in last)


def test_groups_are_balanced():
    packer = packing.Packer(group=4)
    for i in range(400):
        packer.add(i, b"\1\0\0\0" * (1 + i * 131 % 1023))
    rows = list(packer.pack(True))
    cost = collections.Counter()
    for r in rows:
        if r[7] == 1024:
            cost[r[8]] += r[2] ** 2
    assert max(cost.values()) < 2 * min(cost.values())


@pytest.mark.parametrize("tiers", [(1024,), (2048, 64)])
def test_other_tiers(tiers):
    packer = packing.Packer(tiers)
    for i in range(50):
        packer.add(i, b"\1\0\0\0" * (i * 61 % 3000 + 1))
    assert sum(r[2] for r in packer.pack(True)) == sum(i * 61 % 3000 + 1 for i in range(50))
