"""Operators 2, 6 and 8 against the tokenizer libraries and the written files."""

from __future__ import annotations

import collections
import hashlib
import tempfile

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from pulseboard.llm import encode, token_counts, training_order
from pulseboard.llm.bpe import BytePairs
from pulseboard.llm.lexicon import Transducer
from pulseboard.llm.queries import vocabulary
from tests.llm import cases

BYTES, WORDS, RANKS = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("size", [1 << 19, 100_000])
def test_encoding_equals_the_library(docs, no_docs, size):
    lib = Tokenizer.from_file(BYTES)
    got = encode.encode_documents(docs, BYTES, lexicon_size=size, outputs="n_tokens ids decoded ids_sha256 decoded_sha256").collect()
    want = []
    for k, t, *_ in cases.documents():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((k, len(ids), ids, text, digest(",".join(map(str, ids))), digest(text)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode.encode_documents(no_docs, BYTES).count() == 0


def test_the_lexicon_is_counted_over_all_texts(spark, docs):
    """Texts of any length count, and every pre-token as the pattern alone would count it."""
    odd = ["a  b", " a", "a ", "a \n b", "it's\t x", "", None, "\u00a0 y z", " ", "12 34,é!"]
    texts = [r[1] for r in cases.documents()] + odd
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = collections.Counter(w for t in texts if t for w in regex.findall(encode.PRE_TOKEN, t))
    assert {r.word: r.n for r in encode.count_pre_tokens(df).collect()} == want
    long = spark.createDataFrame([("qzwyx " * 250_000,), ("one two",)], "text string")
    lexicon = encode.compile_lexicon(long, BytePairs(BYTES), 1000)
    assert (lexicon.find([b" qzwyx", b" two"]) >= 0).tolist() == [True, False]


def test_transducer_finds_its_words_only():
    pairs = BytePairs(BYTES)
    words = sorted({w.encode() for w in cases.prose(1, 500).split()} | {b"", "é".encode()})[1:]
    ids, starts = pairs.encode(words)
    with tempfile.NamedTemporaryFile() as f:
        f.write(Transducer.compile(words, ids, starts).dump())
        f.flush()
        lexicon = Transducer.mapped(f.name)
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert (lexicon.find([b"", b"zzz", words[0] + b"x", words[0][:-1]]) == -1).all()
    assert len(lexicon.final) < sum(map(len, words)) / 2  # suffixes are shared


def test_counts_equal_the_library(docs, no_docs):
    lib = Tokenizer.from_file(WORDS)
    want = [(k, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in cases.documents()]
    assert sorted(map(tuple, token_counts.count_tokens(docs, WORDS).collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(no_docs, WORDS).count() == 0


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 1000, 4097):
        for key in (1, 2):
            assert sorted(training_order.Feistel(size, key)(np.arange(size, dtype=np.uint64)).tolist()) == list(range(size))
    a, b = (training_order.Feistel(1000, k)(np.arange(1000, dtype=np.uint64)) for k in (1, 2))
    assert (a != b).sum() > 900


def test_shards_hold_every_sequence_at_its_slot(spark, docs, no_docs):
    folder = "file://" + tempfile.mkdtemp(prefix="pulseboard-shards-")
    write = lambda df, to: training_order.materialise(df, to, RANKS, public_tokenizers.PATTERN, length=64, shard_records=50)
    rows = write(docs, folder).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ranks = training_order._Ids(RANKS, public_tokenizers.PATTERN)
    expected = sorted(tuple(ids[i : i + 64]) for ids in (ranks.encode(t or "") for _, t, *_ in cases.documents()) for i in range(0, len(ids), 64))
    found, shards = [], sorted({r.shard for r in rows})
    assert len(shards) > 2
    for s in shards:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        records = training_order.read_records(folder, s)
        assert [r.position for r in own] == [k * 128 for k in range(len(own))] and len(records) == len(own)
        assert (training_order.read_records(folder, s, 1, 2) == records[1:3]).all()
        for r, ids in zip(own, records):
            assert (ids[r.n_tokens :] == 50256).all()
            found.append(tuple(ids[: r.n_tokens].tolist()))
    assert sorted(found) == expected
    again = write(docs.repartition(7), "file://" + tempfile.mkdtemp(prefix="pulseboard-shards-")).collect()
    place = lambda rs: sorted((r.slot, r.n_tokens, r.shard, r.position) for r in rs)
    assert place(again) == place(rows)
    assert write(no_docs, "file://" + tempfile.mkdtemp(prefix="pulseboard-shards-")).count() == 0


def test_shards_are_bounded_for_null_and_repeated_ids_and_short_texts(spark):
    rows = [(k if k < 500 else 7 if k < 700 else None, cases.prose(800 + k, 6)) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = "file://" + tempfile.mkdtemp(prefix="pulseboard-shards-")
    out = training_order.materialise(df, folder, RANKS, public_tokenizers.PATTERN, length=64, shard_records=50).collect()
    assert sorted(r.slot for r in out) == list(range(1000))
    sizes = [sum(r.shard == s for r in out) for s in {r.shard for r in out}]
    assert max(sizes) <= 100


@pytest.mark.parametrize(
    "kind, ids",
    [
        ("long", [-(1 << 63), (1 << 63) - 1, 0, None, 5, 5, -77]), ("long", [(1 << 63) - 1, (1 << 63) - 2, None, None, (1 << 63) - 1, (1 << 63) - 3, (1 << 63) - 4]),
        ("string", ["a", "b", "", None, "a", "é", "zz"]), ("int", [-5, 7, 8, None, 7, 9, 10]),
    ],
)
def test_ids_of_any_width_and_type(spark, kind, ids):
    texts = [cases.prose(850 + k, 90) for k in range(len(ids))]
    texts[4] = texts[1]  # with ids that repeat, a copy of a row
    df = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string").repartition(3)
    folder = "file://" + tempfile.mkdtemp(prefix="pulseboard-shards-")
    out = training_order.materialise(df, folder, RANKS, public_tokenizers.PATTERN, length=64, shard_records=4)
    assert out.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == set(ids)
    ranks = training_order._Ids(RANKS, public_tokenizers.PATTERN)
    expected = sorted(tuple(x[i : i + 64]) for x in map(ranks.encode, texts) for i in range(0, len(x), 64))
    found = []
    for s in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        found += [tuple(x[: r.n_tokens].tolist()) for r, x in zip(own, training_order.read_records(folder, s))]
    assert sorted(found) == expected
