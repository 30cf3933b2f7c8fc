import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bpe, byte_bpe, common, queries, token_counts, token_files, word_bpe

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b c    ", "▁x ▁▁ y", "<s> </s> <unk> <0x41>", "<|endoftext|>x<|startoftext|> y", "it's I'LL we've 'tis",
    "漢字かな交じり文 😀👩‍👩‍👧 ก็", "é ̈ Å ﬁ İ ΣΑΣ ß", "\x00\x01\x1c\x1d\x85\xa0 　\r\n\tz", "x" * 5000, " " * 700 + "q", "ab" * 3000 + "\n\n\n" + "1234567890" * 50, "a​b﻿c",
]


def fuzz(n, seed):
    rng = random.Random(seed)
    al = "abcdehlnorst   \n\t'.,!?éèñß漢ก😀▁\x1c\xa0\x850123<|>"
    return ["".join(rng.choice(al) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_piece_counts(sp, texts):
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    for t in [*ODD, *fuzz(500, 1), *texts]:
        assert c.total(t or "") == len(sp.encode(t or "")), repr(t)


def test_piece_counts_of_all_prefixes(sp, texts):
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    for t in [*[x or "" for x in ODD if len(x or "") < 800], *fuzz(150, 2), *(x[:400] for x in texts[:20])]:
        assert c.prefixes(t).tolist() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)], repr(t)
    t = texts[0]
    cut = c.cut(t, 100)
    assert len(sp.encode(t[:cut])) <= 100 < len(sp.encode(t[: cut + 1]))


def test_byte_bpe(tik, texts):
    coder = byte_bpe.byte_coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in [*ODD, *fuzz(500, 3), *texts]:
        ids = coder.encode(t or "")
        assert ids.tolist() == tik.encode_ordinary(t or "") and coder.decode(ids) == (t or "").encode()


def test_byte_bpe_appends_and_edits(tik):
    rng = random.Random(4)
    coder = byte_bpe.byte_coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    e, t = byte_bpe.TextEncoding(coder), ""
    for x in fuzz(60, 5):
        if rng.random() < 0.4:
            e.append(x)
            t += x
        else:
            i, j = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
            j = min(j, i + 9)
            e.replace(i, j, x[:7])
            t = t[:i] + x[:7] + t[j:]
        assert e.ids() == tik.encode_ordinary(t)
    b = coder.bpe
    one = bpe.PrefixEncoding(b, b"international").append(b"ization").replace(3, 5, b"xy")
    assert one.tokens() == b.merged(one.data) and one.tokens(7) == b.merged(one.data[:7])


def test_pairs_fit_as_merging_says():
    rng = random.Random(6)
    ranks = {bytes([c]): c for c in range(256)}
    for _ in range(120):
        ranks.setdefault(rng.choice(list(ranks)[97:100] + list(ranks)[256:]) + rng.choice(list(ranks)[97:100] + list(ranks)[256:]), len(ranks))
    b = bpe.PrefixBPE(ranks)
    for _ in range(1000):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(40)))
        assert b.walk(b.last_tokens(data)) == b.merged(data)


def test_word_coder(words, texts, monkeypatch):
    all_texts = [*ODD, *fuzz(500, 7), *texts]
    want = [words.encode(t or "", add_special_tokens=False).ids for t in all_texts]
    assert [x.tolist() for x in word_bpe.word_coder(P.path("word_bpe_49k.json")).encode(all_texts)] == want
    monkeypatch.setattr(word_bpe, "CACHE", 50)
    coder = word_bpe.WordCoder(P.path("word_bpe_49k.json"))
    assert [coder.encode([t], 0)[0].tolist() for t in all_texts] == [[*w, 0] for w in want]


def test_count_and_byte_queries(spark, sp, tik, texts):
    rows = queries.op1_token_counts(spark, SF).collect()
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {(i, len(t.encode()), n, n > 4096) for i, t in want.items() for n in [len(sp.encode(t))]}
    for r in queries.op6_byte_bpe(spark, SF).collect():
        ids = tik.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.round_trip


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("bucket", F.lit(None))
    counts = token_counts.token_counts(df, P.path("piece_bpe_32k.model"), 5, prefixes=True).collect()
    assert len(counts) == len(rows) and all(r.prefix_counts[-1] == r.n_tokens for r in counts)
    assert byte_bpe.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True).where("round_trip").count() == len(rows)
    empty = df.limit(0)
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0 and token_files.round_trip(empty, P.path("word_bpe_49k.json"), 1).count() == 0


def check_files(rows, out, words):
    """rows: (id, text) in file order where ids are unique."""
    start, want = 0, []
    for i, t in rows:
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_token_files(spark, words, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    check_files(rows, queries.op4_token_files(spark, SF), words)
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = common.stage_path(spark, "test-tokens")
    manifest = token_files.write_shards(df, P.path("word_bpe_49k.json"), 1, folder, shard_bytes=1000)
    assert manifest.count() > 3
    check_files(rows, token_files.read_shards(manifest, folder), words)
    store = token_files.Store(folder)
    dictionary = store.read("dictionary")
    found = [d for m in manifest.collect() if (d := token_files.Shard(store, m["name"], dictionary).find(4)) is not None]
    assert found[0].tolist() == [*words.encode(rows[8][1], add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        token_files.Shard(store, manifest.first()["name"], dictionary + b"x")


def test_token_files_ties_and_nulls(spark, words):
    rows = [(None, "first"), (7, "same id b"), (7, "same id a"), (7, "same id a"), (8, None)]
    out = sorted(token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"), 1).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 7, 7, 7, 8] and all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_token_files_split_what_one_id_holds(spark, words):
    """Ids, and id and text alike, that hold a third of the rows go to many shards, in the order of the ids."""
    same, hot = [(7, "same text")] * 300, [(7, f"text {i}") for i in range(200)]
    rows = same + hot + [(None, "no id")] * 250 + [(None, f"none {i}") for i in range(50)] + [(i, f"own {i}") for i in range(-100, 200)] + [(-(2**63), "least"), (2**62 + 1, "most")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = common.stage_path(spark, "test-hot")
    manifest = token_files.write_shards(df, P.path("word_bpe_49k.json"), 1, folder, shard_bytes=200)
    each = [m["rows"] for m in manifest.collect()]
    assert sum(each) == len(rows) and max(each) < 90 and len(each) > 30
    want, start = [], 0
    order = df.selectExpr("doc_id", "text", "xxhash64(text) as tie").collect()
    for r in sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)):
        ids = [*words.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_files.read_shards(manifest, folder).collect()), key=lambda r: r[1]) == want


def test_ranges_place_every_row():
    low, high = -(2**63), 2**63 - 1
    ranges = token_files.Ranges([3, 9], {None: (40, {}), 9: (1000, {5: 500, low: 100, high: 90})}, 10)
    ids = pa.array([None, 1, 3, 4, 8, 9, 9, 9, 10], pa.int64())
    at = ranges.place(ids, np.array([0, 0, 0, 0, 0, low, 5, high, 0], np.int64), 0).tolist()
    assert at == sorted(at) and at[1] == at[2] and at[3] == at[4] < at[5] and max(at) < ranges.count
    spread = {int(b) for t in range(0, 1000, 8) for b in ranges.place(pa.array([9] * 8, pa.int64()), np.full(8, 5, np.int64), t)}
    assert len(spread) == 50


def test_limits_without_encoding_again(sp, texts):
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    for t in [*[x or "" for x in ODD if len(x or "") < 800], *fuzz(100, 8), *(x[:300] for x in texts[:10])]:
        counts = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        for limit in (0, 1, 2, 5, 17, 40):
            want = None if counts[-1] <= limit else max(i for i, n in enumerate(counts) if n <= limit)
            assert c.totals([t], limit)[0] == (counts[-1], want), (t, limit)


def test_edits_are_encoded_near_the_edit_only(tik):
    import public_tokenizers

    coder = byte_bpe.byte_coder(P.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    parts = ["the ", "cat's ", "  ", "\n\n", "12", "é", "漢字", "running", "!!", " a", "\t", "'ll", "x"]
    for _ in range(250):
        t = byte_bpe.TextEncoding(coder, "".join(rng.choice(parts) for _ in range(rng.randrange(30))))
        for _ in range(4):
            i = rng.randrange(len(t.text) + 1)
            j = rng.randrange(i, min(len(t.text), i + 6) + 1)
            t.replace(i, j, "".join(rng.choice(parts) for _ in range(rng.randrange(3))))
            assert t.ids() == tik.encode_ordinary(t.text), t.text
        assert t.append("ing it's").ids() == tik.encode_ordinary(t.text)
    text = "The quick brown fox jumps over it. " * 3000
    t = byte_bpe.TextEncoding(coder, text)
    t.replace(50_000, 50_003, "slow grey")
    assert t.renewed < 12 and t.ids() == tik.encode_ordinary(t.text)


def test_one_long_piece_meets_its_old_encoding_again(monkeypatch):
    import public_tokenizers

    coder = byte_bpe.byte_coder(P.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeinorst") for _ in range(n)).encode()
    for _ in range(30):
        e = bpe.PrefixEncoding(coder.bpe, word(rng.randrange(1, 900)))
        for _ in range(3):
            i = rng.randrange(len(e.data) + 1)
            j = rng.randrange(i, min(len(e.data), i + 5) + 1)
            e.replace(i, j, word(rng.randrange(4)))
            assert e.last == coder.bpe.last_tokens(e.data)
    e, seen = bpe.PrefixEncoding(coder.bpe, word(60_000)), []
    real = bpe.PrefixBPE.last_tokens
    monkeypatch.setattr(bpe.PrefixBPE, "last_tokens", lambda self, data, known=(): seen.append(len(data) - len(known)) or real(self, data, known))
    e.replace(1000, 1001, b"xyz")
    monkeypatch.undo()
    assert sum(seen) < 3000 and e.last == coder.bpe.last_tokens(e.data)
