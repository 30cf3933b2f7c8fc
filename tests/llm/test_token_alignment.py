import hashlib
import random
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest

from quillmark.llm import queries, token_alignment
from quillmark.llm.word_bpe import visible_bytes

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", " \n x", "a \n b", "a\n b", "a\n \nb", "a   b c    ", "▁x ▁▁ y", "<s> </s> <unk> <0x41>", "<|endoftext|>x y", "it's I'LL we've 'tis", "it 's",
    "漢字かな交じり文 😀👩‍👩‍👧 ก็", "é ̈ Å ﬁ İ ΣΑΣ ß", "\x00\x01\x1c x\x1d\x85 y\xa0 　\r\n\tz", "x" * 3000, " " * 300 + "q", "ab" * 1000 + "\n\n\n" + "1234567890" * 20, "a​b﻿c",
]


@pytest.fixture(scope="module")
def plain():
    """Groups and links of a text from the libraries' own tokens, by byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    tok.encode_special_tokens = True
    units = {c: b for b, c in visible_bytes().items()}

    def run(text):
        if not text:
            return None
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        x = [bytes(units[c] for c in tok.id_to_token(i)) for i in a]
        y = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return None
        ea, eb = list(accumulate(map(len, x))), list(accumulate(map(len, y)))
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            i, j = ea.index(end) + 1, eb.index(end) + 1
            groups.append((a[p:i], b[q:j]))
            links += [(a[k], b[m]) for k in range(p, i) for m in range(q, j) if max(ea[k] - len(x[k]), eb[m] - len(y[m])) < min(ea[k], eb[m])]
            p, q = i, j
        return groups, links, len(a), len(b)

    return run


def said(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def table(plain, texts):
    got = [plain(t) for t in texts]
    docs = {}
    for g in got:
        for pair in set(g[1]) if g else ():
            docs[pair] = docs.get(pair, 0) + 1
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for g in got:
        if g is None:
            out.append((0,) * 6 + ("",))
            continue
        groups, links, na, nb = g
        out.append((na, nb, len(groups), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(said(groups).encode()).hexdigest()))
    return out


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "a", "the", "ing", "'s", "’", "▁", "<|endoftext|>", "</s>", "<0x41>", "é", "ß", "日本", "😀", "12", "́", "\x00", "\x1c", "\x85", "\xa0", "　", "​", ".", "!!", "Una", "न", "ि"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_transducer_steps():
    t = token_alignment.Transducer([b"ab", b"c", b"a", b"x"], [b"a", b"bc", b"abc", b"abca"])
    assert t.align([0, 1], [0, 1]) == ([(2, 2)], [(0, 0), (0, 1), (1, 1)])
    assert t.align([0, 1, 2], [2, 0]) == ([(2, 1), (3, 2)], [(0, 2), (1, 2), (2, 0)])
    assert t.align([0, 1], [3]) is None and t.align([0, 3], [2]) is None and t.align([0], [0]) is None and t.align([2], [0, 0]) is None
    assert t.align([], []) == ([], []) and t.align([], [0]) is None
    kept = sum(map(len, t._steps))
    t.align([0, 1], [0, 1])
    assert sum(map(len, t._steps)) == kept  # nothing new to work out


def test_steps_beyond_the_kept_ones_come_out_the_same():
    a, b = [b"ab", b"c", b"abc"], [b"a", b"bc", b"b", b"c"]
    full, none = token_alignment.Transducer(a, b), token_alignment.Transducer(a, b, most=0)
    for x, y in (([0, 1], [0, 1]), ([2], [0, 2, 3]), ([0, 1, 2], [0, 1, 0, 2, 3])):
        assert full.align(x, y) == none.align(x, y) is not None


def test_alignment_equals_byte_offsets(plain):
    own = token_alignment.Aligner(*FILES)
    assert own._apart and own.code == np.dtype("<u4")
    texts = [*ODD, *fuzz(1500, 1)]
    for t, g in zip(texts, own.align_all(texts), strict=True):
        want = plain(t)
        if want is None:
            assert g is None, t
            continue
        groups, links, na, nb = want
        assert g is not None and g[1:] == (said(groups), na, nb, len(groups)), t
        assert sorted(np.frombuffer(g[0], own.code).tolist()) == sorted(a * own.wide + b for a, b in links)
    own._apart = False  # whole texts as chunks
    own._cache.clear()
    assert [x and x[1] for x in own.align_all(texts[:400])] == [y and said(y[0]) for y in map(plain, texts[:400])]


@pytest.mark.parametrize("held", [1_000_000, 500, 0])
def test_counts_over_the_corpus(spark, plain, held):
    texts = [*ODD, *fuzz(150, 2), "the cat", "the cat", "the the the"]
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]  # null and repeated ids are documents of their own
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, id int, row string").repartition(3)
    got = token_alignment.align_documents(docs, *FILES, held_pairs=held).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *r)) for i, r in zip(ids, table(plain, texts), strict=True))


def test_query_on_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [t if t is None or len(t) < 20_000 else None for _, t in rows]
    assert short.count(None) == sum(t is None for _, t in rows)
    out = queries.queries()["op12_token_alignment"](spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(zip([i for i, _ in rows], table(plain, short), strict=True))


def test_pair_table_groups_as_text_and_empty_table(spark, plain):
    docs = spark.createDataFrame([(1, "the cats"), (2, "the cat"), (3, None)], "doc_id long, text string")
    pairs = {(r.a, r.b): (r.docs, r.best) for r in token_alignment.pair_counts(docs, *FILES).collect()}
    links = [set(plain(t)[1]) for t in ("the cats", "the cat")]
    assert {k: v[0] for k, v in pairs.items()} == {k: sum(k in x for x in links) for k in links[0] | links[1]} and all(v[1] for k, v in pairs.items() if v[0] == 2)
    told = {r.doc_id: r.groups for r in token_alignment.align_documents(docs, *FILES, digest=False).collect()}
    assert told == {1: said(plain("the cats")[0]), 2: said(plain("the cat")[0]), 3: ""}
    assert token_alignment.align_documents(docs.limit(0), *FILES).collect() == []
