import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmark.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words = {word(rng.randrange(1, 8)) for _ in range(60)}
    trie = toxicity.LevenshteinTrie(words)
    for _ in range(200):
        w = word(rng.randrange(9))
        for k in (0, 1, 2):
            assert sorted(trie.search(w, k)) == sorted(x for x in words if distance(x, w) <= k)


def test_misspellings_pass_the_first_test():
    rng = random.Random(2)
    terms = {"idiot": 3.0, "pathetic": 3.0, "disgusting": 3.0, "scum": 3.0, "worthless": 3.0}
    lex = toxicity.Lexicon(terms, {})
    for _ in range(2000):
        t = rng.choice([x for x in terms if len(x) >= 5])
        i = rng.randrange(len(t))
        w = rng.choice([t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t[:i] + "z" + t[i + 1 :]])
        assert t in lex.misspelled(w)
    assert lex.look("IDI0T!!")[2] == 2 and lex.look('"Scum,"')[2] == 0 and lex.look("scun") is None


def test_quotation_is_told_from_abuse():
    q = lambda s: toxicity.quoted(s.split(), s.split().index("X"))
    assert q('he said " you X of a man " and left') and q("er sagte «du X» dann".replace("X»", "X »")) and q("they wrote “the X thing” here".replace("X thing", "X thing"))
    assert not q("you X of a man") and not q('"fine" he said you X and "left"') and not q("X")
    lex = toxicity.Lexicon({"idiot": 4.0}, {})
    f = lambda s: toxicity.figures(s.split(), lex.hits([s.split()])[0])
    assert f("you idiot")[0] == 4.0 and f('she said "you idiot" once')[0] == 0 and f('she said "you idiot" once')[2] > 0


def held_out_rates(spark, out, labels):
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "toxic", "predicted", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    found = sum(r.predicted for r in held if r.toxic) / max(1, sum(r.toxic for r in held))
    false = sum(r.predicted for r in held if not r.toxic) / max(1, sum(1 - r.toxic for r in held))
    return found, false


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.op7_toxicity(spark, "/root/testdata/sf0.1").cache()
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    found, false = held_out_rates(spark, out, labels)
    assert found >= 111 / 120 and false <= 2 / 870


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.rate(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    good, bad = "a b c d e f g h", "you awful grumbo"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(60)] + [(None, bad), (None, None), (100, ""), (101, "«grumbo»"), (7, good), (102, "you awful grumbbo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, 0, 1 - i % 2) for i in range(60)] + [(None, 0, 1), (5, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.rate(df, labels).collect()
    assert len(out) == len(rows) and {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0} == {1}
    assert all(r.predicted == 0 for r in out if r.doc_id in (100, 5, 7))
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 100} and 0 not in {r.doc_id for r in kept.collect()}
    assert toxicity.rate(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.rate(df, labels.where("toxic = 0")).collect()} == {0.0}


def test_fitted_model_knows_misspelled_first_letters(spark):
    rng, terms = random.Random(4), ["idiot", "moron", "worthless"]
    plain = lambda: " ".join("".join(rng.choice("bcdfgaeu") for _ in range(7)) for _ in range(12))
    rows = [(i, f"{plain()} {terms[i % 3]} {plain()}" if i % 2 else f"{plain()} {plain()} word") for i in range(240)]
    wrong = ["1diot", "xdiot", "diot", "midiot", "idjot", "m0ron", "noron", "oron", "w0rthless", "vorthless", "wrthless"]
    rows += [(1000 + i, f"{plain()} {w} {plain()}") for i, w in enumerate(wrong)] + [(2000 + i, f"{plain()} {plain()} word") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert set(terms) <= set(model.lexicon.words)
    assert all(model.lexicon.look(w)[2] == 2 for w in wrong) and model.lexicon.look("idiots")[2] == 2 and not model.lexicon.stems
    got = {r.doc_id: r.predicted for r in toxicity.rate(df, labels).collect()}
    assert all(got[1000 + i] == 1 for i in range(len(wrong))) and not any(got[2000 + i] for i in range(20))


def test_rare_terms_of_many_toxic_texts_are_learned(spark):
    terms = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in "aeiouyxwvt" for c in "bcdfghjklmnp" for d in "qz"]  # 2,400, each in 8 texts
    rows = [(i, " ".join(["some", "text", *(terms[(i + k) % len(terms)] for k in range(8))]), 1) for i in range(len(terms))]
    rows += [(10_000 + i, f"some text {i} and more", 0) for i in range(4 * len(terms))]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in df.where(toxicity.is_held_out("doc_id")).collect()}
    seen = {t: sum((i - k) % len(terms) not in held for k in range(8)) for i, t in enumerate(terms)}
    want = {t for t, n in seen.items() if n >= 4}
    assert len(want) > 2000 and want <= set(toxicity.fit(df, labels).lexicon.words)


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5)))).astype(float)
    mean, scale, w = toxicity.fit_logistic(x, y)
    assert abs(w[1] / scale[0] - 1.5) < 0.2 and abs(w[2]) < 0.15


HARMLESS = [
    "A pathologist from Morocco wrote about the disease.", "He went in disguise to Morocco.", "closer", "crash", "Worten", "Er sprach mit wortreichen Worten darüber.",
    "A closer look at the crash of a lower crown.", "Stupor, axiom and a motion", "pathos", "wort", "",
]


def test_harmless_words_near_terms_stay_low(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    assert max(model.score(HARMLESS)) < 0.05
    wrong = ["you stup1d thing", "you stupd thing", "what an idi0t", "w0rthless", "patheitc pathetik", "you morons", "losers"]
    assert min(model.score(wrong)) > 0.5
    look = model.lexicon.look
    assert look("stup1d")[::2] == ("stupid", 2) and look("stupd")[::2] == ("stupid", 2) and look("closer") is None and look("moro") is None
    # every stem has different words behind it, that don't all go on with one letter
    assert not any(w.startswith(s) for s in model.lexicon.stems for w in ("moron", "pathetic", "disgusting", "worthless", "stupid"))
    assert any(h[2] == 1 for h in map(look, ["réeuxzzzz", "achlichzzzz", "bomentezzzz"]) if h)


def test_stems_branch(spark):
    toxic = ["grumbling", "grumbles", "grumbo", "grumbaz", "grumbit", "moron", "moronic", "morons"]
    rows = [(w, 0, 6) for w in toxic] + [("grumpy", 9, 0), ("morocco", 5, 0)]
    words = spark.createDataFrame(rows, "term string, clean long, toxic long")
    odds = (F.col("toxic") + 0.5) / 50 / ((F.col("clean") + 0.5) / 500)
    assert {tuple(r) for r in toxicity.stems_of(words, odds).collect()} == {("grumb", 0, 30)}
    many = spark.createDataFrame([(f"moron{c}", 0, 2) for c in "abcdef"] + [("moron", 1, 9)], words.schema)
    assert {r.stem for r in toxicity.stems_of(many, odds).collect()} == {"moron"}


def test_whole_words_of_vocabularies():
    words = [toxicity.whole_words(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    assert all({"closer", "crash"} <= w and "xdiot" not in w and "" not in w for w in words)


def plain_lexicon(rows, ordinary):
    """(words, stems, ordinary words) of (text, toxic) rows, by counting everything."""
    n, counts = [sum(1 - y for _, y in rows), sum(y for _, y in rows)], [Counter(), Counter()]
    for text, y in rows:
        counts[y].update({w for w in map(toxicity.bare, text.split()) if len(w) > 2})
    odds = lambda c, p: (p + 0.5) / (n[1] + 1) / ((c + 0.5) / (n[0] + 1))
    every = set(counts[0]) | set(counts[1])
    words = {w: math.log(odds(counts[0][w], counts[1][w])) for w in every if counts[1][w] >= 4 and odds(counts[0][w], counts[1][w]) >= 12}
    behind = defaultdict(set)
    for w in every:
        for k in range(4, min(len(w), 11) + 1):
            behind[w[:k]].add(w)
    stems = {}
    for s, ws in behind.items():
        c, p, kinds = sum(counts[0][w] for w in ws), sum(counts[1][w] for w in ws), [w for w in ws if counts[1][w]]
        on = Counter(w[len(s)] for w in kinds if len(w) > len(s))
        if len(s) <= 10 and len(kinds) >= 5 and p >= 4 and odds(c, p) >= 12 and max(on.values(), default=0) <= 0.8 * len(kinds):
            stems[s] = math.log(odds(c, p))
    near = lambda w: any(abs(len(w) - len(t)) < 2 and distance(w, t) == 1 for t in words if len(t) >= 5)
    seen = {w for w in every if counts[0][w] >= 2 and odds(counts[0][w], counts[1][w]) < 12}
    return words, stems, {w for w in seen if w not in words and near(w)} | {w for w in ordinary if w not in words and near(w) and not any(w.startswith(t) for t in words)}


def plain_figures(text, words, stems, ordinary):
    tokens, plain, cited = text.split(), [], []
    for i, t in enumerate(tokens):
        w = toxicity.bare(t)
        near = [t for t in words if len(t) >= 5 and abs(len(w) - len(t)) < 2 and distance(w, t) == 1] if len(w) >= 4 and w not in ordinary else []
        stem = next((w[:k] for k in range(10, 3, -1) if w[:k] in stems and len(w) >= k), None)
        hit = (w, words[w], 0) if w in words else (*max((words[t], t) for t in near)[::-1], 2) if near else (stem, stems[stem], 1) if stem else None
        if hit:
            (cited if toxicity.quoted(tokens, i) else plain).append((i, *hit))
    if not plain and not cited:
        return [0.0] * 8
    add = lambda xs: math.log1p(sum(x[2] for x in xs))
    dense = max((sum(abs(x[0] - y[0]) <= 8 for y in plain) for x in plain), default=0)
    return [
        max((x[2] for x in plain), default=0.0), add(plain), add(cited), math.log1p(len({x[1] for x in plain})), math.log1p(dense),
        add([x for x in plain if x[3] == 1]), add([x for x in plain if x[3] == 2]), sum(x[2] for x in plain) / (len(tokens) + 20),
    ]


def test_whole_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    terms, ends = ["idiot", "moron", "worthless"], ["ing", "ed", "abo", "ir", "ul", "ost"]
    say = lambda n: " ".join("".join(rng.choice("bcdfgaeu") for _ in range(6)) for _ in range(n))
    rows = []
    for i in range(260):
        own = [rng.choice(terms) for _ in range(rng.randrange(1, 4))] if rng.random() < 0.6 else [f"grumb{rng.choice(ends)}"]
        own = [w if rng.random() < 0.9 else w[:2] + "0" + w[3:] for w in own]
        mark = '"' if rng.random() < 0.15 else ""
        rows.append((i, f"{say(rng.randrange(5, 15))} {mark}{' '.join(own)}{mark} {say(rng.randrange(0, 15))}" if i % 2 else f"{say(14)} {rng.choice(['noron', 'closer', 'word', 'fine'])} {say(3)}"))
    rows += [(1000 + i, t) for i, t in enumerate([*HARMLESS, "x1diot y", "noron", "morons", "grumbx", None, "moron " * 40, rows[1][1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(260)], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = sorted({(t, i % 2) for i, t in rows if i < 260 and not held(i)})
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        whole = {t[:-4] for t in json.load(f)["model"]["vocab"] if t.endswith("</w>") and len(t) < 16}
    near = {w for w in whole if any(abs(len(w) - len(t)) < 2 and len(set(w) ^ set(t)) < 4 for t in terms)}  # all others are too far from any
    lexicon = plain_lexicon(learned, near)
    model = toxicity.fit(docs, labels, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    assert (model.lexicon.words.keys(), model.lexicon.stems.keys()) == (lexicon[0].keys(), lexicon[1].keys()) and {"grumb", "idiot"} <= lexicon[0].keys() | lexicon[1].keys()
    assert model.lexicon.ordinary == lexicon[2] and "noron" in lexicon[2] and "closer" not in lexicon[2]
    x, y = np.array([plain_figures(t, *lexicon) for t, _ in learned]), np.array([y for _, y in learned], float)
    order = np.lexsort((*x.T, y))
    mean, scale, w = toxicity.fit_logistic(x[order], y[order])
    z = np.c_[np.ones(len(x)), (x - mean) / scale]  # at the optimum the penalised gradient is zero
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.r_[1e-6, np.full(8, 1e-2)] * len(x) ** 0.5 * w).max() < 1e-5
    none = (y[~x.any(1)].sum() + y.mean()) / ((~x.any(1)).sum() + 1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        f = np.array(plain_figures(t or "", *lexicon))
        want = 1 / (1 + math.exp(-(w[0] + (f - mean) / scale @ w[1:]))) if f.any() else none
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(want >= 0.3) and got[i].held_out == held(i), t
