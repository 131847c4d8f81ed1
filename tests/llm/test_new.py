"""Language identification, Merkle manifest and hard negatives: whole results against brute force, and the defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import docs, none, rows, same, sentence  # noqa: F401
from tidemark.llm import hard_negatives, language, merkle

WORDS = {
    "en": "the of and to in that with from this have are was for not they which river stone winter garden morning",
    "de": "der die und das nicht mit von den ein eine auf für ist über wird auch größe straße zwischen morgen",
    "fr": "le la les et des une dans pour que qui avec sur est pas était très après être maison rivière",
    "es": "el los las una que por con para del está más también años niño señor sobre entre mañana puerta",
    "ru": "и в не на что он как это по из мы за для река утро камень сад зима дом между",
    "pl": "i w nie na to się że z jak jest dla od przez był czy już rzeka ogród kamień zima",
}


def passage(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def corpus(langs, n=80, seed=3):
    rng = random.Random(seed)
    return [(i, passage(rng, langs[i % len(langs)], rng.randint(4, 40)), langs[i % len(langs)]) for i in range(n * len(langs))]


# --- language ---------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20, 60])
def test_codewords_are_apart(n):
    codes = language.code(n)
    assert set(np.unique(codes)) == {-1.0, 1.0}
    assert len(np.unique(codes * codes[:1], axis=1).T) == codes.shape[1]  # no equal or opposite columns
    assert not (np.abs(codes.sum(0)) == n).any()
    assert language.least_distance(codes) >= (1 if n == 2 else 2 if n < 6 else codes.shape[1] // 4)


def plain_grams(word):
    marked = b"<" + word.encode() + b">"
    return [marked, *(marked[i : i + k] for k in (1, 2, 3, 4) for i in range(len(marked) - k + 1))]


def test_gram_counts_against_plain_words():
    import pyarrow as pa

    texts = ["Die STRASSE, die Größe! x", "", "12 après-midi", "é"]
    found = language.gram_counts(pa.array(texts))
    plain = [["die", "strasse", "die", "größe", "x"], [], ["12", "après", "midi"], ["é"]]
    for (grams, times), words in zip(found, plain, strict=True):
        assert times.sum() == sum(len(plain_grams(w)) for w in words)
        assert len(grams) <= len({g for w in words for g in plain_grams(w)})
    same_word = language.gram_counts(pa.array(["die", "die die", "DIE"]))
    assert (same_word[0][0] == same_word[1][0]).all() and (2 * same_word[0][1] == same_word[1][1]).all() and (same_word[0][0] == same_word[2][0]).all()


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"], list(WORDS)])
def test_languages_of_held_out_documents(spark, langs):
    known = spark.createDataFrame(corpus(langs), "doc_id long, text string, lang string").repartition(3)
    got = language.identified(known, language.fit(known)).withColumn("held", language.held_out()).collect()
    held = [x for x in got if x.held]
    assert len(held) > 20
    assert np.mean([x.lang == x.language.lang_pred for x in held]) >= 0.97
    assert all(0 <= x.language.score <= 1 for x in got)
    mixed = spark.createDataFrame([(None, " ".join(w for lang in langs for w in WORDS[lang].split()[:12]))], "doc_id long, text string")
    clear = spark.createDataFrame([(None, WORDS["en"])], "doc_id long, text string")
    model = language.fit(known)
    assert language.identified(clear, model).first().language.score >= language.identified(mixed, model).first().language.score


def test_decoding_against_plain_sums():
    model = language.Model(["a", "b", "c", "d"])
    rng = np.random.default_rng(1)
    model.weights, model.scale = rng.random(model.code.shape), 3.0
    margins = rng.normal(size=(20, model.code.shape[1]))
    best, score, _ = model.decode(margins)
    for i in range(20):
        loss = [sum(model.weights[k, b] * np.log1p(np.exp(-model.code[k, b] * margins[i, b])) for b in range(7)) for k in range(4)]
        assert best[i] == int(np.argmin(loss))
        assert score[i] == pytest.approx(np.exp(-3 * min(loss)) / sum(np.exp(-3 * x) for x in loss))
    wrong = model.code[[2]].copy()
    wrong[0, :2] *= -1  # two wrong bits of seven: the code corrects one
    assert model.decode(5 * wrong)[2][0] and not unsure(model, 2)


def unsure(model, k):
    best, _, flag = model.decode(9 * model.code[[k]])
    assert best[0] == k
    return flag[0]


def test_held_out_rows_and_nulls_teach_nothing(spark):
    known = corpus(["en", "de"])
    held = [(i, t, "zz") for i, t, _ in known if zlib.crc32(str(i).encode()) % 5 == 0]
    kept = [x for x in known if zlib.crc32(str(x[0]).encode()) % 5]
    table = [*kept, *held, (None, WORDS["en"], "null id"), (100001, None, "no text"), (100002, "12 34", "no letter"), (100003, WORDS["de"], None)]
    model = language.fit(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]


def test_language_of_defined_cases(spark, docs, none):  # noqa: F811
    model = language.fit(spark.createDataFrame(corpus(["en", "de", "fr"]), "doc_id long, text string, lang string"))
    got = language.identified(docs.withColumn("language", F.lit(7)), model)
    assert got.columns == [*docs.columns, "language", "language_"]
    for x in got.collect():
        assert (x.language_.lang_pred == "und") == (x.text is None or not any(c.isalpha() for c in x.text))
    odd = language.identified(spark.createDataFrame([(1, t) for t in (None, "", "12 !?", "日本", "A")], "doc_id long, text string"), model).collect()
    assert [x.language.lang_pred == "und" for x in odd] == [True, True, True, False, False]
    assert [x.language.score for x in odd[:3]] == [0, 0, 0]
    assert language.identified(none, model).count() == 0
    nothing, one = language.fit(none), language.fit(spark.createDataFrame(corpus(["en"]), "doc_id long, text string, lang string"))
    assert {x.language.lang_pred for x in language.identified(docs, nothing).collect()} == {"und"}
    assert {(x.language.lang_pred, x.language.score) for x in language.identified(docs, one).collect()} == {("en", 1.0), ("und", 0.0)}


# --- Merkle manifest --------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def build(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def up(levels, i):
    out = []
    for below in levels[:-1]:
        run = i - i % 3
        out.append((i % 3, [below[j] for j in range(run, min(run + 3, len(below))) if j != i]))
        i //= 3
    return out


def manifest(rows):  # noqa: F811
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text))) for s in sources}
    trees = {s: build([plain_leaf(r, r.text) for r in own[s]]) for s in sources}
    top = build([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            path = up(trees[s], i) + up(top, k)
            text = r.text.replace("\n", "") if r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
            node = plain_leaf(r, text)
            for at, siblings in path:
                node = digest(*siblings[:at], node, *siblings[at:])
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], digest(*(x for _, side in path for x in side)), node, node == top[-1][0]))
    return out


def query(spark, tmp_path, frame):
    frame.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return merkle.op12_merkle_manifest(spark, str(tmp_path))


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_plain_trees(spark, docs, levels):  # noqa: F811
    """Many tiers, sources of every size, one of a third of all rows, and sources at the bounds of blocks."""
    rng = random.Random(levels)
    sizes = [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100]
    many = [(rng.randint(0, 400), rng.choice(["a\nb\n", "none", "", None, "é\n"]), None, s, None) for s, n in [*((f"s{i:02}", n) for i, n in enumerate(sizes)), (None, 5), ("Ä", 4), ("z", 2), ("", 3)] for _ in range(n)]
    frame = spark.createDataFrame(many, FIELDS).union(docs.select("doc_id", "text", "lang", "source", "n_chars")).repartition(5)
    same(merkle.checked(merkle.tree(frame, merkle.tampered(), merkle.without_newlines(), levels)).collect(), manifest(frame.collect()))


def test_manifest_of_few_rows(spark, tmp_path):
    for table in ([], [(3, "a\nb", "en", "s", 3)], [(3, "a\nb", "en", "s", 3)] * 2, [(i, "a\nb", None, f"s{i}", 3) for i in range(5)], [(None, None, None, None, None)]):
        frame = spark.createDataFrame(table, FIELDS)
        same(query(spark, tmp_path, frame).collect(), manifest(frame.collect()))


def test_versions_copy_only_ancestors(spark, tmp_path):
    """Every version differs from the base tree in one path, and all its other nodes are the base's."""
    frame = spark.createDataFrame([(i, f"line\n{i}", "en", "s" if i % 3 else f"t{i % 2}", i) for i in range(200)], FIELDS)
    found = merkle.tree(frame, merkle.tampered(), merkle.without_newlines())
    base = {x.doc_id: x for x in found.versions().collect()}
    for x in base.values():
        changed = zlib.crc32(str(x.doc_id).encode()) % 2 == 0
        assert (x.copied is not None) == changed
        if changed:
            n = sum(y.source == x.source for y in base.values())
            assert len(x.copied) == 1 + merkle.height(n) + merkle.height(3)
            assert bytes(x.copied[-1]) != found.root
    again = merkle.tree(frame.repartition(7))
    assert again.root == found.root and all(x.copied is None for x in again.versions().collect())


# --- hard negatives ---------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def relabelled(row):
    return (row[2] + 1) % 10 if row[0] is not None and row[0] % 7 == 0 else row[2]


def negatives(table):
    kept = [(v, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e], relabelled((v, e, c))) for v, e, c in table if c is not None and e is not None and all(x is not None and np.isfinite(np.float32(x)) for x in e)]
    out = []
    for i, (anchor, left, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(left, e, strict=False)), v is None, v or 0, v, c) for j, (v, e, c) in enumerate(kept) if j != i), key=lambda x: x[:3])
        for score, _, _, positive, _ in [x for x in scored if x[4] == label][:5]:
            window = [x for x in scored if x[4] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out += [(anchor, positive, k, x[3], -score, -x[0]) for k, x in enumerate(window, 1)]
    return out


def mined(spark, tmp_path, table, schema=VECTORS):
    spark.createDataFrame(table, schema).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect()


def drawn(rng, n, dims, decay=1.0):
    center = rng.normal(size=(10, dims))
    label = rng.integers(0, 10, n)
    vec = (center[label] * 0.6 + rng.normal(size=(n, dims))) * decay ** np.arange(dims)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    return [(i, [float(np.float32(x)) for x in v], int(c)) for i, (v, c) in enumerate(zip(vec, label, strict=True))]


@pytest.mark.parametrize(("decay", "block"), [(1.0, 2048), (0.93, 100), (0.8, 2048)])
def test_hard_negatives_against_all_pairs(spark, tmp_path, monkeypatch, decay, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    table = drawn(np.random.default_rng(block), 900, 48, decay)
    same(mined(spark, tmp_path, table), negatives(table))


def test_hard_negatives_of_copies_ties_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = np.random.default_rng(4)
    table = drawn(rng, 400, 20)
    hot = table[100][1]
    table += [(1000 + i, hot, i % 3) for i in range(150)]  # a quarter of all rows is one vector
    table += [table[200], table[200], table[201], (700, table[7][1], 3), (None, table[3][1], 2), (None, table[3][1], 2)]
    table += [(800, None, 1), (801, hot, None), (900, [float("nan")] * 20, 1), (1100, [float("inf")] + [0.1] * 19, 1), (1200, [None] * 20, 1), (1300, [], 1), (1400, [0.5], 2), (1500, [0.0] * 20, 4), (1600, [-x for x in hot], 4), (1700, [0.4] * 30, 5)]
    same(mined(spark, tmp_path, table), negatives(table))
    assert mined(spark, tmp_path, []) == []
    same(mined(spark, tmp_path, table[:3]), negatives(table[:3]))


def test_hard_negatives_of_large_components(spark, tmp_path):
    rng = np.random.default_rng(6)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (2.0**20 if i % 2 else 1)], int(rng.integers(0, 3))) for i in range(130)]
    same(mined(spark, tmp_path, table), negatives(table))


def test_index_omits_what_can_not_reach_a_threshold():
    rng = np.random.default_rng(2)
    rows, anchors = rng.integers(-200, 200, (300, 40)) * 0.9 ** np.arange(40), rng.integers(-200, 200, (9, 40)) * 0.9 ** np.arange(40)
    rows, anchors = np.floor(rows), np.floor(anchors)
    score = anchors @ rows.T
    least = np.sort(score, 1)[:, -8].astype(float)
    index = hard_negatives.Index(rows, float((least / np.linalg.norm(anchors, axis=1)).min()))
    assert index.ends.mean() < 40  # most rows leave dimensions out
    a, x, s = index.reach(anchors, least, np.ones(score.shape, bool))
    want = set(zip(*(v.tolist() for v in np.nonzero(score >= least[:, None])), strict=True))
    assert set(zip(a.tolist(), x.tolist(), strict=True)) == want and (s == score[a, x]).all()
