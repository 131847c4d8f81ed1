"""The whole pipeline on a small corpus, against a plain version of every stage."""

import collections
import random
import re

import corpus_pipeline
from tests.llm.test_llm import sentence, words4, words9

KEPT = "doc_id long, text string, lang string, source string, n_chars long"


def broken(words, first, each=10):
    """Words in lines of ``each``, of which the first line has ``first``."""
    cuts = [0, *range(first, len(words), each), len(words)]
    return "\n".join(" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def corpus():
    """Both classes have texts of all lengths: from a sample without short ones the classifier takes short clean texts for junk."""
    rng = random.Random(11)
    texts, junk = [], set()
    for i in range(150):
        if i % 3 == 0:
            junk.add(i)
            texts.append(" ".join(w + "$$$" for w in sentence(rng, rng.randint(8, 160)).split()))
        else:
            texts.append(broken(sentence(rng, rng.randint(40, 160) if i < 20 or i % 2 else rng.randint(8, 40)).split(), 10))
    for source in (1, 2, 4, 5):  # same words, other lines: only the join of documents sees them
        words = texts[source].split()
        texts.append(broken(words, 5))
        words[len(words) // 2] = "changed"
        texts.append(broken(words, 3))
    texts += [texts[7], texts[8].split("\n")[0] + "\n\n" + sentence(rng, 50), texts[10].split("\n")[1], texts[11] + "\n" + texts[11]]
    benchmark = [(1, " ".join(texts[13].split()[5:20])), (2, "nothing like this stands in any of these documents at all")]
    return texts, junk, benchmark


def components(sets, threshold=0.8):
    label = list(range(len(sets)))
    while True:
        after = [min(label[j] for j in range(len(sets)) if i == j or (sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))) for i in range(len(sets))]
        if after == label:
            return label
        label = after


def without_like_lines(docs):
    lines = [(i, k, line.strip()) for i, t in sorted(docs.items()) for k, line in enumerate(t.split("\n")) if line.strip()]
    label = components([{s[k : k + 8] for k in range(max(1, len(s) - 7))} for _, _, s in lines])
    gone = {(i, k) for (i, k, _), c, n in zip(lines, label, range(len(lines)), strict=True) if c != n}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    return {i: t for i, t in left.items() if t.strip()}


def one_of_each(docs):
    ids = sorted(docs)
    words = [words9(docs[i].lower()) for i in ids]
    label = components([{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words])
    return {i: docs[i] for n, i in enumerate(ids) if label[n] == n}


def clean(docs, benchmark):
    windows = {tuple(w[k : k + 10]) for _, t in benchmark for w in [words4(t)] for k in range(len(w) - 9)}
    return {i: t for i, t in docs.items() if not any(tuple(w[k : k + 10]) in windows for w in [words4(t)] for k in range(len(w) - 9))}


def least_padding(lengths, buckets):
    lengths = sorted(lengths)
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[j], *(best[i] + lengths[j - 1] * (j - i) for i in range(j))) for j in range(1, len(lengths) + 1)]
    return best[-1]


def test_pipeline_against_plain_stages(spark, tmp_path):
    texts, junk, benchmark = corpus()
    rows = [(i, t, "en", "s", 300) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, KEPT).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {i: t for i, t in enumerate(texts) if i not in junk}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [lambda d: d, without_like_lines, one_of_each, lambda d: clean(d, benchmark)]
    for step, (_, stage) in zip(plain, corpus_pipeline.STAGES, strict=False):
        before, want = want, step(want)
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{stage.__name__}")
        docs = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {x.doc_id: x.text for x in docs.collect()} == want, stage.__name__
        assert step is plain[0] or want != before  # each stage has something to do

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = {i: len(re.findall(r"\S+", t)) for i, t in want.items()}
    assert {x.doc_id: x.n_tokens for x in got} == lengths and len(got) == len(lengths)
    assert sum(x.padded for x in got) == least_padding(lengths.values(), 8)
    assert all(x.n_tokens <= x.padded for x in got)
    slots = collections.defaultdict(set)
    for x in got:
        slots[x.bucket, x.padded, x.batch].add(x.slot)
    assert sum(map(len, slots.values())) == len(got)
    assert all(len(s) * padded <= 16384 for (_, padded, _), s in slots.items())


def test_pipeline_takes_nulls_and_empty_tables(spark, tmp_path):
    for name, rows in (("some", [(1, None, None, None, None), (2, "", "en", None, 0), (None, "a few words", None, "s", None)]), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, KEPT).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        assert {x.doc_id for x in corpus_pipeline.run(spark, at).collect()} == {r[0] for r in rows}
