"""What the third review found in the numbered operators."""

from __future__ import annotations

import numpy as np

from tidemark.llm import merkle, similar


def test_untouched_documents_are_folded_too(spark):
    """The root that they show comes from their own leaf and siblings, not from the tree."""
    rows = [(i, "ab"[i % 2], None, i, f"text\n{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    tree = merkle.tree(docs, merkle.tampered(), merkle.without_newlines(), 2)
    root, tree.root = tree.root.hex(), b"\0" * 32
    found = merkle.checked(tree).collect()
    own = [x for x in found if x.folded_root == root]
    assert 0 < len(own) < 40 and {x.root for x in found} == {"00" * 32}
    assert not any(x.verified for x in found)


def test_rest_of_a_large_bucket_is_in_few_tiles(spark, monkeypatch):
    """Documents that share a bucket and are like no pivot: each pair meets, in tiles that make few rows a record."""
    monkeypatch.setattr(similar, "LIMIT", 16)
    bins, n = 64, 16 * 8
    sig = np.random.default_rng(3).integers(0, 2**31, (n, bins)).astype(np.uint32)
    sig[1::2] = np.where(np.arange(bins) % 8 < 6, sig[::2], sig[1::2])  # pairs at 0.75
    records = spark.createDataFrame([(i, sig[i].tobytes()) for i in range(n)], "rid long, sig binary")
    buckets = spark.createDataFrame([(7, i) for i in range(n)], "path long, rid long")
    tiles = []
    whole = similar._tiled
    monkeypatch.setattr(similar, "_tiled", lambda *a: tiles.append(whole(*a)) or tiles[-1])
    edges = similar.candidates(records, buckets, bins, np.uint32, 4).collect()
    assert {tuple(sorted((x.a, x.b))) for x in edges} >= {(i, i + 1) for i in range(0, n, 2)}
    assert n < sum(x.count() for x in tiles) <= 4 * n
