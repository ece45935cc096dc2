import re

import numpy as np
import pyarrow as pa
import pytest

from ragmill.llm import texts
from ragmill.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
CASES = ["", " ", "a", "  a  b\t\n c ", None, "x\x0by\x0cz\x1cq\x85r\xa0s t", "ä " * 5000, "one"]


def test_words_are_the_pattern():
    codes, names, sizes = texts.split_words(pa.array(CASES))
    names = names.to_pylist()
    at = texts.offsets_of(sizes)
    got = [[names[c] for c in codes[at[i] : at[i + 1]]] for i in range(len(CASES))]
    assert got == [WORD.findall(t or "") for t in CASES]


def test_window_hashes_follow_the_words():
    words = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    found = texts.window_hashes(words, 3, 1)
    assert found[0] == found[3] and len(set(found.tolist())) == 4
    assert len(texts.window_hashes(words, 8, 1)) == 0


def test_slices_keep_rows_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + ["y" * 100, None])], ["text"])
    parts = list(texts.slices(batch, "text", 25))
    assert sum(p.num_rows for p in parts) == 9 and max(p.num_rows for p in parts) == 2


@pytest.mark.parametrize(
    "edges",
    [
        [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
        [(5, 3), (3, 9), (9, 5), (7, 8), (8, 7), (20, 10), (10, 21), (21, 3)],
    ],
)
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in parent}
