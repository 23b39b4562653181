import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import substrings
from lodeframe.llm import words as W


def brute(texts, k):
    """(kept words, all words) of each text."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append(([x for i, x in enumerate(w) if i not in gone], w))
    return out


def digests(rows, k):
    return sorted(((r[0], len(all_), len(all_) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for r, (kept, all_) in zip(rows, brute([r[1] for r in rows], k), strict=True)), key=repr)


@pytest.mark.parametrize("k, chunk, bits", [(35, substrings.CHUNK, 64), (35, 200, 64), (4, 300, 64), (35, 300, 12), (4, 300, 16)])
def test_equals_brute_force(docs, corpus, k, chunk, bits, monkeypatch):
    """With a hash of few bits, which finds windows that don't repeat, the verification alone keeps the result right."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    want = digests(corpus, k)
    got = sorted(map(tuple, substrings.dedup(docs.repartition(3), k, digest=True, bits=bits).collect()), key=repr)
    assert got == want
    assert any(r[2] for r in want)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_whose_polynomial_hashes_are_equal(spark, n):
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([*(f"{i}x{j}" for j in range(9)), *[f"w{j}" for j in range(17)], w, *[f"v{j}" for j in range(17)]])) for i, w in enumerate([word, other])]
    got = sorted(map(tuple, substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()))
    assert got == digests(rows, 35) and not any(r[2] for r in got)


def test_very_long_texts_and_repeated_ids(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(150_000))
    rows = [(1, long), (1, "short"), (2, "x" * 3_000_000), (2, " ".join(["y"] * 40)), (None, long[:4000]), (None, None)]
    got = sorted(map(tuple, substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()), key=repr)
    assert got == digests(rows, 35)


def test_texts(docs, clashing, empty, corpus):
    brute_ = brute([r[1] for r in corpus], 35)
    want = Counter((r[0], r[1] if len(kept) == len(all_) else b" ".join(kept).decode()) for r, (kept, all_) in zip(corpus, brute_, strict=True))
    for d in (docs, clashing):
        out = substrings.dedup(d)
        assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-4:] == ["n_words", "n_removed", "starts", "ends"]
        assert Counter((r[0], r[1]) for r in out.select(*docs.columns[:2]).collect()) == want
    for r in substrings.dedup(docs).collect():
        assert r.n_removed == sum(e - s for s, e in zip(r.starts or [], r.ends or [], strict=True))
        assert all(e < s for e, s in zip((r.ends or [])[:-1], (r.starts or [])[1:], strict=True))  # maximal: none touch
    assert substrings.dedup(empty).collect() == [] and substrings.dedup(empty, digest=True).collect() == []


def test_places_travel_whole():
    rng = np.random.default_rng(1)
    for top in (3, 300, 70_000, 1 << 31):
        x = rng.integers(0, top, 500)
        assert (substrings._large(substrings._small(x)) == x).all()
    assert len(substrings._large(substrings._small(np.zeros(0, dtype=np.int64)))) == 0


def test_words_are_hashed_alike_everywhere():
    texts = ["a b c", None, "", " b  a ", "c\x0b\x0cb\ra", "é\xa0ü b"]
    raw, offsets = W.column_bytes(pa.array(texts))
    starts, ends, first = W.spans(raw, offsets)
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    h = W.word_hashes(raw, starts, ends)
    by = {}
    for x, w in zip(h.tolist(), [w for t in texts for w in (t or "").encode().split()], strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    sliced = pa.array(["zz", *texts]).slice(1)
    assert W.column_bytes(sliced)[0].tolist() == raw.tolist()
