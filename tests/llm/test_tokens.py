import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import packing, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


ALPHABET = st.text(st.sampled_from(list("ab Z'  \n\t.,1é漢🙂\xa0")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_ids_are_those_of_the_library(plain, text):
    assert tokens.tokens().ids(text).tolist() == ids(plain, text)


def test_special_strings(plain):
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x"):
        assert tokens.tokens().ids(text).tolist() == ids(plain, text)


EDITED = st.text(st.sampled_from(list("abst Z''  \n\t.,!1éè漢字🙂\xa0\u3000")), max_size=60)


@settings(max_examples=600, deadline=None)
@given(EDITED, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 9), EDITED.map(lambda s: s[:8])), max_size=6), st.integers(1, 12))
def test_edits(plain, text, edits, most):
    tree = tokens.TokenTree(text, tokens.tokens(), most)
    assert tree.total == len(ids(plain, text))
    for at, n, new in edits:
        start = min(at, len(text))
        end = min(start + n, len(text))
        text = text[:start] + new + text[end:]
        tree.edit(start, end, new)
        assert tree.text == text and tree.total == len(ids(plain, text))
        assert tree.chars[1] == len(text) and tree.sums[1] == sum(tree.sums[tree.size :])
        assert tree.kept() == ([len(s) for s in tree.leaves], [len(ids(plain, s)) for s in tree.leaves])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endof", "text|>", "<|endoftext|>", "a", " b", "'s"]), max_size=12), st.integers(0, 60), st.integers(0, 9), st.sampled_from(["", "text|>", "<|", "x"]))
def test_edits_of_special_strings(plain, parts, start, n, new):
    text = "".join(parts)
    start = min(start, len(text))
    tree = tokens.TokenTree(text, tokens.tokens(), 4)
    tree.edit(start, min(start + n, len(text)), new)
    assert tree.total == len(ids(plain, text[:start] + new + text[start + n :]))


def long_texts():
    rng = random.Random(1)
    yield " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(16_000))
    yield "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(65_120))  # letters alone: one pre-token
    yield "".join(rng.choice("，。、") if not rng.randrange(12) else chr(rng.randrange(0x4E00, 0x5200)) for _ in range(65_120))
    yield "".join(rng.choice("abcdefgh") for _ in range(65_120))
    yield "".join(rng.choice("0123456789") for _ in range(65_120))


@pytest.mark.parametrize("text", list(long_texts()), ids=["words", "ideographs", "sentences", "letters", "digits"])
def test_an_edit_reads_little(plain, text):
    rng = random.Random(2)
    tree = tokens.TokenTree(text, tokens.tokens())
    before = tree.encoded
    for i in range(80):
        at = rng.randrange(len(text) - 20)
        new = text[at + 5 : at + 12] if i % 2 else "x1"
        tree.edit(at, at + 9, new)
        text = text[:at] + new + text[at + 9 :]
    assert tree.encoded - before <= 80 * 4 * tree.most
    assert tree.text == text and tree.total == len(ids(plain, text))


def test_kept_trees(spark, docs, empty, corpus, plain, tmp_path):
    """Trees are kept as a table and updated from a list of edits, twice."""
    tokens.trees(docs, most=40).write.parquet(str(tmp_path / "trees"))
    texts = [r[1] or "" for r in corpus]
    for turn in range(2):
        kept = spark.read.parquet(str(tmp_path / "trees"))
        assert sorted((r.text or "", r.n_tokens) for r in kept.collect()) == sorted((t, len(ids(plain, t))) for t in texts)
        changes = [(i, nr, 3 * nr + turn, 3 * nr + 7, f"new {nr}'s") for i in (3, 8, 9, 12) for nr in range(5)]
        out = tokens.updated(kept, spark.createDataFrame(changes, "doc_id long, nr int, start int, end int, new string"), most=40)
        for n, r in enumerate(corpus):
            for i, _, start, end, new in changes:
                if r[0] == i:
                    start = min(start, len(texts[n]))
                    texts[n] = texts[n][:start] + new + texts[n][max(start, end) :]
        rows = out.collect()
        assert sorted((r.text or "", r.n_tokens) for r in rows) == sorted((t, len(ids(plain, t))) for t in texts)
        assert {r.n_chars_reencoded > 0 for r in rows if r.doc_id in (3, 8, 9, 12)} == {True}
        assert {r.n_chars_reencoded for r in rows if r.doc_id not in (3, 8, 9, 12)} == {0}
        out.drop("n_chars_reencoded").write.parquet(str(tmp_path / "next"))
        (tmp_path / "trees").rename(tmp_path / "old" if not turn else tmp_path / "older")
        (tmp_path / "next").rename(tmp_path / "trees")
    assert tokens.trees(empty).collect() == []


def test_counts(docs, empty, clashing, corpus, plain, spark):
    personal = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<!\d)\d{13,19}(?!\d)"

    def want(t):
        found = list(regex.finditer(personal, t or ""))
        return len(ids(plain, t)), len(found), len(ids(plain, regex.sub(personal, "[x]", t or ""))), len(t or "")

    compiled = [(x, re.compile(p)) for x, p in tokens.PERSONAL]
    for t in ("a@b.cc+x@y.zz", "1234567890123@b.cc 1234567890123", "x1234567890123@b", "a@b@c.dd", "@", "a@b.", "a.b@c.d.e-f 12345678901234567890"):
        assert tokens.edits_of(t, compiled, "") == [(m.start(), m.end(), "") for m in regex.finditer(personal, t)]

    for d in (docs, clashing):
        got = sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars) for r in tokens.count_edited(d).collect()), key=repr)
        assert got == sorted(((r[0], *want(r[1])) for r in corpus), key=repr)
    assert tokens.count_edited(empty).collect() == []
    some = spark.createDataFrame([(1, "mail a.b+c@d-e.org now 4111111111111111, not 123"), (2, "x@y.zz"), (3, "1234567890123")], "doc_id int, text string")
    got = {r.doc_id: r for r in tokens.count_edited(some).collect()}
    assert [got[i].n_edits for i in (1, 2, 3)] == [2, 1, 1]
    assert got[1].n_tokens_edited == len(ids(plain, "mail [x] now [x], not 123")) and got[2].n_tokens_edited == len(ids(plain, "[x]"))


# packing


def test_choice_is_the_least_sum_of_squares():
    rng = random.Random(2)
    bins = packing.SumOfSquares(32)
    for _ in range(400):
        s = rng.randrange(1, 32)

        def after(level, s=s):
            n = bins.counts.copy()
            if level:
                n[level] -= 1
            if level + s < 32:
                n[level + s] += 1
            return int((n[1:32] ** 2).sum())

        options = [h for h in range(32 - s + 1) if not h or bins.counts[h]]
        level = bins.choose(s)
        assert level in options and after(level) == min(map(after, options))
        bins.place(s, "x" * s)
        assert bins.counts[32] == 0 and all(len(a) == n for a, n in zip(bins.at, bins.counts, strict=True))


def check_pieces(rows, texts, plain, window=2048):
    """texts: [(id, text)], repeats allowed."""
    want = defaultdict(int)
    by_doc = {}
    for i, t in texts:
        own = np.array([*ids(plain, t), 1], dtype="<u4")
        want[i, len(own), zlib.crc32(own.tobytes())] += 1
        by_doc.setdefault(i, []).append(own)
    covered = defaultdict(int)
    for r in rows:
        fits = [x for x in by_doc[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert r.length > 0 and fits
        covered[r.doc_id] += r.length
    assert covered == {i: sum(map(len, own)) for i, own in by_doc.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, total, len(sequences)


def test_packing(docs, empty, clashing, corpus, plain):
    texts = [(r[0], r[1]) for r in corpus]
    for d in (docs, clashing):
        padding, total, _ = check_pieces(packing.pack(d).collect(), texts, plain)
        assert padding <= 0.01 * total
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("most_open", [4, 2048])
def test_packing_alike_documents(spark, plain, most_open):
    rows = [(i, " a" * 1025) for i in range(60)] + [(100 + i, " b" * (i % 7)) for i in range(40)] + [(500, " c" * 9000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    padding, _, n = check_pieces(packing.pack(df, most_open=most_open).collect(), rows, plain)
    assert padding == 0 and n < 60
