import shutil
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from lodeframe.llm import mixing, toxicity
from lodeframe.llm.registry import fold

from .test_minhash import brute as near_groups
from .test_mixing import n_words
from .test_substrings import brute as cut
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def plain():
    from lodeframe.llm import tokens
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "substrings", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_by_a_plain_version(spark, docs, corpus):
    rude = docs.filter("doc_id = 3").selectExpr("100 as doc_id", "'an idiot scum loser, you pathetic trash' as text", "lang", "source", "n_chars")
    docs = docs.union(rude.select(*docs.columns))
    kept = STAGE["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), learn=fold("id", 4) != 2)
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns))

    groups = near_groups(corpus)
    want = Counter({tuple(r): 1 for r, (n, c) in zip(corpus, groups, strict=True) if n and c is not None and c == r[0]})
    want += Counter(tuple(r) for r, (n, c) in zip(corpus, groups, strict=True) if c is None or not n)
    base = docs.filter("doc_id is null or doc_id <> 100")
    near = STAGE["minhash"](spark, base, SF)
    assert near.columns == docs.columns and rows_of(near) == want

    out = STAGE["substrings"](spark, base, SF)
    want = Counter()
    for r, (left, words) in zip(corpus, cut([r[1] for r in corpus], 35), strict=True):
        if len(left) == len(words):
            want[tuple(r)] += 1
        elif left:
            text = b" ".join(left).decode()
            want[(r[0], text, r[2], r[3], len(text))] += 1
    assert out.columns == docs.columns and rows_of(out) == want

    mixed = STAGE["mixing"](spark, base, SF)
    assert mixed.columns == docs.columns
    assert sum(n_words(r.text) for r in mixed.collect()) == sum(r.taken for r in mixing.plan(base).collect())


def test_empty_and_clashing(spark, empty, clashing):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).collect() == [], name
        if name != "packing":
            assert f(spark, clashing, SF).columns == clashing.columns, name


def test_no_row_is_lost_for_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, b + " more", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(STAGE["minhash"](spark, docs, SF)) == Counter(rows[:2])


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " x", "en", "t", len(long) + 2), (3, "y" * 300_000, "en", None, 300_000), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(STAGE["toxicity"](spark, docs, SF)) == Counter(rows)
    assert rows_of(STAGE["minhash"](spark, docs, SF)) == Counter([rows[0], *rows[2:]])
    assert rows_of(STAGE["substrings"](spark, docs, SF)) == Counter([(2, "x", "en", "t", 1), *rows[2:]])
    kept = STAGE["mixing"](spark, docs, SF).collect()
    assert {r.text for r in kept} <= {r[1] for r in rows}
    pieces = STAGE["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in pieces if r.doc_id == 4) == 1 and max(r.length for r in pieces) == 2048


def shared_tables(spark):
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    return {p.name.rsplit("-", 1)[0] for p in Path(where).glob("lodeframe-*")}


def test_tables_between_are_dropped(spark):
    for p in Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")).glob("lodeframe-*"):
        shutil.rmtree(p)
    corpus_pipeline.run(spark, SF).count()
    assert shared_tables(spark) == {"lodeframe-stage-mixing"}


def test_run_is_its_stages(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    got = corpus_pipeline.run(spark, SF).collect()
    padding, total, _ = check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], plain)
    assert padding <= 0.01 * total
