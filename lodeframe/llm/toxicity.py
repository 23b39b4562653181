"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words (ASCII lower case, punctuation apart), pairs of
neighbouring words and pairs with one word between, each hashed to 64 bits and
counted as present or not. Each coordinate has its own learning rate, and the L1 term
keeps coordinates without evidence at exactly zero, so a model is its non-zero
weights: a few thousand numbers that are broadcast.

The updates run twice. First features share 2**BITS cells by their leading bits, so memory is bounded; then those in cells
with a weight are learnt apart, by all 64 bits. So no text is marked for a rare pair of words that shares a cell with a toxic word.

Fitting reads a bounded sample: of each label, the `MOST` rows of least hash among the
rows that may be learnt from, and of these, in that order, as many as have `MOST_BYTES` of features together; texts are
taken whole. A label's rows weigh in by how many rows they stand for. Features are hashed where the texts are and written; one
task runs the updates, in the order of another hash, as the method is online: by the first, the few clean rows of least hash would all
come before most toxic ones, and the last thousands of updates, all for label 1, would mark clean texts. Scoring reads every text once, in any number of tasks.

Defined cases: null and empty texts have no features, and score by the bias; a text of any length is scored whole; repeated rows are
scored alike; without labels or documents to learn from the score is 0.5 everywhere; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import words as W
from lodeframe.llm.tables import scratch, small_batches, written

BITS, MOST, EPOCHS, THRESHOLD = 22, 8000, 5, 0.3
#: bytes of cells, 4 each, that a label's rows may have in the sample
MOST_BYTES = 256 << 20
#: chosen by cross-validation among rows that may be learnt from
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 1.0


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, pair and skip pair, repeats included."""
    starts, ends, first = W.spans(raw, offsets, W.PUNCTUATED)
    h = W.word_hashes(raw, starts, ends, lower=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, docs = [h], [doc]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = doc[gap:] == doc[:-gap]
        hashes.append(W.mixed(h[:-gap] * np.uint64(W.BASE) + h[gap:] + np.uint64(salt))[same])
        docs.append(doc[gap:][same])
    return np.concatenate(docs), np.concatenate(hashes)


def cells(f: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The cell of each feature; sorted features have sorted cells."""
    return (f >> np.uint64(64 - bits)).astype("<u4")


@dataclass
class Model:
    """Non-zero weights by feature, in the order of the features, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def ftrl(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """Fit on distinct features of each row, in the given order."""
    z, n, bias_z, bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def now(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for x, y, c in zip(rows, labels, weights, strict=True):
            w = now(z[x], n[x])
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = c * (1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y)
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - step * w
            n[x] += g * g
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - step * bias
            bias_n += g * g
    w = now(z, n)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)))


def ftrl_apart(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, **options) -> Model:
    """ftrl on features of any size: each has a coordinate of its own."""
    index, at = np.unique(np.concatenate(rows), return_inverse=True)
    rows = np.split(at, np.cumsum([len(x) for x in rows])[:-1])
    m = ftrl(rows, labels, weights, bits=max(len(index) - 1, 0).bit_length(), **options)
    return Model(index[m.index], m.weight, m.bias)


def scores(column: pa.Array, model: Model, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 for each text; a text without known features has that of the bias alone."""
    raw, offsets = W.column_bytes(column)
    out = np.full(len(column), model.bias)
    near = np.zeros(1 << bits, dtype=bool)  # most features are told to be unknown by their cells
    near[cells(model.index, bits)] = True
    for a, b in W.steps(raw, offsets):
        doc, f = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        some = near[cells(f, bits)]
        doc, f = doc[some], f[some]
        at = np.searchsorted(model.index, f)
        known = model.index[np.minimum(at, len(model.index) - 1)] == f
        pairs = np.unique(doc[known].astype(np.int64) << 32 | at[known])
        np.add.at(out, a + (pairs >> 32), model.weight[pairs & 0xFFFFFFFF])
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, most: int = MOST, bits: int = BITS, most_bytes: int = MOST_BYTES, **options) -> Model:
    """Model of labels (doc_id, `label`) over docs (doc_id, text).

    Rows with a null id, null label or null text, and those where `learn` doesn't hold, are not
    learnt from; ids that occur several times count once, with their greatest label and text. Without
    any row the model has no weight and a bias of 0.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    order = F.xxhash64(F.lit(7), "id")
    parts = [known.filter(F.col("y") == y).orderBy(order, "id").limit(most) for y in sorted(counts)]
    if not parts:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.union(p)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id")  # at most `most` ids a label

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.column_bytes(batch.column("text"))
            for a, b in W.steps(raw, offsets):
                doc, f = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.lexsort((f, doc))
                doc, f = doc[order], f[order]
                other = np.ones(len(f), dtype=bool)
                other[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
                doc, f = doc[other], f[other]
                cell = cells(f, bits)
                other = np.ones(len(f), dtype=bool)
                other[1:] = (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])
                size = 4 * np.bincount(doc[other], minlength=b - a)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                x = pa.array([f[i:j].astype("<u8").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("y").slice(a, b - a), x, pa.array(size.astype(np.int64))], ["id", "y", "x", "size"])

    sample = rows.filter("text is not null").mapInArrow(hashed, "id string, y double, x binary, size long")

    def narrowed(some: DataFrame, weighty: np.ndarray | None = None) -> DataFrame:
        """some with, in place of features, their distinct cells, or only the features in weighty cells."""
        sent = docs.sparkSession.sparkContext.broadcast(weighty)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = np.zeros(1 << bits, dtype=bool)
            if sent.value is not None:
                near[sent.value] = True
            for batch in batches:
                out = []
                for v in batch.column("x"):
                    f = np.frombuffer(v.as_py(), dtype="<u8")
                    cell = cells(f, bits)
                    if sent.value is not None:
                        out.append(f[near[cell]].tobytes())
                    else:
                        other = np.ones(len(cell), dtype=bool)
                        other[1:] = cell[1:] != cell[:-1]
                        out.append(cell[other].tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("turn", "id", "y", "c")), pa.array(out, pa.binary())], ["turn", "id", "y", "c", "x"])

        return some.select("turn", "id", "y", "c", "x").mapInArrow(run, "turn long, id string, y double, c double, x binary")

    def trained(some: DataFrame, apart: bool) -> Model | None:
        """Fitted in one task on some rows; None without any."""

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("turn", "ascending"), ("id", "ascending")])
            ids = table.column("id").to_pylist()
            table = table.take([i for i, v in enumerate(ids) if not i or v != ids[i - 1]])  # of equal rows one
            x = [np.frombuffer(v, dtype="<u8" if apart else "<u4") for v in table.column("x").to_pylist()]
            y, c = table.column("y").to_numpy(), table.column("c").to_numpy()
            y, c = (y > 0).astype(float), c / c.min()
            m = ftrl_apart(x, y, c, **options) if apart else ftrl(x, y, c, bits, **options)
            index = m.index.astype(np.uint64).view(np.int64)
            return pa.table({"bias": np.full(len(index) + 1, m.bias), "i": pa.array([None, *index.tolist()], pa.int64()), "w": pa.array([0.0, *m.weight], pa.float64())})

        with small_batches(docs.sparkSession):
            got = some.groupBy().applyInArrow(train, "bias double, i long, w double").toArrow()
        if not got.num_rows:
            return None
        bias, got = got.column("bias")[0].as_py(), got.filter(got.column("i").is_valid())
        index, weight = got.column("i").to_numpy().view(np.uint64), got.column("w").to_numpy()
        order = np.argsort(index)
        return Model(index[order], weight[order], bias)

    with scratch(docs.sparkSession):
        sample = written(sample.withColumns({"o": order, "turn": F.xxhash64(F.lit(8), "id"), "t": F.xxhash64("x")}), "features")
        sizes = sample.groupBy("y", "o", "id").agg(F.max(F.struct("size", "t")).alias("of")).collect()  # at most `most` rows a label
        kept, so_far, weight = [], {}, {}
        for r in sorted(sizes, key=lambda r: (r["o"], r["id"])):
            if so_far.get(r["y"], 0) < most_bytes:
                kept.append((r["id"], r["of"]["t"]))  # of an id with several texts one
                weight[r["y"]] = weight.get(r["y"], 0) + 1
            so_far[r["y"]] = so_far.get(r["y"], 0) + r["of"]["size"]
        kept = docs.sparkSession.createDataFrame(kept, "id string, t long")
        weigh = F.element_at(F.create_map(*[F.lit(x) for y, n in weight.items() for x in (float(y), counts[y] / n)]), F.col("y")) if weight else F.lit(1.0)
        sample = sample.join(F.broadcast(kept), ["id", "t"]).withColumn("c", weigh)
        model = trained(narrowed(sample), apart=False)
        if model is not None:
            model = trained(narrowed(sample, model.index.astype(np.int64)), apart=True)
    return model or Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, result: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with `result` (0 to 1) and `predicted` (1 from the threshold on); columns of docs with these names give way.

    A null text scores like an empty one. One pass, no shuffle.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.index, model.weight))
    bias = model.bias
    docs = docs.drop(result, predicted)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*weights.value, bias)
        for b in batches:
            p = scores(b.column(text), mine)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*plain, "score", "predicted"])

    kinds = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema, strict=True))
    return docs.toDF(*plain).mapInArrow(run, f"{kinds}, score double, predicted int").toDF(*names, result, predicted)
