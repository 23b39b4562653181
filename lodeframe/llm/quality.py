"""Quality scores: a generalised additive model with pairwise interactions.

A text is described by measures of its form (lengths, shares of kinds of characters and words, repetition).
Each measure is cut into bins at quantiles of the fitting rows. Boosting goes round the
measures: each turn fits a shallow tree on one measure's bins to the gradient of the log
loss and adds it, scaled, to that measure's lookup table. The pairs of measures whose
joint bins explain most of what is left are then boosted in the same way. A score adds one
table entry for each measure and pair: vectorised additions, no trees.

Fitting reads a bounded sample: of each label, the `MOST` rows of least hash; only their measures
reach the driver, at most 2 * MOST rows of `len(NAMES)` numbers. Scoring is one pass without shuffle.

Defined cases: null and empty texts have zeros as measures; a text of any length is measured whole; repeated rows are scored alike;
without labels or documents to learn from the score is 0.5 everywhere; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import words as W

MOST, BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, THRESHOLD = 8000, 32, 8, 80, 6, 40, 0.3, 0.3  # rounds, rate and pairs by cross-validation among rows that may be learnt from
NAMES = (
    "log_words", "word_bytes", "letters", "digits", "symbols", "bars", "upper", "ended", "wordless", "distinct",
    "same_as_last", "distinct_pairs", "short", "long", "log_line_words", "distinct_lines", "log_lines", "mixed",
)

_CODE = np.arange(256)
_LETTER = ((_CODE >= 97) & (_CODE <= 122)) | ((_CODE >= 65) & (_CODE <= 90)) | (_CODE >= 128)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_MARK = np.isin(_CODE, [ord(c) for c in ".,;:!?'\"-()"])
_BAR = np.isin(_CODE, [ord(c) for c in "|<>{}[]=\\/_~^"])
_SYMBOL = (_CODE > 32) & (_CODE < 127) & ~_LETTER & ~_DIGIT & ~_MARK & ~_BAR
_END = np.isin(_CODE, [ord(c) for c in ".!?,;:"])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[fresh], minlength=n).astype(np.float64)


def measures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, measures); an empty text has zeros."""
    n = len(offsets) - 1
    starts, ends, first = W.spans(raw, offsets)
    h = W.word_hashes(raw, starts, ends, lower=True)
    words, size = np.diff(first).astype(np.float64), ends - starts
    doc = np.repeat(np.arange(n), np.diff(first))
    n_bytes = _sums(size, first)
    by = {k: _sums(t[raw], offsets) for k, t in (("letters", _LETTER), ("digits", _DIGIT), ("symbols", _SYMBOL), ("bars", _BAR), ("upper", _UPPER))}
    letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    in_word = letters[ends] - letters[starts]
    same = doc[1:] == doc[:-1]
    pair = W.mixed(h[:-1] * np.uint64(W.BASE) + h[1:])[same] if len(h) else h
    again = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n) if len(h) else np.zeros(n)
    mixed = (in_word > 0) & (in_word < size - 1)
    # lines: runs of words without a line end between; the line's hash is the sum of its words' hashes by place
    breaks = np.concatenate(([0], np.cumsum(raw == 10)))
    line = breaks[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (line[1:] != line[:-1]) | ~same
    heads = np.flatnonzero(fresh)
    place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    line_hash = np.add.reduceat(h * W.powers(W.BASE)(place), heads) if len(heads) else h
    lines = np.bincount(doc[heads], minlength=n).astype(np.float64)
    out = [
        np.log1p(words), _share(n_bytes, words), _share(by["letters"], n_bytes), _share(by["digits"], n_bytes), _share(by["symbols"], n_bytes),
        _share(by["bars"], n_bytes), _share(by["upper"], n_bytes), _share(_sums(_END[raw[ends - 1]] if len(ends) else size, first), words), _share(_sums(in_word == 0, first), words),
        _share(_distinct(h, doc, n), words), _share(again, words), _share(_distinct(pair, doc[1:][same] if len(h) else doc, n), words - 1), _share(_sums(size <= 3, first), words),
        _share(_sums(size >= 12, first), words), np.log1p(_share(words, lines)), _share(_distinct(line_hash, doc[heads], n), lines), np.log1p(lines), _share(_sums(mixed, first), words),
    ]
    return np.stack(out, 1)


@dataclass
class Model:
    """Cuts and a lookup table for each measure; coarse cuts and a table for each pair."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for c, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(cut, x[:, c], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw_scores(x), -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best single cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -np.inf)
    if not len(gain):
        return -np.inf, 0
    best = int(np.argmax(gain))
    return float(gain[best]) - g.sum() ** 2 / (h.sum() + l2), best + 1


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """A tree of up to `leaves` leaves over ordered bins: its value in each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_best_cut(g[a:b], h[a:b], l2, least), (a, b)) for a, b in parts]
        gain, cut, part = max(options, key=lambda t: t[0])
        if not gain > 0:
            break
        parts.remove(part)
        parts += [(part[0], part[0] + cut), (part[0] + cut, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def shallow_pair(g: np.ndarray, h: np.ndarray, l2: float = 1.0, least: float = 2.0) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree of one cut on each of two measures: four corners of the table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -np.inf, None
    tg, th = cg[-1, -1], ch[-1, -1]
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], tg - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], th - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((np.where(hs >= least, gs**2 / (hs + l2), 0)).sum() - tg**2 / (th + l2))
            if gain > best:
                best, at = gain, (i, j, np.where(hs >= least, gs / (hs + l2), 0))
    out = np.zeros(g.shape)
    if at is not None:
        i, j, v = at
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def boost(x: np.ndarray, y: np.ndarray, c: np.ndarray, bins: int = BINS, pair_bins: int = PAIR_BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    """Fit on measures x, labels y and row weights c."""
    if not len(y):
        return Model()
    share = np.clip((c * y).sum() / c.sum(), 1e-4, 1 - 1e-4)
    m = Model(float(np.log(share / (1 - share))))
    m.cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    m.coarse = [_cuts(x[:, f], pair_bins) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(cut) + 1) for cut in m.cuts]
    fine = [np.searchsorted(cut, x[:, f], side="right") for f, cut in enumerate(m.cuts)]
    out = np.full(len(y), m.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        return c * (y - p), c * p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(fine):
            g, h = left()
            step = rate * shallow(np.bincount(b, g, len(m.tables[f])), np.bincount(b, h, len(m.tables[f])))
            m.tables[f] += step
            out += step[b]
    rough = [np.searchsorted(cut, x[:, f], side="right") for f, cut in enumerate(m.coarse)]

    def table(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(m.coarse[i]) + 1, len(m.coarse[j]) + 1
        return np.bincount(rough[i] * shape[1] + rough[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = left()
    found = sorted(((shallow_pair(table(i, j, g), table(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    m.pairs = [(i, j, np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1))) for gain, i, j in found if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in m.pairs:
            g, h = left()
            step = rate * shallow_pair(table(i, j, g), table(i, j, h))[1]
            t += step
            out += step[rough[i], rough[j]]
    return m


def _all_measures(column: pa.Array) -> np.ndarray:
    raw, offsets = W.column_bytes(column)
    parts = [measures(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in W.steps(raw, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, most: int = MOST, **options) -> Model:
    """Model of labels (doc_id, `label`) over docs (doc_id, text).

    Rows with a null id, label or text, and those where `learn` doesn't hold, are not learnt from; an id that
    occurs several times counts once. Without any row the score is 0.5 everywhere.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not counts:
        return Model()
    order = F.xxhash64(F.lit(8), "id")
    picked = None
    for y in sorted(counts):
        part = known.filter(F.col("y") == y).orderBy(order, "id").limit(most)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id").filter("text is not null")  # at most `most` ids a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _all_measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y double, x binary").toPandas().sort_values(["id", "x"]).drop_duplicates("id")
    if not len(got):
        return Model()
    x = np.stack([np.frombuffer(v) for v in got.x])
    y = got.y.to_numpy()
    c = np.array([counts[v] / min(counts[v], most) for v in y])
    return boost(x, (y > 0).astype(float), c / c.min(), **options)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, result: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with `result` (0 to 1) and `predicted` (1 from the threshold on); columns of docs with these names give way.

    A null text scores like an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of at most BINS numbers a measure
    docs = docs.drop(result, predicted)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.scores(_all_measures(b.column(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*plain, "score", "predicted"])

    kinds = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema, strict=True))
    return docs.toDF(*plain).mapInArrow(run, f"{kinds}, score double, predicted int").toDF(*names, result, predicted)
