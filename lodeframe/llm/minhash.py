"""Near-duplicate documents: MinHash bands, signature check, check on words, components.

1. One pass over the texts gives each document the size and a 128-bit fingerprint (two independent hashes, from the
   bytes on) of its set of distinct word shingles, the hashes of its bands of universal-hash minima,
   and one byte of each minimum as signature. Documents of equal sets become one
   head, so groups of copies end here, by an aggregate that sums map-side.
2. Every bucket (band hash) of two or more heads links its members to one
   of them, the pivot: as many pairs as members. Pairs whose signatures agree
   too little are left out; of the others, each head first checks its best pivot,
   then those pivots that are still in another component.
3. After components over true links, a bucket that still holds several components has
   all members outside its largest one (strays) compared with all members of other components, block against
   block in numpy. A pair is looked at in the first band that its two share, so once. A first pass over signatures
   tells which members of a cell have a partner at all; only their texts are sent, and the cell returns a
   forest of links, at most one for each member. So any two heads that share a bucket are in one component
   or were compared themselves: no link of two bucket mates is lost, no group emits
   all its pairs, and no task gets more than one cell at a time.

Links are checked on the texts' words: hashes only choose what is compared. With 32 bands of 4 minima, documents of
similarity 0.75 share no bucket with a chance of 5e-6 under ideal hashing; README has what was measured. A
pivot with many partners is cut into cells, each with the pivot's text and some `CELL` partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import words as W
from lodeframe.llm.components import components
from lodeframe.llm.tables import fits, partitions, scratch, written

SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 32, 4
#: minima in a signature (the first of them make the bands), and how many of its bytes must agree
SIGNATURE, AGREE = 256, 156
#: least members of a bucket in one block (a large bucket has about BLOCKS, until their size is 16 times that), and most shingles
BLOCK, BLOCKS, BLOCK_SHINGLES = 128, 32, 1 << 18
#: partners of a pivot in one cell
CELL = 64
#: a text that has a word
WORDY = r"[^\x20\x09-\x0D]"


def universal(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of n functions x -> a*x + b over 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def distinct_sets(column: pa.Array, k: int, bits: int = 64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (a, b, h, g, first) of documents: two hashes of each document's distinct shingles.

    `bits` of the first hash are kept; shingles are told apart by both.
    """
    raw, offsets = W.column_bytes(column)
    for a, b in W.steps(raw, offsets):
        r, o = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = W.spans(r, o)
        h, g = (W.shingles(W.word_hashes(r, starts, ends, lower=True, second=x), first, k)[0] for x in (False, True))
        first = W.shingle_counts(first, k)
        h = W.mixed(h & np.uint64((1 << bits) - 1))
        doc = np.repeat(np.arange(b - a), np.diff(first))
        order = np.argsort(g, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        same = (doc[order[1:]] == doc[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        if (same & (h[order[1:]] != h[order[:-1]])).any():
            order = np.lexsort((h, g, doc))
            same = (doc[order[1:]] == doc[order[:-1]]) & (g[order[1:]] == g[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        fresh = np.concatenate((np.ones(min(1, len(h)), dtype=bool), ~same))
        h, g, doc = (x[order][fresh] for x in (h, g, doc))
        yield a, b, h, g, np.searchsorted(doc, np.arange(b - a + 1))


def minima(h: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """(functions, documents): the least value of each function over each document's set; the top value for an empty set."""
    n = len(first) - 1
    out = np.full((len(a), n), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    x = (h >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(full):  # a run of documents that fits the cache, or one long document in pieces
        j = max(i + 1, int(np.searchsorted(first[full], first[full[i]] + step)))
        lo, hi = first[full[i]], first[full[j - 1] + 1]
        cuts = first[full[i:j]] - lo
        for at in range(lo, hi, step) if j == i + 1 else [lo]:
            part = x[at : min(at + step, hi)] if j == i + 1 else x[lo:hi]
            for f in range(len(a)):
                got = np.minimum.reduceat(part * a[f] + b[f], cuts)
                out[f, full[i:j]] = np.minimum(out[f, full[i:j]], got)
        i = j
    return out


def prints(h: np.ndarray, g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2, documents): two independent 64-bit fingerprints of each document's set."""
    out = np.zeros((2, len(first) - 1), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(h):
        out[0, full] = np.add.reduceat(W.mixed(h), first[full])
        out[1, full] = np.add.reduceat(W.mixed2(g), first[full])
    return out.view(np.int64)


def text_keys(text: Column) -> list[Column]:
    """Two hashes of a text as it stands, to find it again under an id."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def describe(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = 64) -> DataFrame:
    """doc_id, t1, t2, n_shingles, f1, f2 (set fingerprint), bands (array of long), signature (binary); one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = universal(max(SIGNATURE, bands * rows))
        for batch in batches:
            for lo, hi, h, g, first in distinct_sets(batch.column("text"), k, bits):
                n, sizes = hi - lo, np.diff(first)
                f1, f2 = prints(h, g, first)
                least = minima(h, first, a, b)
                keys = np.zeros((n, bands), dtype=np.uint64)
                for band in range(bands):
                    key = np.full(n, band + 1, dtype=np.uint64)
                    for row in least[band * rows : band * rows + rows]:
                        key = W.mixed(key * np.uint64(W.BASE) + row.astype(np.uint64))
                    keys[:, band] = key
                signature = np.ascontiguousarray(W.mixed(least[:SIGNATURE].T.astype(np.uint64)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, n) for c in ("doc_id", "t1", "t2")),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(f1),
                        pa.array(f2),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                    ],
                    ["doc_id", "t1", "t2", "n_shingles", "f1", "f2", "bands", "signature"],
                )

    text = F.col("text").cast("string")
    return docs.select("doc_id", *text_keys(text), text.alias("text")).mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary")


def similar_signatures(pairs: DataFrame, signatures: DataFrame, agree: int = AGREE) -> DataFrame:
    """Pairs (a, b, ...) whose signatures agree in `agree` bytes at least; `agreed` says in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            agreed = (x == y).sum(1)
            keep = agreed >= agree
            out = batch.select(["a", "b"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(agreed[keep].astype(np.int64))], ["a", "b", "agreed"])

    sa, sb = (signatures.select(F.col("doc").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")
    joined = pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, agreed long")


def shingle_set(text: str, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def alike(both: int | np.ndarray, one: int | np.ndarray, two: int | np.ndarray, percent: int = PERCENT) -> bool | np.ndarray:
    """Whether sets of these sizes share that percentage of their union, by the size of their intersection."""
    return 100 * both >= percent * (one + two - both)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of distinct pairs (a, b): the true links, checked on words.

    b's text is sent to each cell of b, a's text to its cell of b: one exchange, keyed
    by (b, cell), in whose order a task holds one cell's pivot and one partner at a time.
    """
    n = partitions(pairs.sparkSession)
    cells = pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("long").alias("cells"))
    to = pairs.join(cells, "b").select(F.col("a").alias("doc"), F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("cells")).alias("cell"), F.lit(1).alias("place"))
    own = cells.select(F.col("b").alias("doc"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("place"))
    sent = to.union(own).join(texts, "doc").select("pivot", "cell", "place", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, set()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for pivot, cell, place, doc, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                pivot, theirs = pivot.as_py(), shingle_set(text.as_py(), k)
                if not place.as_py():
                    current, mine = (pivot, cell.as_py()), theirs
                    continue
                assert current == (pivot, cell.as_py())
                if alike(len(mine & theirs), len(mine), len(theirs), percent):
                    found.append((doc.as_py(), pivot))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sent.repartition(n, "pivot", "cell").sortWithinPartitions("pivot", "cell", "place").mapInArrow(run, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of split buckets, sent to their cells (bucket, i, j): a block i of strays against a block j of members."""
    every = F.sequence(F.lit(0), F.col("n") - 1)
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    columns = ["bucket", "i", "j", "stray", "doc", "c", "main", "n_shingles", "signature", "bands"]
    members = rows.withColumn("n", F.col("stray_blocks")).select("*", part("blocks").alias("j"), F.explode(every).alias("i"), F.lit(False).alias("stray")).select(*columns)
    strays = rows.filter("c <> main").withColumn("n", F.col("blocks")).select("*", part("stray_blocks").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("stray")).select(*columns)
    return members.union(strays)


class Cell:
    """The strays and members of one cell; mates() gives the pairs that it answers for."""

    def __init__(self, bucket: int, table: pa.Table, agree: int, percent: int):
        self.stray = table.column("stray").to_numpy()
        self.doc, self.c, self.main, self.size = (table.column(x).to_numpy() for x in ("doc", "c", "main", "n_shingles"))
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(self.doc), -1)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.doc), -1)
        self.bucket, self.agree, self.percent = bucket, agree, percent
        self.two = np.flatnonzero(~self.stray)

    def mates(self, x: int) -> np.ndarray:
        """Members of other components that stray x is compared with here: near by size and signature, and in no earlier band.

        Two strays are looked at once.
        """
        c, two = self.c, self.two
        y = two[(c[two] != c[x]) & ((c[two] == self.main[x]) | (self.doc[two] < self.doc[x]))]
        small, large = np.minimum(self.size[y], self.size[x]), np.maximum(self.size[y], self.size[x])
        y = y[100 * small >= self.percent * large]
        y = y[(self.signature[y] == self.signature[x]).sum(1) >= self.agree]
        band = int(np.argmax(self.bands[x] == self.bucket))
        return y[~(self.bands[y, :band] == self.bands[x, :band]).any(1)]


def with_partners(cells: DataFrame, agree: int = AGREE, percent: int = PERCENT) -> DataFrame:
    """Those rows of cells that have a pair to check in their cell."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = Cell(key[0].as_py(), table, agree, percent)
        used = np.zeros(len(cell.doc), dtype=bool)
        for x in np.flatnonzero(cell.stray):
            y = cell.mates(x)
            used[x] = len(y) > 0
            used[y] = True
        return table.filter(pa.array(used))

    return cells.groupBy("bucket", "i", "j").applyInArrow(run, cells.schema)


def linked_strays(cells: DataFrame, texts: DataFrame, k: int = SHINGLE, agree: int = AGREE, percent: int = PERCENT) -> DataFrame:
    """True links (a, b) of the cells' pairs, checked on words: a forest over each cell's components.

    A cell numbers its shingles by the words themselves; a stray's set is marked, and all of its mates are counted at once.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = Cell(key[0].as_py(), table, agree, percent)
        number: dict[tuple[bytes, ...], int] = {}
        at_doc: dict[int, np.ndarray] = {}
        for d, t in zip(cell.doc.tolist(), table.column("text"), strict=True):
            if d not in at_doc:
                at_doc[d] = np.array([number.setdefault(s, len(number)) for s in shingle_set(t.as_py(), k)], dtype=np.int64)
        items = [at_doc[d] for d in cell.doc.tolist()]
        size = np.array([len(x) for x in items])
        mark = np.zeros(len(number), dtype=bool)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for x in np.flatnonzero(cell.stray):
            y = np.array([m for m in cell.mates(x) if find(int(cell.c[m])) != find(int(cell.c[x]))], dtype=np.int64)
            if not len(y):
                continue
            mark[items[x]] = True
            both = np.add.reduceat(mark[np.concatenate([items[m] for m in y])].astype(np.int64), np.concatenate(([0], np.cumsum(size[y])[:-1])))
            mark[items[x]] = False
            for m in y[alike(both, size[x], size[y], percent)]:
                p, q = find(int(cell.c[x])), find(int(cell.c[m]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(int(cell.doc[x]))
                    b.append(int(cell.doc[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.join(texts, "doc").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _crossing(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; a document without links is one of its own."""
    ca, cb = (comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = 64) -> DataFrame:
    """doc_id, t1, t2, n_shingles, root, component_id; one row a document, written.

    Rows are linked by their own texts, whatever their ids: root names the class of linked rows, component_id is the
    least id in it. Both are null for rows with a null id or without words.
    """
    spark = docs.sparkSession
    with scratch(spark):
        described = written(describe(docs, k, bands, rows, bits), "described")
        real = described.filter("doc_id is not null and n_shingles > 0").withColumn("doc_id", F.col("doc_id").cast("long"))
        same = ["f1", "f2", "n_shingles"]
        # a head for each set: equal sets have equal bands and signatures. The written table fixes the numbers
        found = real.groupBy(*same).agg(F.min(F.struct("doc_id", "t1", "t2")).alias("who"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        heads = written(found.select(F.monotonically_increasing_id().alias("doc"), "who.*", *same, "bands", "signature"), "heads")
        posted = heads.select(F.explode("bands").alias("bucket"), "doc")
        buckets = posted.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
        members = written(posted.join(buckets, "bucket"), "members")
        mates = written(heads.join(members.select("doc").distinct(), "doc").select("doc", "doc_id", "t1", "t2", "n_shingles", "signature", "bands"), "mates")
        text = F.col("text").cast("string")
        own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text), text.alias("text"))
        own = own.join(mates.select("doc", "doc_id", "t1", "t2").hint("merge"), ["doc_id", "t1", "t2"])
        texts = written(own.groupBy("doc_id", "t1", "t2").agg(F.first("doc").alias("doc"), F.first("text").alias("text")).select("doc", "text"), "texts")

        near = members.filter("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
        near = written(similar_signatures(near, mates), "near")
        best = near.groupBy("a").agg(F.max_by("b", F.struct("agreed", -F.col("b"))).alias("b"))
        links = written(confirmed(best, texts, k, percent), "links")
        more = _crossing(near.join(best, ["a", "b"], "left_anti").select("a", "b"), components(links))
        links = links.union(written(confirmed(more, texts, k, percent), "links"))

        # what buckets hold beyond their largest component
        tagged = members.join(components(links).withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("c"))
        tagged = tagged.join(mates.select("doc", "n_shingles"), "doc")
        sizes = tagged.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        main = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("s").alias("s"), F.max_by("s", F.struct("n", "c")).alias("most_s")).filter("n > most")
        size = lambda n: F.greatest(F.lit(BLOCK), F.least(F.lit(16 * BLOCK), n / BLOCKS))
        parts = lambda n, s: F.ceil(F.greatest(n / size(n), s / BLOCK_SHINGLES)).cast("int")
        main = main.select("bucket", "main", parts(F.col("n"), F.col("s")).alias("blocks"), parts(F.col("n") - F.col("most"), F.col("s") - F.col("most_s")).alias("stray_blocks"))
        split = tagged.drop("n_shingles").join(main, "bucket").join(mates.select("doc", "n_shingles", "signature", "bands"), "doc")
        partners = written(with_partners(_cells(split), percent=percent), "partners")
        late = written(linked_strays(partners, texts, k, percent=percent), "links")

        roots = heads.select("doc", "doc_id", *same).join(components(links.union(late)).withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("component", "doc"))
        roots = written(roots.select("doc_id", *same, "root"), "roots")
        least = written(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        named = roots.join(least, "root").select(*same, "root", "component_id")
        linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        out = described.select("doc_id", "t1", "t2", *same).join(named, same, "left")
        return written(out.select("doc_id", "t1", "t2", "n_shingles", *(F.when(linkable, F.col(c)).alias(c) for c in ("root", "component_id"))), "classes", keep=True)


def link(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = 64) -> DataFrame:
    """Of docs (doc_id long, text): doc_id, n_shingles, component_id, kept; one row a document.

    Defined cases: null and empty texts, and texts of white space alone, have an empty
    set and link with nothing; fewer than k words are one shingle; texts of any length are taken whole; rows with a null id
    link with nothing, have no component and are kept; rows that repeat an id are rows of their own, each linked by its own
    text, so rows of one id and different texts may have different components; equal rows are equal documents; an
    empty table gives no row; further columns, whatever their names, are left out. `bits` of the hash that finds candidates are kept.
    """
    with scratch(docs.sparkSession):
        found = classes(docs, k, percent, bands, rows, bits)
        id_ = F.col("doc_id").cast("long")
        component = F.coalesce("component_id", id_)
        return written(found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == id_, F.lit(True)).alias("kept")), "linked", keep=True)


def firsts(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, one of each class of linked rows: of least id, then of least text hash; equal rows of one id and text are one.

    Rows with a null id or without words are in no class and stay.
    """
    spark, text = docs.sparkSession, F.col("text").cast("string")
    found = classes(docs, **options).filter("root is not null")
    who = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("k0"), F.col("t1").alias("k1"), F.col("t2").alias("k2"))).alias("who")).select("who.*")
    often = found.groupBy(F.col("doc_id").cast("long").alias("k0"), F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(F.count("*").alias("n"))
    keys = ["k0", "k1", "k2"]
    who = written(who.join(often, keys), "firsts", keep=True)
    t1, t2 = text_keys(text)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k0"), t1.alias("k1"), t2.alias("k2"))
    single, several = who.filter("n = 1").drop("n"), who.filter("n > 1").drop("n")
    if not fits(who):
        single = single.hint("shuffle_hash")
    kept = rows.join(single, keys).select("row").union(rows.join(several, keys).dropDuplicates(keys).select("row"))
    alone = docs.filter(F.col("doc_id").isNull() | ~F.coalesce(text.rlike(WORDY), F.lit(False)))
    return kept.select("row.*").union(alone)


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS place, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT place, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
size AS (SELECT place, count(*) AS n FROM shingle GROUP BY place),
known AS (SELECT h.place, h.s FROM shingle h JOIN split USING (place) WHERE doc_id IS NOT NULL),
shared AS (SELECT a.place AS a, b.place AS b, count(*) AS n FROM known a JOIN known b ON a.s = b.s AND a.place <> b.place GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN size x ON x.place = a JOIN size y ON y.place = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached AS (
  SELECT place, place AS other FROM split UNION
  SELECT r.place, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT r.place, min(u.doc_id) AS component_id FROM reached r JOIN split u ON u.place = r.other GROUP BY r.place)
SELECT u.doc_id, coalesce(x.n, 0)::BIGINT AS n_shingles, l.component_id, coalesce(u.doc_id = l.component_id, true) AS kept
FROM split u JOIN least l USING (place) LEFT JOIN size x USING (place)
"""
