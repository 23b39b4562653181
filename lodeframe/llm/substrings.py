"""Exact removal of repeated word windows.

1. Finding. One pass over the texts hashes every window of `k` words of one document (Rabin-Karp over
   64-bit word hashes). A task works in chunks of documents. Within a chunk, windows whose hash
   occurs again there are marked at once; of each distinct hash one entry goes on, with that mark.
   Entries travel as blobs, one for each chunk and bucket: 5 bytes an entry, the marks as bits, the places
   as small differences. A bucket counts each hash over all chunks and answers each chunk with the places
   whose hash is repeated. However often one window occurs, a chunk sends it once, so the buckets stay even.
2. Verifying. A repeated hash only makes a window a candidate. The texts that hold candidates are written
   to a table of their own, and each candidate window's words, joined by one space, are digested by BLAKE2b to
   128 bits. The digests take the same way through chunks, buckets and answers, and a window is
   repeated if its digest is. So a collision of hashes costs work and changes no result.
3. Windows merge into maximal removal intervals of documents, which join the documents by a key of id and
   text; the words outside are kept.

Words are runs of other bytes than space and \\x09-\\x0D, unchanged. Defined cases: a null or
empty text has no words and stays as it is; a text of fewer than k words loses nothing; a text of any length
is one document of one chunk; rows that repeat an id and text are documents of their own, so their windows are
repeated, and all such rows lose the same; rows that repeat an id with other texts are documents like any other; null ids are
ids like others; an empty table gives no row. Further columns of the input may have any names; with `digest` they are left out.

The first pass reads its input once and may run again where an executor is lost: docs should be
a table that reads the same again, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import words as W
from lodeframe.llm.tables import fits, free, partitions, planned_bytes, scratch, written

WORDS = 35
#: windows of one chunk
CHUNK = 2 << 20
#: buckets for each shuffle partition, and bytes of input for each bucket, whichever gives more buckets
SPREAD, BUCKET_BYTES = 8, 8 << 20


def _small(gaps: np.ndarray) -> bytes:
    """Differences in 1, 2 or 4 bytes each, whichever takes least; those that don't fit follow in 4 bytes."""
    width = min((1, 2, 4), key=lambda w: w * len(gaps) + 4 * int((gaps >= 256**w - 1).sum()))
    top = 256**width - 1
    wide = gaps >= top
    return bytes([width]) + np.where(wide, top, gaps).astype(f"<u{width}").tobytes() + gaps[wide].astype("<u4").tobytes() + int(wide.sum()).to_bytes(4, "little")


def _large(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[-4:], "little")
    out = np.frombuffer(raw[1 : len(raw) - 4 - 4 * n], dtype=f"<u{width}").astype(np.int64)
    out[out == 256**width - 1] = np.frombuffer(raw[len(raw) - 4 - 4 * n : -4], dtype="<u4")
    return out


def _sorted(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order, which neighbours in it are equal) of keys a, or of keys (a, b)."""
    if b is None:
        order = np.argsort(a, kind="stable")
        return order, a[order[1:]] == a[order[:-1]]
    order = np.lexsort((b, a))
    return order, (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])


def repeated(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur more than once, which are the first of their kind)."""
    order, same = _sorted(a, b)
    more, first = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    more[1:] |= same
    more[:-1] |= same
    first[1:] = ~same
    out_more, out_first = np.empty_like(more), np.empty_like(first)
    out_more[order], out_first[order] = more, first
    return out_more, out_first


def _packed(a: np.ndarray, b: np.ndarray | None) -> bytes:
    """Entries in planes: 4 bytes and 1 byte of a hash, or 8 and 8 of a digest."""
    if b is None:
        return a.astype("<u4").tobytes() + (a >> np.uint64(32)).astype(np.uint8).tobytes()
    return a.astype("<u8").tobytes() + b.astype("<u8").tobytes()


def _unpacked(raw: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    if wide:
        n = len(raw) // 16
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u8", n, 8 * n)
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32), None


class Chunk:
    """Documents whose windows are looked at together; places are word numbers in the chunk."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.words = self.windows = 0

    def add(self, keys: np.ndarray, sizes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """Documents of so many words, and their windows: places among these words, and entries."""
        self.keys.append(keys)
        self.sizes.append(sizes)
        if len(at):
            self.at.append(at + self.words)
            self.a.append(a)
            if b is not None:
                self.b.append(b)
        self.words += int(sizes.sum())
        self.windows += len(at)

    def blobs(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, entries, marks, places); bucket -1 has the directory: keys, sizes, places known to be repeated."""
        if not self.windows:
            return
        a, at = np.concatenate(self.a), np.concatenate(self.at)
        b = np.concatenate(self.b) if self.b else None
        more, first = repeated(a, b)
        own = at[more]
        a, at, more = a[first], at[first], more[first]
        bucket = (a % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        a, at, more = a[order], at[order], more[order]
        if b is None:
            a = (a // np.uint64(buckets)) & np.uint64((1 << 40) - 1)  # the bucket tells the rest
        else:
            b = b[first][order]
        for x in np.flatnonzero(np.diff(cut)):
            i, j = cut[x], cut[x + 1]
            yield int(x), _packed(a[i:j], None if b is None else b[i:j]), np.packbits(more[i:j]).tobytes(), _small(np.diff(at[i:j], prepend=0))
        yield -1, np.concatenate(self.keys).astype("<i8").tobytes(), np.concatenate(self.sizes).astype("<i8").tobytes(), _small(np.diff(own, prepend=0))


def answers(blobs: list[tuple[int, bytes, bytes, bytes]], wide: bool) -> Iterator[tuple[int, bytes]]:
    """(chunk, places) of one bucket's blobs: the entries that other chunks have too, and that the chunk doesn't know of."""
    parts = [_unpacked(e, wide) for _, e, _, _ in blobs]
    order, same = _sorted(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]) if wide else None)
    more = np.zeros(len(order), dtype=bool)
    more[1:] |= same
    more[:-1] |= same
    hit = np.empty_like(more)
    hit[order] = more
    i = 0
    for (chunk, _, marks, places), (p, _) in zip(blobs, parts, strict=True):
        known = np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=len(p)).astype(bool)
        new = hit[i : i + len(p)] & ~known
        i += len(p)
        if new.any():
            yield chunk, _small(np.diff(np.cumsum(_large(places))[new], prepend=0))


def runs(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(key, key, starts, ends) of the documents with places: maximal runs of window places in the document."""
    places = np.unique(places)
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.searchsorted(first, places, side="right") - 1
    cuts = np.flatnonzero((np.diff(places) != 1) | (np.diff(doc) != 0)) + 1
    starts, ends = places[np.append(0, cuts)], places[np.append(cuts - 1, len(places) - 1)] + 1
    owner = doc[np.append(0, cuts)]
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    for i, j in zip(at, np.append(at[1:], len(owner)), strict=True):
        d = owner[i]
        yield int(keys[d, 0]), int(keys[d, 1]), starts[i:j] - first[d], ends[i:j] - first[d]


def hashed(batch: pa.RecordBatch, k: int, bits: int) -> Iterator[tuple]:
    """Chunk.add's arguments for runs of documents: all windows, by hash."""
    keys = np.stack([batch.column(c).to_numpy() for c in ("k1", "k2")], 1)
    raw, offsets = W.column_bytes(batch.column("text"))
    for i, j in W.steps(raw, offsets):
        r = raw[offsets[i] : offsets[j]]
        starts, ends, first = W.spans(r, offsets[i : j + 1] - offsets[i])
        at = W.kept_windows(first, k)
        h = W.mixed(W.window_hashes(W.word_hashes(r, starts, ends), k)[at])
        yield keys[i:j], np.diff(first), at, h & np.uint64((1 << bits) - 1)


def digested(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """Chunk.add's arguments for each document: the windows in its runs, by digest of their words."""
    blake = hashlib.blake2b
    for k1, k2, text, starts, ends in zip(*(batch.column(c) for c in ("k1", "k2", "text", "starts", "ends")), strict=True):
        found = text.as_py().encode().split()
        joined = b" ".join(found)
        begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in found])))
        at = np.concatenate([np.arange(s, e) for s, e in zip(starts.as_py(), ends.as_py(), strict=True)])
        sums = b"".join([blake(joined[i:j], digest_size=16).digest() for i, j in zip(begin[at].tolist(), (begin[at + k] - 1).tolist(), strict=True)])
        ab = np.frombuffer(sums, "<u8").reshape(-1, 2)
        yield np.array([[k1.as_py(), k2.as_py()]]), np.array([len(found)]), at, ab[:, 0], ab[:, 1]


def repeats(rows: DataFrame, entries, wide: bool, buckets: int) -> DataFrame:
    """k1, k2, starts, ends (runs of window places): of rows, those windows whose entry occurs more than once.

    entries(batch) gives Chunk.add's arguments. A row for each document that has such windows; several for repeated rows.
    """
    n = max(partitions(rows.sparkSession), buckets // SPREAD)

    def batch(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    one_names, one_kinds = ["bucket", "chunk", "a", "b", "c"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()

        def close() -> Iterator[pa.RecordBatch]:
            found: list[tuple] = []
            for b, *x in chunk.blobs(buckets):
                found.append((b if b >= 0 else number % buckets, number if b >= 0 else ~number, *x))
                if len(found) == 512:
                    yield batch(found, one_names, one_kinds)
                    found = []
            if found:
                yield batch(found, one_names, one_kinds)

        for b in batches:
            for args in entries(b):
                chunk.add(*args)
                if chunk.windows >= CHUNK:
                    yield from close()
                    number, chunk = number + 1, Chunk()
        if chunk.keys:
            yield from close()

    two_names, two_kinds = ["chunk", "a", "b", "c"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A directory (complement of its chunk's number) goes through; blobs, in order of their buckets, are answered by bucket."""
        held, current = [], None
        for b in batches:
            found = []
            for bucket, chunk, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != current:
                    found += [(c, None, None, places) for c, places in answers(held, wide)] if held else []
                    held, current = [], bucket
                if chunk < 0:
                    found.append((~chunk, x, y, z))
                else:
                    held.append((chunk, x, y, z))
            if found:
                yield batch(found, two_names, two_kinds)
        found = [(c, None, None, places) for c, places in answers(held, wide)] if held else []
        if found:
            yield batch(found, two_names, two_kinds)

    three_names, three_kinds = ["k1", "k2", "starts", "ends"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their chunks."""

        def close(parts: list) -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            keys, sizes = next((np.frombuffer(x, "<i8").reshape(-1, 2), np.frombuffer(y, "<i8")) for x, y, _ in parts if x is not None)
            places = np.concatenate([np.cumsum(_large(z)) for _, _, z in parts]).astype(np.int64)
            found = list(runs(keys, sizes, places)) if len(places) else []
            for i in range(0, len(found), 4096):
                yield batch(found[i : i + 4096], three_names, three_kinds)

        held, current = [], None
        for b in batches:
            for chunk, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != current:
                    yield from close(held)
                    held, current = [], chunk
                held.append((x, y, z))
        yield from close(held)

    blobs = rows.mapInArrow(one, "bucket long, chunk long, a binary, b binary, c binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    replies = blobs.mapInArrow(two, "chunk long, a binary, b binary, c binary").repartition(n, "chunk").sortWithinPartitions("chunk")
    return replies.mapInArrow(three, "k1 long, k2 long, starts array<int>, ends array<int>")


def removals(docs: DataFrame, k: int = WORDS, bits: int = 64) -> DataFrame:
    """Of docs (k1, k2, text): k1, k2, starts, ends, one row for each key with repeated windows: runs of places where these start.

    `bits` of the window hash find candidates; digests of their words decide.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark) * SPREAD, planned_bytes(docs) // BUCKET_BYTES)
    with scratch(spark):
        found = written(repeats(docs, lambda b: hashed(b, k, bits), False, buckets).dropDuplicates(["k1", "k2"]), "candidates")
        free(spark)
        held = written(docs.join(found if fits(found) else found.hint("shuffle_hash"), ["k1", "k2"]), "held")
        free(spark)
        out = written(repeats(held, lambda b: digested(b, k), True, buckets).dropDuplicates(["k1", "k2"]), "removals", keep=True)
    free(spark)
    return out


def merged(starts: list | None, ends: list | None, k: int) -> tuple[list[int], list[int]]:
    """Maximal runs of words under windows that start in the runs [start, end)."""
    a: list[int] = []
    b: list[int] = []
    for s, e in zip(starts or (), ends or (), strict=True):
        if b and s <= b[-1]:
            b[-1] = e - 1 + k
        else:
            a.append(s)
            b.append(e - 1 + k)
    return a, b


def cut(column: pa.Array, starts: list, ends: list) -> Iterator[tuple[list[bytes] | None, int, int]]:
    """(kept words, or None if all are, number of words, number removed) of each text."""
    for text, s, e in zip(column, starts, ends, strict=True):
        found = (text.as_py() or "").encode().split()
        if not s:
            yield None, len(found), 0
            continue
        kept, at = [], 0
        for i, j in zip(s, e, strict=True):
            kept += found[at:i]
            at = j
        kept += found[at:]
        yield kept, len(found), len(found) - len(kept)


def dedup(docs: DataFrame, k: int = WORDS, digest: bool = False, bits: int = 64) -> DataFrame:
    """docs without the words under windows of k words that also start elsewhere.

    Returns docs' columns and n_words, n_removed, starts, ends (removal intervals in words). A text
    that loses words becomes its kept words joined by one space; others stay unchanged. With digest,
    returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) instead.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    d = docs.toDF(*plain)
    doc_id, text = (F.col(plain[names.index(c)]) for c in ("doc_id", "text"))
    d = d.withColumns({"k1": F.xxhash64(doc_id.cast("string"), text), "k2": F.xxhash64(F.lit(2), text, doc_id.cast("string"))})
    gone = removals(d.select("k1", "k2", text.cast("string").alias("text")), k, bits)
    at = names.index("text")
    wanted = [plain[names.index("doc_id")], plain[at]] if digest else plain
    joined = d.select("k1", "k2", *wanted).join(gone if fits(gone) else gone.hint("shuffle_hash"), ["k1", "k2"], "left").select(*wanted, "starts", "ends")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered = [merged(s, e, k) for s, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)]
            starts, ends = [s for s, _ in covered], [e for _, e in covered]
            column = b.column(plain[at])
            out, sizes, lost = [], [], []
            for kept, n, m in cut(column, starts, ends):
                out.append(kept)
                sizes.append(n)
                lost.append(m)
            counts = [pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())]
            if digest:
                sums = [hashlib.sha256(b" ".join(x if x is not None else (t.as_py() or "").encode().split())).hexdigest() for x, t in zip(out, column, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(plain[names.index("doc_id")]), *counts, pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                continue
            new = pa.array([t.as_py() if x is None else b" ".join(x).decode() for x, t in zip(out, column, strict=True)], pa.string())
            cols = [new if p == plain[at] else b.column(p) for p in plain]
            yield pa.RecordBatch.from_arrays([*cols, *counts, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], [*plain, "n_words", "n_removed", "starts", "ends"])

    kinds = {p: f.dataType.simpleString() for p, f in zip(plain, docs.schema, strict=True)}
    if digest:
        return joined.mapInArrow(texts, f"doc_id {kinds[plain[names.index('doc_id')]]}, n_words long, n_removed long, kept_sha256 string")
    kinds[plain[at]] = "string"
    out = joined.mapInArrow(texts, ", ".join(f"{p} {kinds[p]}" for p in plain) + ", n_words long, n_removed long, starts array<int>, ends array<int>")
    return out.toDF(*names, "n_words", "n_removed", "starts", "ends")


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
places AS (
  SELECT row, unnest(range(1, len(words) - 33)) AS pos, words FROM split WHERE len(words) >= 35),
windows AS (SELECT row, pos, md5(array_to_string(words[pos : pos + 34], ' ')) AS w FROM places),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hit AS (SELECT DISTINCT row, pos FROM windows JOIN again USING (w)),
gone AS (SELECT DISTINCT row, unnest(range(pos, pos + 35)) AS pos FROM hit),
lost AS (SELECT row, count(*) AS n, list(pos) AS places FROM gone GROUP BY row),
word AS (SELECT row, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS w FROM split),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN lost l USING (row) LEFT JOIN kept k USING (row)
"""
