"""Byte-level BPE ids and edit-aware token counts.

A document is a segment tree: its leaves are runs of whole tokens, its nodes hold the characters and tokens below them. A text's ids
are those of its leaves one after another: leaves are cut at token boundaries, also inside words, where a character that
isn't white space ends and no apostrophe begins, so that neither pre-tokens nor merges differ for the parts (two neighbouring tokens
that are right with one another are right in any text). An edit re-encodes the leaves that it touches with a leaf on either side (more, if they are shorter than a
special token); it holds if both rims are such cuts again, and else takes in the next leaves. Texts without white space are cut like others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of a `tokenizers` byte-level BPE file.

    Texts that hold the string of a special token go to the `tokenizers` library;
    all others to tiktoken with the ranks of the same file, which gives the same ids faster.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.widest = max([1, *map(len, self.special)])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: bytes of each id
        self.lengths = np.zeros(1 + max([*ranks.values(), *(x["id"] for x in spec.get("added_tokens", []))]), dtype=np.int64)
        for word, i in ranks.items():
            self.lengths[i] = len(word)
        for x in spec.get("added_tokens", []):
            self.lengths[x["id"]] = len(x["content"].encode())

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self.ids(text))


_LOADED: dict[str, Tokens] = {}


def tokens(path: str | None = None) -> Tokens:
    """Loaded once a Python worker."""
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def _cut(text: str, at: int) -> bool:
    """Whether a token boundary at this character may be a cut."""
    return not text[at - 1].isspace() and text[at] != "'"


def token_ends(text: str, tok: Tokens) -> np.ndarray:
    """Places in characters where tokens end; -1 for an end inside a character."""
    ends = np.cumsum(tok.lengths[tok.ids(text)])
    if not len(ends) or ends[-1] == len(text):  # one byte a character
        return ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    begins = np.append((raw & 0xC0) != 0x80, True)
    return np.where(begins[ends], np.cumsum(begins)[ends] - 1, -1)


def segments(text: str, most: int, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """(characters, tokens) of a text's leaves, by the ends of its tokens: a leaf ends at the first cut after `most` characters."""
    chars, counts, at, done = [], [], 0, 0
    if len(text) > most:
        nth = np.flatnonzero(ends >= 0)
        places = ends[nth]
        while len(text) - at > most:
            i = int(np.searchsorted(places, at + most))
            while i < len(places) and places[i] < len(text) and not _cut(text, int(places[i])):
                i += 1
            if i == len(places) or places[i] == len(text):
                break
            chars.append(int(places[i]) - at)
            counts.append(int(nth[i]) + 1 - done)
            at, done = int(places[i]), int(nth[i]) + 1
    return [*chars, len(text) - at], [*counts, len(ends) - done]


class TokenTree:
    """A document's leaves, and by node of a binary tree over them the characters and tokens below it.

    An edit finds its leaves by descending over the character sums; all leaves that it doesn't touch keep
    their counts. `encoded` counts the characters that were encoded since the start, so none for a tree that is
    made from kept leaves.
    """

    def __init__(self, text: str, tok: Tokens, most: int = 256, kept: tuple[list[int], list[int]] | None = None):
        self.tok, self.most, self.encoded = tok, most, 0 if kept else len(text)
        chars, counts = kept or segments(text, most, token_ends(text, tok))
        cuts = np.concatenate(([0], np.cumsum(chars))).tolist()
        self._build([text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], counts)

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.sums = (self._summed(x) for x in ([len(s) for s in leaves], counts))

    def _summed(self, x: list[int]) -> list[int]:
        levels = [np.zeros(self.size, dtype=np.int64)]
        levels[0][: len(x)] = x
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def kept(self) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the leaves, to make the tree again."""
        n = len(self.leaves)
        return self.chars[self.size : self.size + n], self.sums[self.size : self.size + n]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the character at `at`; at the end of the text the last leaf with characters."""
        at = max(0, min(at, self.chars[1] - 1))
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, s: str, count: int) -> None:
        self.leaves[leaf] = s
        i = leaf + self.size
        self.chars[i], self.sums[i] = len(s), count
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def _beside(self, leaf: int, step: int) -> tuple[int, str]:
        """(last leaf taken, text) of the leaves from this one on: one with characters, and more if these are fewer than a special token has."""
        n, at = 0, leaf
        while 0 <= at < len(self.leaves) and n < self.tok.widest:
            n += len(self.leaves[at])
            at += step
        taken = self.leaves[leaf:at] if step > 0 else self.leaves[at + 1 : leaf + 1]
        return at - step, "".join(taken)

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in the place of the characters [start, end)."""
        first, at = self._find(start)
        last, last_at = self._find(max(start, end - 1))
        region = self.leaves[first][: start - at] + new + self.leaves[last][max(end, start) - last_at :]
        while True:
            (lo, left), (hi, right) = self._beside(first - 1, -1), self._beside(last + 1, 1)
            whole = left + region + right
            self.encoded += len(whole)
            ends = token_ends(whole, self.tok)
            ok = [p in (0, len(whole)) or bool((ends == p).any()) and _cut(whole, p) for p in (len(left), len(whole) - len(right))]
            if all(ok):
                break
            if left and not ok[0]:
                region, first = left + region, lo
            if right and not ok[1]:
                region, last = region + right, hi
        a, b = len(left), len(whole) - len(right)
        done = int(np.flatnonzero(ends == a)[0]) + 1 if a else 0
        until = int(np.flatnonzero(ends == b)[0]) + 1 if b else 0
        self._put(first, last, region, np.where(ends < 0, -1, ends - a)[done:until])

    def _put(self, first: int, last: int, region: str, ends: np.ndarray) -> None:
        """Leaves first to last become the region, whose tokens have these ends."""
        if len(region) <= 2 * self.most:
            self._set(first, region, len(ends))
            for i in range(first + 1, last + 1):
                if self.leaves[i]:
                    self._set(i, "", 0)
            return
        chars, counts = segments(region, self.most, ends)
        cuts = np.concatenate(([0], np.cumsum(chars))).tolist()
        parts = [region[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        old = self.kept()[1]
        self._build([*self.leaves[:first], *parts, *self.leaves[last + 1 :]], [*old[:first], *counts, *old[last + 1 :]])


#: what the standing edit takes out: e-mail addresses, which have an @, and runs of 13 to 19 digits
PERSONAL = (("@", r"[\w.+-]++@[\w-]++(?:\.[\w-]++)+"), ("", r"(?<!\d)\d{13,19}(?!\d)"))


def edits_of(text: str, patterns: list[tuple[str, re.Pattern]], new: str) -> list[tuple[int, int, str]]:
    """Edits that put `new` where a pattern is found, from the left, the earlier pattern first; a pattern is looked for in texts with its literal."""
    found = sorted((m.start(), nth, m.end()) for nth, (literal, p) in enumerate(patterns) if literal in text for m in p.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, _, end in found:
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


def trees(docs: DataFrame, path: str | None = None, most: int = 256) -> DataFrame:
    """docs' doc_id and text with leaf_chars, leaf_tokens (arrays, by leaf) and n_tokens: trees to be kept as a table.

    A null text has a tree of one empty leaf; texts of any length, repeated rows and null ids are rows like any other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for b in batches:
            kept = [segments(t, most, token_ends(t, tok)) for t in (x or "" for x in b.column("text").to_pylist())]
            lists = [pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists, pa.array([sum(k[1]) for k in kept], pa.int64())], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def updated(kept: DataFrame, edits: DataFrame, path: str | None = None, most: int = 256) -> DataFrame:
    """Kept trees after edits (doc_id, nr, start, end, new), and n_chars_reencoded.

    A document's edits are put in by rising nr, each with places in the text as it then is, and go to all rows of that id; places
    beyond the text's end mean its end. Without edits a tree stays as it is, and nothing is encoded.
    """
    kind = kept.schema["doc_id"].dataType.simpleString()
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("nr", "start", "end")), "new"))).alias("edits"))
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for r in b.select(["text", "leaf_chars", "leaf_tokens", "n_tokens", "edits"]).to_pylist():
                if not r["edits"]:
                    row = (r["text"], r["leaf_chars"], r["leaf_tokens"], r["n_tokens"], 0)
                else:
                    tree = TokenTree(r["text"] or "", tok, most, (r["leaf_chars"], r["leaf_tokens"]))
                    for e in r["edits"]:
                        start = max(0, min(e["start"], tree.chars[1]))
                        tree.edit(start, max(start, min(e["end"], tree.chars[1])), e["new"] or "")
                    row = (tree.text, *tree.kept(), tree.total, tree.encoded)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*names, "n_chars_reencoded"])

    return kept.select(*names).join(lists, "doc_id", "left").mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_chars_reencoded long")


def count_edited(docs: DataFrame, path: str | None = None, most: int = 256, patterns: tuple[tuple[str, str], ...] = PERSONAL, new: str = "[x]") -> DataFrame:
    """Token counts of each document before and after the edits that `patterns` (literal, expression) find.

    Returns doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, n_chars_reencoded
    (characters encoded for the edits). A null text counts as empty; a text of any length, repeated rows and
    null ids are rows like any other; an empty table gives no row. No shuffle: a row's work depends on that row alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, find = tokens(path), [(literal, re.compile(p)) for literal, p in patterns]
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for text in b.column("text"):
                text = text.as_py() or ""
                changes = edits_of(text, find, new)
                if changes:
                    tree = TokenTree(text, tok, most)
                    before, read = tree.total, tree.encoded
                    for start, end, put in reversed(changes):  # from the end, so that earlier places stay
                        tree.edit(start, end, put)
                    row = (before, len(changes), tree.total, len(text), tree.encoded - read)
                else:
                    n = tok.count(text)
                    row = (n, 0, n, len(text), 0)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars", "n_chars_reencoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_chars long, n_chars_reencoded long")
