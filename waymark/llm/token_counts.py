"""Token counts that follow edits: a tree of pre-token counts per document, updated where an edit touches it.

A document is cut into pre-tokens by the tokenizer's pattern; each is a leaf with its length and number of tokens. Leaves
stand in blocks, and a sum tree over the blocks holds lengths and token counts. An edit (start, end, new text; in code
points of the text as it then is) finds its block by descending the sums. The pattern looks ahead over a run of white
space, or two characters of a contraction, so pre-tokens that end before those can't change. From the first other one
on, the new text is cut again until a boundary past the edit falls on an old boundary; from there on all pre-tokens are the old
ones. Only the leaves between are counted again, and only the sums above their blocks are set anew.

Edits of a document are applied in order, in the task that has the document. Defined cases: null and empty texts count
0 tokens, and a null list has no edits. Offsets outside the text are clipped to it, an end before the start counts as
the start, and a null new text is empty. Very long texts are counted whole, and repeated rows one by one. An empty table
gives no rows. These are column functions; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import ship_code

CACHED_PIECES = 300_000
BLOCK = 64


class PieceCounter:
    """Token numbers of pre-tokens by a rank file, with a bounded table of those met before."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > CACHED_PIECES:
                known.clear()
            for piece in set(pieces):
                if piece not in known:
                    known[piece] = len(self.coding.encode_ordinary(piece))
            return list(map(known.__getitem__, pieces))


@cache
def piece_counter(path: str, pattern: str) -> PieceCounter:
    return PieceCounter(path, pattern)


class CountTree:
    """Blocks of pre-token leaves (length, tokens) under a binary tree of sums."""

    def __init__(self, text: str, counter: PieceCounter):
        self.text, self.counter, self.recounted = text, counter, 0
        pieces = counter.pattern.findall(text)
        lengths, tokens = list(map(len, pieces)), counter.counts(pieces)
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)] or [([], [])]
        self.leaves = len(pieces)
        self._grow()

    def _grow(self) -> None:
        self.width = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(self.blocks)] = [(sum(a), sum(b)) for a, b in self.blocks]
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _block_at(self, at: int) -> tuple[int, int]:
        """(block, its first character) for the first block that ends at or after the given character."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.sums[node, 0] < at:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, len(self.blocks) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        reach = start  # what ends before it didn't look as far as the edit
        while reach and self.text[reach - 1].isspace():
            reach -= 1
        reach = max(0, reach - 2)
        first, at = self._block_at(reach)
        lengths, tokens = self.blocks[first]
        keep = 0
        while keep < len(lengths) and at + lengths[keep] < reach:
            at += lengths[keep]
            keep += 1
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        block, leaf, old_at = first, keep, at  # the old boundary that the scan has come to
        fresh: list[str] = []
        for m in self.counter.pattern.finditer(text, at):
            fresh.append(m[0])
            at = m.end()
            while old_at + shift < at or old_at < end:
                if leaf == len(self.blocks[block][0]):
                    if block + 1 == len(self.blocks):
                        break
                    block, leaf = block + 1, 0
                    continue
                old_at += self.blocks[block][0][leaf]
                leaf += 1
            if old_at >= end and old_at + shift == at and at >= start + len(new):
                break
        else:
            block, leaf = len(self.blocks) - 1, len(self.blocks[-1][0])
        removed = sum(len(self.blocks[b][0]) for b in range(first, block + 1)) - keep - (len(self.blocks[block][0]) - leaf)
        rest_lengths, rest_tokens = self.blocks[block][0][leaf:], self.blocks[block][1][leaf:]
        self.text, self.recounted = text, self.recounted + len(fresh)
        self.leaves += len(fresh) - removed
        self._put(first, block, lengths[:keep] + list(map(len, fresh)) + rest_lengths, tokens[:keep] + self.counter.counts(fresh) + rest_tokens)

    def _put(self, first: int, last: int, lengths: list[int], tokens: list[int]) -> None:
        """Blocks first to last become the given leaves; sums above them are set anew."""
        if len(lengths) > 4 * BLOCK * (last - first + 1):
            self.blocks[first : last + 1] = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)]
            self._grow()
            return
        self.blocks[first] = (lengths, tokens)
        for b in range(first, last + 1):
            if b > first:
                self.blocks[b] = ([], [])
            node = self.width + b
            self.sums[node] = (sum(self.blocks[b][0]), sum(self.blocks[b][1]))
        nodes = {(self.width + b) // 2 for b in range(first, last + 1)}
        while nodes and 0 not in nodes:
            for node in nodes:
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            nodes = {node // 2 for node in nodes}


EDITS = "array<struct<start:int,end:int,new:string>>"
COUNTS = "struct<tokens_before:long,tokens_after:long,pretokens:long,recounted:long,edited:string>"
_COUNTS = pa.struct([("tokens_before", pa.int64()), ("tokens_after", pa.int64()), ("pretokens", pa.int64()), ("recounted", pa.int64()), ("edited", pa.string())])


def _follow(text: str | None, edits: list[dict] | None, counter: PieceCounter) -> dict:
    tree = CountTree(text or "", counter)
    before = tree.tokens
    for e in edits or []:
        if e is not None:
            tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
    return {"tokens_before": before, "tokens_after": tree.tokens, "pretokens": tree.leaves, "recounted": tree.recounted, "edited": tree.text}


def counts_after_edits(text: Column, edits: Column, path: str, pattern: str) -> Column:
    """Struct of token counts before and after a document's edits, its pre-tokens, those counted again, the edited text."""
    ship_code(SparkSession.active())

    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array, lists: pa.Array) -> pa.Array:
        counter = piece_counter(path, pattern)
        return pa.array((_follow(t.as_py(), e.as_py(), counter) for t, e in zip(texts, lists, strict=True)), _COUNTS)

    return counted(text, edits)


def derived_edits(row_id: Column, text: Column, count: int = 4) -> Column:
    """Edits that follow from a row alone: at hashed places a passage of the text replaces, precedes or loses characters."""
    size = F.length(F.coalesce(text, F.lit("")))

    def place(k: int, what: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(f"{what}{k}")), size + 1).cast("int")

    def one(k: int) -> Column:
        start, source = place(k, "at"), place(k, "from")
        cut = (0, 12, 30, 3)[k % 4]
        taken = F.substring(F.coalesce(text, F.lit("")), source + 1, F.lit((40, 0, 9, 200)[k % 4]))
        return F.struct(start.alias("start"), (start + cut).alias("end"), taken.alias("new"))

    return F.array(*(one(k) for k in range(count)))
