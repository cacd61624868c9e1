"""Best-fit packing of token sequences with swap-based local search.

1. One Arrow pass encodes each whole text, appends the end id, cuts only what is longer than a sequence, and returns a
   narrow row for each piece. The different words of a run of texts are encoded once, since the tokenizer never merges
   across white space.
2. Full pieces are sequences of their own. The others are dealt by hash into shards of about `shard` pieces. A shard is
   packed best-fit by falling length; then local search moves one document, or exchanges one for one or two for one
   between underfull bins whenever that raises the sum of squared fills, until nothing does; emptied bins vanish.
3. Pieces of bins that are still underfull go to the next round, mixed with those of other shards. The last round keeps
   what it packs. Each task sees a bounded number of pieces, and each round only what the one before could not fill.

Defined cases: null and empty texts are the end id alone. Very long texts are cut into pieces of a whole sequence and a
rest. Repeated rows are packed one by one. An empty table gives no pieces. Pieces of equal length are interchangeable;
ties fall to the piece that was read first. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, string_buffers
from .merges import Merges

RUN_BYTES = 1 << 22
CACHED_WORDS = 200_000
#: Fixed value: the cut of the vocabulary that words are cut by here; any other one goes through the library.
KNOWN_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = 0x250
WORD_END = "</w>"


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never crosses it.

    A run of texts is split at ASCII white space, and each different word of it is encoded once. Printable Latin words are
    lower-cased, cut and merged here by array operations; all others, and the names of special tokens, go through the
    tokenizer's whole pipeline, with a bounded table of those met before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, list[int]] = {}
        told = json.loads(self.tokenizer.to_str())
        cuts = [x.get("pattern", {}).get("Regex") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        vocabulary = told["model"]["vocab"]
        self.here = cuts == [KNOWN_CUT, None] and told["model"]["end_of_word_suffix"] == WORD_END
        if self.here:
            pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
            self.merges = Merges({(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)})
            signs = _byte_signs()
            self.symbol = np.array([[vocabulary[signs[i] + end] for i in range(256)] for end in ("", WORD_END)], np.int32)
        kinds = [unicodedata.category(chr(c))[0] for c in range(LATIN)]
        self.kind = np.array([1 if k == "L" else 2 if k == "N" else 3 for k in kinds], np.int8)
        self.plain = np.array([chr(c).isprintable() and len(chr(c).lower()) == 1 and chr(c) not in "<\x00" for c in range(LATIN)])
        self.lower = np.array([ord(chr(c).lower()[0]) for c in range(LATIN)], np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row ends, from 0) for a string column without nulls."""
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        ids, ends = self._words(words.dictionary)
        which = words.indices.to_numpy()
        sizes = np.diff(ends)[which]
        stops = np.cumsum(sizes)
        out = ids[np.arange(stops[-1] if len(which) else 0) + np.repeat(ends[1:][which] - stops, sizes)]
        per_row = np.asarray(split.offsets, np.int64)
        return out, np.concatenate(([0], stops))[per_row - per_row[0]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of different words."""
        offsets, data = string_buffers(words)
        codes = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)))[offsets - offsets[0]]
        word_of = np.repeat(np.arange(len(words)), np.diff(bounds))
        small = np.minimum(codes, LATIN - 1)
        usual = np.ones(len(words), bool) if self.here else np.zeros(len(words), bool)
        usual[word_of[(codes >= LATIN) | ~self.plain[small]]] = False
        ids, owner = self._merged(self.lower[small[usual[word_of]]], word_of[usual[word_of]]) if self.here else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if not usual.all():
            rest = np.flatnonzero(~usual)
            found = [self._through(w) for w in words.take(pa.array(rest)).to_pylist()]
            ids = np.concatenate([ids, *(np.array(x, np.int32) for x in found)])
            owner = np.concatenate([owner, np.repeat(rest, [len(x) for x in found])])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.searchsorted(owner, np.arange(len(words) + 1))

    def _through(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            ids = self.known[word] = self.tokenizer.encode(word, add_special_tokens=False).ids
        return ids

    def _merged(self, codes: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their words) of lower-cased Latin words."""
        if not len(codes):
            return np.zeros(0, np.int32), word_of
        kind = self.kind[codes]
        first = np.ones(len(codes), bool)  # a part begins here
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (word_of[1:] != word_of[:-1])
        self._contractions(codes, kind, word_of, first)
        two = codes > 0x7F
        sizes = 1 + two
        at = np.cumsum(sizes) - sizes
        data = np.zeros(at[-1] + sizes[-1], np.uint8)
        data[at] = np.where(two, 0xC0 | codes >> 6, codes)
        data[at[two] + 1] = 0x80 | codes[two] & 0x3F
        starts = at[first]
        ends = np.concatenate((starts[1:], [len(data)]))
        symbols = self.symbol[0][data]
        symbols[ends - 1] = self.symbol[1][data[ends - 1]]
        self.merges.apply(symbols, starts, ends)
        keep = symbols >= 0
        return symbols[keep], np.repeat(word_of, sizes)[keep]

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, word_of: np.ndarray, first: np.ndarray) -> None:
        """An apostrophe that begins a part, with s, t, m, d, re, ve or ll right after it, is one part with these."""
        for i in np.flatnonzero(first[:-1] & (codes[:-1] == 39) & (word_of[1:] == word_of[:-1]) & (kind[1:] == 1)).tolist():
            after = "".join(map(chr, codes[i + 1 : i + 3][word_of[i + 1 : i + 3] == word_of[i]].tolist()))
            n = 1 if after[0] in "stmd" else 2 if after in ("re", "ve", "ll") else 0
            if n:
                first[i + 1 : i + 1 + n] = False
                if i + 1 + n < len(codes):
                    first[i + 1 + n] = True


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if it prints, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def word_encoder(path: str) -> WordEncoder:
    """One per worker process, so that its table outlives a task."""
    return WordEncoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    number = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
    for batch in batches:
        texts = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
        offsets, _ = string_buffers(texts)
        row, rows, out = 0, batch.num_rows, []
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
            ids, ends = encoder.encode(texts.slice(row, stop - row))
            ids = np.insert(ids.astype("<u4"), ends[1:], end_id)
            ends = (ends + np.arange(len(ends))).tolist()
            for i in range(stop - row):
                for k, at in enumerate(range(ends[i], ends[i + 1], most)):
                    part = ids[at : min(at + most, ends[i + 1])]
                    out.append((row + i, k, k * most, len(part), zlib.crc32(part)))
            row = stop
        pids = np.arange(number, number + len(out), dtype=np.int64)
        number += len(out)
        own, piece, start, length, crc = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(pids), batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["pid", "id", "piece", "start", "length", "ids_crc32"],
        )


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, end_id: int = 1) -> DataFrame:
    """(pid, id, piece, start, length, ids_crc32): one row for each piece; pid is unique."""
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(
        partial(_pieces, path=path, most=most, end_id=end_id), f"pid long, id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin that it fills best."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # sorted (free space, bin)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(free, (lengths[item], -1))
        if k < len(free):
            space, b = free.pop(k)
        else:
            space, b = most, len(bins)
            bins.append([])
        bins[b].append(item)
        if space > lengths[item]:
            insort(free, (space - lengths[item], b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], most: int, slack: int) -> list[list[int]]:
    """Moves and exchanges between bins with more than `slack` free, each raising the sum of squared fills."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_bins = [b for b in range(len(bins)) if most - fill[b] > slack]
    improved = True
    while improved and len(open_bins) > 1:
        improved = False
        open_bins.sort(key=lambda b: (-fill[b], b))
        place = sorted((lengths[i], b, i) for b in open_bins for i in bins[b])
        for b in open_bins:
            while most - fill[b] > slack:
                change = _best_change(b, bins, fill, lengths, place, most)
                if change is None:
                    break
                other, gives, takes = change
                for i in gives:
                    _shift(i, b, other, bins, fill, lengths, place)
                for i in takes:
                    _shift(i, other, b, bins, fill, lengths, place)
                improved = True
        open_bins = [b for b in open_bins if bins[b] and most - fill[b] > slack]
    return [b for b in bins if b]


def _shift(item: int, source: int, target: int, bins: list, fill: list, lengths: list, place: list) -> None:
    n = lengths[item]
    bins[source].remove(item)
    bins[target].append(item)
    fill[source] -= n
    fill[target] += n
    place.pop(bisect_left(place, (n, source, item)))
    insort(place, (n, target, item))


def _best_change(b: int, bins: list, fill: list, lengths: list, place: list, most: int) -> tuple[int, list[int], list[int]] | None:
    """(other bin, items given, items taken) that fills bin b most: a move, one for one, or two for one."""
    space, best = most - fill[b], (0, None)

    def offer(gives: list[int], given: int) -> None:
        nonlocal best
        at = bisect_right(place, (given + space, len(bins), 0)) - 1
        while at >= 0 and place[at][0] - given > best[0]:
            n, other, item = place[at]
            if other != b and fill[b] + n - given > fill[other] and fill[other] - n + given <= most:
                best = (n - given, (other, gives, [item]))
                return
            at -= 1

    offer([], 0)
    by_length: dict[int, list[int]] = {}
    for i in sorted(bins[b]):
        by_length.setdefault(lengths[i], []).append(i)
    mine = sorted(by_length)  # fewer than the root of 2 * most different ones
    for k, n in enumerate(mine):
        offer(by_length[n][:1], n)
        if len(by_length[n]) > 1:
            offer(by_length[n][:2], 2 * n)
        for m in mine[k + 1 :]:
            offer([by_length[n][0], by_length[m][0]], n + m)
    return best[1]


def _pack_shard(part: pd.DataFrame, most: int, slack: int, turn: int, last: bool) -> pd.DataFrame:
    part = part.sort_values("pid", ignore_index=True)
    lengths = part["length"].tolist()
    bins = local_search(best_fit(lengths, most), lengths, most, slack)
    bin_of, offset, closed = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), bool)
    for b, items in enumerate(bins):
        at = 0
        for i in sorted(items):
            bin_of[i], offset[i] = b, at
            at += lengths[i]
        closed[items] = last or most - at <= slack
    shard = int(part["shard"].iloc[0])
    return part.drop(columns="shard").assign(sequence_id=(turn << 58) + (shard << 16) + bin_of, offset=offset, closed=closed)


def pack(pieces: DataFrame, most: int = 4096, shard: int = 2048, slack: int = 4, rounds: int = 3) -> DataFrame:
    """pieces (a written table of token_pieces) with sequence_id and offset."""
    out = pieces.filter(F.col("length") >= most).withColumns({"sequence_id": -1 - F.col("pid"), "offset": F.lit(0).cast("long")})
    left = pieces.filter(F.col("length") < most)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    for turn in range(rounds):
        count = left.count()
        if not count:
            break
        shards = -(-count // shard)
        last = turn == rounds - 1 or shards == 1
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(shards)))
        packed = dealt.groupBy("shard").applyInPandas(
            partial(_pack_shard, most=most, slack=slack, turn=turn, last=last), f"{kinds}, sequence_id long, offset long, closed boolean"
        )
        packed = materialize(packed, f"round{turn}")
        out = out.unionByName(packed.filter("closed").drop("closed"))
        if last:
            break
        left = packed.filter("not closed").select(*pieces.columns)
    return out


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, **how) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(df, path, id_col, text_col, most), "pieces")
    return pack(pieces, most, **how).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
