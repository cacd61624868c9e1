"""SentencePiece merge-type encoding with seeded merge-dropout, and its decoding.

A text is cut between characters that no piece of the model has side by side, so that no merge crosses a cut. Each part
is merged by an agenda of adjacent pairs, best score first, leftmost first. Each candidate merge that comes up is skipped
for good if a keyed hash of (seed, row id, place of the pair in the text, merged piece) falls below the rate. The key
belongs to the occurrence, so a word is segmented anew wherever it stands, yet the same row gives the same ids in any
task and after any loss of an executor. At rate 0 the ids are those of the SentencePiece library.

The agendas of all parts of a batch advance together (merges.py). Very long parts take the same candidates one by one.

Characters outside the vocabulary, and the literal sign U+2581 that pieces use for a space, become byte pieces, so that
decoding gives back every text exactly.

Defined cases: null and empty texts have no ids and decode to the empty text; null ids decode to null. Very long texts
are encoded whole. Repeated rows, and rows that repeat an id and a text, are encoded alike; a null row id counts as one
fixed key. Pairs of equal score are taken leftmost first. Columns of any name may stand beside. An empty table gives no
rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import ship_code, string_buffers
from .merges import Dropout, Merges, PairTable

META = "▁"
RUN_BYTES = 1 << 19


class MergeModel:
    """Pieces and scores of a SentencePiece model file of the merge type with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        ids, scores, shown, self.byte_ids = {}, {}, [b""] * size, np.zeros(256, np.int32)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                shown[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                ids[piece], scores[piece] = i, -model.get_score(i)
                shown[i] = piece.replace(META, " ").encode()
        self.piece_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.piece_ends = np.cumsum([len(x) for x in shown])
        self.piece_sizes = np.array([len(x) for x in shown])
        self.size = size
        symbols = dict(ids)  # characters that only longer pieces have are symbols too, written as bytes
        for c in sorted({c for p in ids for c in p} - set(ids)):
            symbols[c] = size + len(symbols)
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1 and p != META:
                self.symbol_of[ord(p)] = i
        self.space = symbols[META]
        self.symbol_of[32] = self.space
        merges, beside = {}, {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                beside[symbols[p[k - 1]], symbols[p[k]]] = 1
                if p[:k] in symbols and p[k:] in symbols:
                    merges[symbols[p[:k]], symbols[p[k:]]] = ranks[scores[p]], i
        self.merges, self.beside = Merges(merges), PairTable(beside)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of rows of ids that end at `ends`; one leading space of each goes. Runs of rows of about RUN_BYTES ids at a time."""
        row, rows, out = 0, len(ends) - 1, []
        while row < rows:
            end = max(row + 1, int(np.searchsorted(ends, ends[row] + RUN_BYTES, "right")) - 1)
            out.append(self._decode_run(ids[ends[row] : ends[end]], ends[row : end + 1] - ends[row]))
            row = end
        return pa.concat_arrays(out) if out else pa.array([], pa.large_string())

    def _decode_run(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        sizes = self.piece_sizes[ids]
        stops = np.cumsum(sizes)
        data = self.piece_bytes[np.arange(stops[-1] if len(ids) else 0) + np.repeat(self.piece_ends[ids] - stops, sizes)]
        edges = np.concatenate(([0], stops))[ends]
        heads = edges[:-1][edges[1:] > edges[:-1]]
        heads = heads[data[heads] == 32]
        keep = np.ones(len(data), bool)
        keep[heads] = False
        edges = edges - np.searchsorted(heads, edges)
        out = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes()))
        out.validate(full=True)
        return out


@cache
def merge_model(path: str) -> MergeModel:
    return MergeModel(path)


def encode_texts(column: pa.Array, keys: np.ndarray, model: MergeModel, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row ends, from 0); runs of rows of about RUN_BYTES at a time."""
    offsets, data = string_buffers(column)
    row, rows, found, counts = 0, len(offsets) - 1, [], [np.zeros(1, np.int64)]
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
        ids, per_row = _encode_run(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], keys[row:end], model, rate)
        found.append(ids)
        counts.append(per_row)
        row = end
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.cumsum(np.concatenate(counts))


def _encode_run(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, model: MergeModel, rate: float) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    filled = np.diff(bounds) > 0
    heads = bounds[:-1][filled]  # a space goes before each text that has something
    codes = np.insert(codes, heads, 32)
    bounds = bounds + np.concatenate(([0], np.cumsum(filled)))
    symbols = model.symbol_of[codes]
    row_of = np.repeat(np.arange(len(keys)), np.diff(bounds))
    places = np.arange(len(codes)) - bounds[row_of]
    joined = np.zeros(len(codes) + 1, bool)
    joined[1:-1] = (model.beside.get(symbols[:-1], symbols[1:]) >= 0) & (places[1:] > 0)
    starts, ends = np.flatnonzero(~joined[:-1] & joined[1:]), np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
    astray = symbols < 0  # characters without a symbol
    limit = int(rate * 2**32)
    model.merges.apply(symbols, starts, ends, Dropout(keys[row_of[starts]], places[starts], limit) if limit else None)
    written = astray | (symbols >= model.size)  # as bytes
    sizes = np.where(written, 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF), symbols >= 0)
    stops = np.concatenate(([0], np.cumsum(sizes)))
    out = np.repeat(symbols, sizes)
    at = np.flatnonzero(written)
    if len(at):
        parts = np.frombuffer("".join(map(chr, codes[at].tolist())).encode("utf-8"), np.uint8)
        first = np.cumsum(sizes[at]) - sizes[at]
        out[np.arange(len(parts)) + np.repeat(stops[at] - first, sizes[at])] = model.byte_ids[parts]
    return out, np.diff(stops[bounds])


def encode_with_dropout(text: Column, row_id: Column, path: str, rate: float = 0.1, seed: int = 7) -> Column:
    """Array of piece ids for a column of texts; the hash of (seed, row_id) keys the choices of a row."""
    ship_code(SparkSession.active())

    @F.arrow_udf("array<int>")
    def encoded(keys: pa.Array, column: pa.Array) -> pa.Array:
        ids, ends = encode_texts(column, keys.to_numpy(zero_copy_only=False), merge_model(path), rate)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))

    return encoded.asNondeterministic()(F.xxhash64(F.lit(seed), row_id), text)  # else each use of the column would encode again


def decode_ids(ids: Column, path: str) -> Column:
    """Column of texts of a column of ids."""
    ship_code(SparkSession.active())

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        ends = np.asarray(column.offsets, dtype=np.int64)
        values = np.asarray(column.values)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.int32)
        texts = merge_model(path).decode(values, ends - ends[0])
        return pa.array(texts.to_pylist(), pa.string(), mask=~column.is_valid().to_numpy(zero_copy_only=False)) if column.null_count else texts.cast(pa.string())

    return decoded(ids)
