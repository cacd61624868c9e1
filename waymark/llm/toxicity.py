"""Toxicity of deobfuscated text under a noisy-channel model.

1. A character trigram model is counted over all texts: every trigram of the corpus goes into a written table, together
   with the sums that back-off needs. Nothing of it passes the driver.
2. A text is cut at white space into tokens, and signs at their edges are taken off. Every token that is not plain
   (leetspeak digits and signs, separators inside, three or more equal letters) and every string of single letters
   between spaces or points becomes a lattice: each character may be read as one of several letters or dropped, a run of
   equal letters as one or two of them, each at a channel cost; between strung-out letters a word may end. The different
   tokens of the corpus are dealt into buckets of about `bucket`, each bucket is joined with just the trigrams that its
   lattices can pass, and a Viterbi search over pairs of last letters finds the reading with the best sum of channel and
   language-model score.
3. Plain words and restored words, and their first four and five letters, are the features. On labelled documents that
   may be learned from (at most `max_labelled` labels, 50,000 unless said otherwise, drawn by hash of the id and
   broadcast, so that no text is shuffled), Spark counts in how many toxic and how many other documents each occurs.
   Features of three or more toxic documents whose log-likelihood ratio beats the number of features tried are kept, so
   the sample bounds them too. The weight of a feature is the log of its rate among the words of toxic documents over
   that among the words of others.
4. The score of a document is the logistic of: the log odds of the labels, plus for each different plain word and each
   different noisy token the best weights of the forms of its words, less their number times the difference of the summed
   rates (a Poisson model of how many such words a text of this length has in either class).

Tokens, strings of letters and texts of any length are read whole; the search is linear in their length.

Defined cases: null and empty texts have no features and get the odds of the labels as score. Without labels of both
classes no features are kept and every score is 0.02. Labels whose id is null or unknown, and null labels, are ignored.
Repeated rows are scored one by one; a repeated document or label counts as often as it occurs. Of equally good readings
the one whose last letters have the lower code points wins; features of equal ratio are all kept. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, ship_code, string_buffers
from .ngrams import BITS, MASK, SPACE, gram_counts

# How single characters are read in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "v": "u", "µ": "u",
}
READ_COST, DROP_COST, SAME_COST, TWICE_COST, LEFT_COST = 0.7, 0.9, 0.4, 8.0, 9.0
RUN_BYTES = 1 << 23

_PLAIN = re.compile(r"[^\W\d_]+")
_BEFORE, _AFTER = "\"'([{#*%&.,;:?<>=~^_-", "\"')]}#*%&.,;:?!<>=~^_-"
_THRICE = re.compile(r"(.)\1\1")
_STRUNG = re.compile(r"(?<!\S)[^\W_](?:[\x20._*-]{1,2}[\w@$!|+]){3,}(?![^\s.,;:!?])")
_MAYBE_STRUNG = r"[\pL\pN](?:[ ._*-]{1,2}[\pL\pN_@$!|+]){3}(?:[\s.,;:!?_*-]|$)"  # what all that _STRUNG finds has
_SEPARATORS = frozenset("._-*~'`^,:;/\\ \u200b\u200c\u200d\u00ad")
_JOINTS = frozenset(" ._*-")

Score = Callable[[int, int, int], float]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character or run of equal ones, the letters it may stand for with their costs; empty means dropped.

    A token with a space is a string of single letters: between these nothing stands, or a word ends.
    """
    strung, out, at = " " in token, [], 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n = end - at
        if strung and c in _JOINTS:
            readings = [("", 0.0), (" ", 0.0)]
        elif c.isalpha() and c not in LEET:
            readings = [(c, 0.0)] if n == 1 else [(c, TWICE_COST), (c + c, 0.0)] if n == 2 else [(c, SAME_COST), (c + c, SAME_COST)]
        else:
            readings = [(x * k, READ_COST * (0 if x == c else 1) + SAME_COST * (k != n)) for x in (c if c.isalpha() else "") + LEET.get(c, "") for k in range(1, min(n, 2) + 1)]
            if not c.isalpha():
                readings.append(("", DROP_COST if c in _SEPARATORS else LEFT_COST))
        out.append(readings)
        at = end
    return out


def decode(token: str, score: Score) -> str:
    """The best reading of a token: Viterbi over (letter before last, last letter), with the way back kept by step."""
    beams: dict[tuple[int, int], float] = {(SPACE, SPACE): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for readings in lattice(token):
        new: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, held in sorted(beams.items()):
            for letters, cost in readings:
                (x, y), s = state, held - cost
                for letter in letters:
                    z = ord(letter)
                    s += score(x, y, z)
                    x, y = y, z
                if (x, y) not in new or s > new[x, y]:
                    new[x, y], back[x, y] = s, (state, letters)
        beams = new
        steps.append(back)
    state = min(beams, key=lambda ab: (-(beams[ab] + score(*ab, SPACE)), ab))
    out = []
    for back in reversed(steps):
        state, letters = back[state]
        out.append(letters)
    return "".join(reversed(out))


def needed(token: str) -> set[int]:
    """Packed trigrams that the search over a token can ask for; its states don't depend on scores."""
    asked: set[int] = set()

    def record(a: int, b: int, c: int) -> float:
        asked.add(a << 2 * BITS | b << BITS | c)
        return 0.0

    decode(token, record)
    states = {(a >> BITS & MASK, a & MASK) for a in asked} | {(SPACE, SPACE)}
    return asked | {a << 2 * BITS | b << BITS | SPACE for a, b in states}


def units(token: str) -> tuple[tuple[str, ...], str | None]:
    """(plain words, noisy token or none) of one token."""
    bare = token.lstrip(_BEFORE).rstrip(_AFTER)
    plain = tuple(_PLAIN.findall(bare))
    if not bare or (plain and plain[0] == bare and not _THRICE.search(bare)):
        return plain, None
    return plain, bare


def forms(word: str) -> tuple[str, ...]:
    """A word and, if it is longer, its first five and four letters."""
    return (word, word[:5] + "~", word[:4] + "~") if len(word) > 5 else (word, word[:4] + "~") if len(word) > 4 else (word,)


@dataclass
class Units:
    """Different plain words and noisy tokens by row: parallel arrays of rows and numbers, and what the numbers stand for."""

    rows: np.ndarray
    numbers: np.ndarray
    names: pa.Array
    noisy: np.ndarray


def _thrice(words: pa.Array) -> np.ndarray:
    """Which of these ASCII words have a byte three times in a row."""
    offsets, data = string_buffers(words)
    part = data[offsets[0] : offsets[-1]]
    same = np.flatnonzero((part[2:] == part[1:-1]) & (part[1:-1] == part[:-2])) + offsets[0]
    at = np.searchsorted(offsets, same, "right") - 1
    out = np.zeros(len(words), bool)
    out[at[same + 2 < offsets[at + 1]]] = True
    return out


def _token_units(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(numbers, how many of them by token, names, which names are noisy) of different tokens."""
    bare = pc.utf8_rtrim(pc.utf8_ltrim(tokens, characters=_BEFORE), characters=_AFTER).dictionary_encode()
    words = bare.dictionary
    usual = np.asarray(pc.ascii_is_alpha(words)) & ~_thrice(words)
    others = np.flatnonzero(~usual)
    names: dict[tuple[str, bool], int] = {}
    owned, counts, sizes = [], [], np.ones(len(words), np.int64)
    for token in words.take(pa.array(others)).to_pylist():
        plain, noisy = units(token)
        for w in plain:
            owned.append(names.setdefault((w, False), len(names)))
        if noisy:
            owned.append(names.setdefault((noisy, True), len(names)))
        counts.append(len(plain) + (noisy is not None))
    sizes[others] = counts
    plain_words = words.take(pa.array(np.flatnonzero(usual)))
    index = np.full(len(names), -1, np.int64)  # a word may also come out of a longer token
    if names:
        found = pc.index_in(pa.array([w for w, _ in names], words.type), plain_words).fill_null(-1).to_numpy(zero_copy_only=False)
        index = np.where(np.array([x for _, x in names]), -1, found)
    fresh = np.flatnonzero(index < 0)
    index[fresh] = len(plain_words) + np.arange(len(fresh))
    keys = list(names)
    all_names = pa.concat_arrays([plain_words, pa.array([keys[i][0] for i in fresh], words.type)])
    noisy = np.concatenate((np.zeros(len(plain_words), bool), np.array([keys[i][1] for i in fresh], bool)))
    ends = np.cumsum(sizes)
    flat = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    flat[(ends - sizes)[usual]] = np.arange(len(plain_words))
    if owned:
        flat[np.repeat(~usual, sizes)] = index[np.array(owned)]
    which = bare.indices.to_numpy()
    many = sizes[which]
    stops = np.cumsum(many)
    return flat[np.arange(stops[-1] if len(which) else 0) + np.repeat(ends[which] - stops, many)], many, all_names, noisy


def text_units(column: pa.Array) -> Iterator[tuple[int, int, Units]]:
    """(first row, end row, units) for runs of rows of about RUN_BYTES."""
    column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    offsets, _ = string_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
        part = column.slice(row, end - row)
        split = pc.utf8_split_whitespace(part)
        tokens = split.flatten().dictionary_encode()
        numbers, sizes, names, noisy = _token_units(tokens.dictionary)
        which = tokens.indices.to_numpy()
        of_row = np.repeat(np.arange(end - row), np.asarray(pc.list_value_length(split)))
        many = sizes[which]
        stops = np.cumsum(many)
        own = numbers[np.arange(stops[-1] if len(which) else 0) + np.repeat(np.cumsum(sizes)[which] - stops, many)]
        both = np.unique(np.repeat(of_row, many) << 32 | own)
        maybe = np.flatnonzero(np.asarray(pc.match_substring_regex(part, _MAYBE_STRUNG)))
        strung = sorted({(i, m[0]) for i in maybe.tolist() for m in _STRUNG.finditer(part[i].as_py()) if " " in m[0]})
        if strung:
            both = np.sort(np.concatenate((both, [i << 32 | len(names) + k for k, (i, _) in enumerate(strung)])))
            names = pa.concat_arrays([names, pa.array([t for _, t in strung], names.type)])
            noisy = np.concatenate((noisy, np.ones(len(strung), bool)))
        yield row, end, Units(both >> 32, both & 0xFFFFFFFF, names, noisy)
        row = end


def letter_scores(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, logp) of different packed trigrams `asked`, from a written table (gram, n) of all trigrams, by back-off."""
    g, total = F.col("gram"), counts.agg(F.sum("n").alias("n")).first()["n"] or 0

    def sums(key, name: str) -> DataFrame:
        return counts.groupBy(key.alias(f"{name}_key")).agg(F.sum("n").cast("double").alias(name))

    three = counts.select(F.col("gram").alias("three_key"), F.col("n").cast("double").alias("three"))
    keys = {
        "three": g, "after_two": F.shiftright(g, BITS), "two": g.bitwiseAND((1 << 2 * BITS) - 1),
        "after_one": F.shiftright(g, BITS).bitwiseAND(MASK), "one": g.bitwiseAND(MASK),
    }
    out = asked
    for name, key in keys.items():
        out = out.join(three if name == "three" else sums(key, name), key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    n = {name: F.coalesce(name, F.lit(0.0)) for name in keys}
    p = (n["one"] + 0.1) / (total + 20)
    p = (n["two"] + 5 * p) / (n["after_one"] + 5)
    return out.select("gram", F.log((n["three"] + 5 * p) / (n["after_two"] + 5)).alias("logp"))


def letter_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) of all trigrams of all texts, written."""
    counts = gram_counts(df.select(F.lit("").alias("label"), df[text_col].alias("text")))
    return materialize(counts.filter((F.col("gram") % (1 << BITS)) != 0).select("gram", "n"), "letters")


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, token) to (bucket, gram), each pair once a batch."""
    for batch in batches:
        found: dict[int, set[int]] = {}
        for bucket, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(bucket, set()).update(needed(token))
        buckets = [b for b, x in found.items() for _ in x]
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([g for x in found.values() for g in x], pa.int64())], ["bucket", "gram"])


def _read_bucket(tokens: pa.Table, scores: pa.Table) -> pa.Table:
    table = dict(zip(scores.column("gram").to_pylist(), scores.column("logp").to_pylist(), strict=True))
    names = tokens.column("token").to_pylist()
    read = [decode(t, lambda a, b, c: table[a << 2 * BITS | b << BITS | c]) for t in names]
    return pa.table({"token": pa.array(names, pa.string()), "words": pa.array([r.split() for r in read], pa.list_(pa.string()))})


def read_tokens(tokens: DataFrame, counts: DataFrame, bucket: int = 2000) -> DataFrame:
    """(token, words) of a written table of different noisy tokens, under the letter model of `counts`."""
    buckets = -(-max(1, tokens.count()) // bucket)
    dealt = tokens.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket"), "token")
    asked = materialize(dealt.mapInArrow(_asked, "bucket long, gram long").distinct(), "asked")
    scores = letter_scores(asked.select("gram").distinct(), counts)
    scored = asked.join(scores, "gram")
    return materialize(dealt.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(_read_bucket, "token string, words array<string>"), "readings")


def _noisy_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, u in text_units(batch.column(0)):
            yield pa.RecordBatch.from_arrays([u.names.filter(pa.array(u.noisy)).cast(pa.string())], ["token"])


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to document counts by class of plain words' forms, of noisy tokens, of documents and of units."""
    for batch in batches:
        toxic = [int(x) for x in batch.column(0).to_pylist()]
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for row, end, u in text_units(batch.column(1)):
            bounds, names = np.searchsorted(u.rows, np.arange(end - row + 1)), u.names.to_pylist()
            for i in range(end - row):
                own = u.numbers[bounds[i] : bounds[i + 1]]
                plain = {(f, False) for n in own[~u.noisy[own]].tolist() for f in forms(names[n])}
                found[toxic[row + i]].update([*plain, *((names[n], True) for n in own[u.noisy[own]].tolist()), ("", False)])
                found[toxic[row + i]]["#", False] += len(own)
        told = list({**found[0], **found[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.bool_()), *(pa.array([found[k][x] for x in told], pa.int64()) for k in (1, 0))],
            ["feature", "noisy", "toxic", "other"],
        )


@dataclass(frozen=True)
class ToxicWords:
    """What the score is made of: weights of features, log odds without any, and what each unit takes off."""

    weights: dict[str, float]
    base: float
    per_unit: float

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The best weight among the forms of each word; 0 where none is kept."""
        known = pa.array(self.weights, words.type)
        values = np.array([*self.weights.values(), -np.inf])
        sizes, best = np.asarray(pc.utf8_length(words)), np.full(len(words), -np.inf)
        for most in (None, 5, 4):  # the word, and its first letters where it has more
            form = words if most is None else pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, most), pa.scalar("~", words.type), pa.scalar("", words.type))
            at = pc.index_in(form, known).fill_null(-1).to_numpy(zero_copy_only=False)
            best = np.maximum(best, np.where(sizes > (most or 0), values[at], -np.inf))
        return np.where(np.isfinite(best), best, 0.0)


def learn_words(labelled: DataFrame, readings: DataFrame) -> ToxicWords:
    """From a table (toxic boolean, text) and the readings of all noisy tokens."""
    seen = labelled.mapInArrow(_count_features, "feature string, noisy boolean, toxic long, other long")
    seen = materialize(seen.groupBy("feature", "noisy").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "seen")
    word = F.col("word")
    longer = F.when(F.length(word) > 4, F.concat(F.substring(word, 1, 4), F.lit("~"))), F.when(F.length(word) > 5, F.concat(F.substring(word, 1, 5), F.lit("~")))
    restored = seen.filter("noisy").join(readings, F.col("feature") == F.col("token")).select("toxic", "other", F.explode(F.array_distinct("words")).alias("word"))
    restored = restored.select(F.explode(F.array_compact(F.array(word, *longer))).alias("feature"), "toxic", "other")
    counted = seen.filter("not noisy").select("feature", "toxic", "other").unionByName(restored)
    seen = materialize(counted.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")), "features")
    totals = {r["feature"]: r for r in seen.filter("feature in ('', '#')").collect()}
    if "" not in totals or not totals[""]["t"] or not totals[""]["o"]:
        return ToxicWords({}, math.log(0.02 / 0.98), 0.0)
    docs, number = totals[""], totals["#"]
    tried, rate = seen.count(), docs["t"] / (docs["t"] + docs["o"])
    t, o = F.col("t").cast("double"), F.col("o").cast("double")
    share = t / (t + o)
    ratio = 2 * (t * F.log(share / rate) + F.when(o > 0, o * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    strong = seen.filter("feature not in ('', '#') and t >= 3").filter(share > max(0.5, rate))
    rows = strong.filter(ratio > 2 * (math.log(tried) + 2)).collect()
    toxic, other = max(1, number["t"]), max(1, number["o"])
    weights = {r["feature"]: math.log((r["t"] + 0.5) / toxic) - math.log((r["o"] + 0.5) / other) for r in rows}
    # a word counts under its longest kept form only, so that no word is taken off twice
    single = [r for r in rows if not any(f in weights for f in forms(r["feature"].rstrip("~"))[1:] if f != r["feature"])]
    return ToxicWords(weights, math.log(rate / (1 - rate)), sum(r["t"] / toxic - r["o"] / other for r in single))


def _score_plain(batches: Iterable[pa.RecordBatch], learned: ToxicWords) -> Iterator[pa.RecordBatch]:
    """(id, text) to (rid, id, total, noisy): the score without what noisy tokens add, and these tokens."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        totals, lists = [], []
        for row, end, u in text_units(batch.column(1)):
            weights = np.where(u.noisy, 0.0, learned.of_words(u.names))
            totals.append(np.bincount(u.rows, weights[u.numbers] - learned.per_unit, end - row) + learned.base)
            noisy = u.noisy[u.numbers] if len(u.numbers) else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(np.bincount(u.rows[noisy], minlength=end - row)))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), u.names.take(pa.array(u.numbers[noisy])).cast(pa.string())))
        rids = np.arange(number, number + batch.num_rows)
        number += batch.num_rows
        noisy_lists = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(rids), batch.column(0), pa.array(np.concatenate(totals) if totals else np.zeros(0)), noisy_lists], ["rid", "id", "total", "noisy"])


def _token_weights(batches: Iterable[pa.RecordBatch], learned: ToxicWords) -> Iterator[pa.RecordBatch]:
    """(token, words) to (token, weight) of the tokens whose words, each counted once, have any."""
    for batch in batches:
        tokens, lists = batch.column(0).to_pylist(), [sorted(set(x)) for x in batch.column(1).to_pylist()]
        weights = learned.of_words(pa.array([w for x in lists for w in x], pa.string()))
        of_token = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        total = np.bincount(of_token, weights, len(lists))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([tokens[i] for i in at], pa.string()), pa.array(total[at])], ["token", "weight"])


def score_toxicity(
    df: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 50_000
) -> DataFrame:
    """One row for each row of df: id, score, predicted. learn_from: function of the id column, true where labels may be used."""
    ship_code(df.sparkSession)
    bare = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    tokens = materialize(bare.select("text").mapInArrow(_noisy_tokens, "token string").distinct(), "tokens")
    readings = read_tokens(tokens, letter_counts(bare))
    marks = labels.filter(labels[id_col].isNotNull() & labels["toxic"].isNotNull()).select(labels[id_col].alias("k"), (labels["toxic"] == 1).alias("toxic"))
    draw = F.crc32(F.concat_ws(":", F.lit("toxic"), "k").cast("binary"))
    sample = materialize(marks.filter(learn_from(F.col("k"))).orderBy(draw, "k", "toxic").limit(max_labelled), "labelled")
    labelled = bare.join(F.broadcast(sample), F.col("id") == F.col("k")).select("toxic", "text")  # at most max_labelled short rows
    learned = learn_words(labelled, readings)
    kind = df.schema[id_col].dataType.simpleString()
    scored = materialize(bare.mapInArrow(partial(_score_plain, learned=learned), f"rid long, id {kind}, total double, noisy array<string>"), "scored")
    heavy = materialize(readings.mapInArrow(partial(_token_weights, learned=learned), "token string, weight double"), "token_weights")
    asked = scored.select("rid", F.explode("noisy").alias("name"))
    added = salted_join(asked, heavy, {"name": "token"}, F.col("rid")).groupBy(F.col("rid").alias("r")).agg(F.sum("weight").alias("added"))
    out = scored.join(added, F.col("rid") == F.col("r"), "left")
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("total") + F.coalesce("added", F.lit(0.0))))
    score = 1 / (1 + F.exp(-odds))
    return out.select(F.col("id").alias(id_col), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
