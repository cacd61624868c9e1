"""Personal data by weak supervision.

One Arrow pass per text proposes candidate spans: every base match (email, ip, card, phone) and matches of looser
patterns for further kinds; names after a cue word or, without one, where a listed given name leads capitalised words.
Four labelers vote for, against or abstain on each: the strict format (regex), lists of known prefixes, endings and names
(gazetteer), words near the span (context), and the characters that touch it (edge).
Spark counts the vote patterns of the whole table; there are at most kinds x 3^4 x lengths x shapes of them, 14,580,
whatever the input. From these counts expectation-maximisation estimates, for each kind, how often each labeler votes
which way on true and on false spans (a Dawid-Skene model), and a logistic span classifier is trained on the resulting
probabilities. It is applied as a Spark expression. Base spans always stay; a further one is added at 0.5 or more.

Defined cases: null and empty texts have no spans. Repeated rows are treated one by one. With no candidates in the table
nothing is added; an empty table gives no rows. Very long texts are searched and masked whole, in time linear in text
and spans but for sorting the spans. Other columns, whatever their names, are left as they are. Offsets are code points, ends exclusive. Spans of different kinds may
overlap; for masking, the one that starts first wins, then the longer.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, ship_code

#: Base kinds first, in the order of reports.
KINDS = ("email", "ip", "card", "phone", "local_phone", "ssn", "iban", "secret", "name", "written_email")
LABELERS = ("regex", "gazetteer", "context", "edge")
LENGTHS, SHAPES = 5, 4

_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![+0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[=:]\x20{0,2}[\"']?([A-Za-z0-9_/+-]{12,})")
_NAME_CUES = ("name is ", "Name: ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor ", "Señora ")
_NAME = re.compile(r"[A-Z][a-z]+(?:\x20[A-Z][a-z]+){0,2}")
_FULL_NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]+(?:\x20[A-Z][a-z]+)+(?![A-Za-z])")
_AT, _DOT = (rf"(?:\x20{x}\x20|\x20?\[{x}\]\x20?|\x20?\({x}\)\x20?)" for x in ("at", "dot"))
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z]{{2,}}+)+")

# Public prefixes, endings and everyday names and cue words.
_ENDINGS = frozenset("com org net edu gov io info biz co us uk de fr es it eu ch at nl be ca au in jp cn br mx ru pl se no".split())
_COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "60", "61", "62", "64", "65", "66", "7", "81", "82", "86", "90", "91", "351", "353", "358", "420")
_CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
_IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "CH": 21, "NL": 18, "BE": 16, "AT": 20, "PL": 28, "PT": 25, "SE": 24, "LU": 20, "IE": 22, "DK": 18, "NO": 15, "FI": 18}
_GIVEN_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Laura Hans Klaus Jean Pierre Marie Juan Carlos Ana Luis Sofia Emma Noah Liam Olivia Daniel Alice Bob Nancy Lisa Betty Margaret Sandra Ashley Emily Kimberly Donna Michelle Carol Amanda Dorothy Melissa Deborah Christopher Matthew Anthony Mark Donald Steven Andrew Kenneth Joshua Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Ursula Monika Petra Sabine Wolfgang Jürgen Stefan Andreas Markus Claire Nathalie Isabelle Philippe François Michel Nicolas Carmen Isabel Pilar Javier Miguel Antonio Francisco José Diego Giulia Marco Luca Giovanni".split())
_CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("tel", "phone", "call", "fax", "mobile"), "local_phone": ("tel", "phone", "call", "fax", "mobile"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank", "konto"),
    "secret": ("token", "key", "secret", "passw", "pwd", "auth"), "name": ("name", "mr", "mrs", "ms", "dr"), "written_email": ("mail", "contact", "write"),
}
_DENIALS = ("version", "isbn", "order", "invoice", "page", "figure", "chapter", "section", "sha", "commit", "hash", "http", "doi")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start; linear in the text."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            after = host.end()
            out.append((0, start, after))
        at = text.find("@", max(at + 1, after))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _given(run: re.Match) -> int | None:
    """Where the first given name with a word after it starts in a run of capitalised words."""
    at, words = run.start(), run[0].split(" ")
    for word in words[:-1]:
        if word in _GIVEN_NAMES:
            return at
        at += len(word) + 1
    return None


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the looser patterns propose."""
    out = [(4, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    out += [(5, m.start(), m.end()) for m in _SSN.finditer(text)]
    out += [(6, m.start(), m.end()) for m in _IBAN.finditer(text)]
    out += [(7, m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    for cue in _NAME_CUES:
        at = text.find(cue)
        while at >= 0:
            if m := _NAME.match(text, at + len(cue)):
                out.append((8, m.start(), m.end()))
            at = text.find(cue, at + len(cue))
    cued, taken = {x[1] for x in out if x[0] == 8}, set()
    for m in _FULL_NAME.finditer(text):
        if (start := _given(m)) is not None and start not in cued and start not in taken:
            taken.add(start)
            out.append((8, start, m.end()))
    if "dot" in text:
        out += [(9, m.start(), m.end()) for m in _WRITTEN.finditer(text)]
    return out


def _vote(yes: bool, no: bool = False) -> int:
    return 2 if yes else 0 if no else 1


def _votes(text: str, kind: int, start: int, end: int) -> tuple[int, int, int, int]:
    """0 against, 1 abstain, 2 for, by labeler."""
    name, span = KINDS[kind], text[start:end]
    digits = _digits(span)
    near = f"{text[max(0, start - 32) : start]} {text[end : end + 16]}".lower()
    if name == "email":
        strict, known = _vote(".." not in span and not span.startswith(".")), _vote(span.rpartition(".")[2].lower() in _ENDINGS)
    elif name == "ip":
        strict, known = _vote(all(p == "0" or p[0] != "0" for p in span.split(".")), True), _vote(not span.startswith(("0.", "127.", "255.")), True)
    elif name == "card":
        strict, known = _vote(len(digits) in (15, 16), len(digits) in (13, 14)), _vote(digits.startswith(_CARD_PREFIXES), True)
    elif name == "phone":
        strict, known = _vote(10 <= len(digits) <= 13), _vote(digits.startswith(_COUNTRY_CODES), True)
    elif name == "local_phone":
        strict, known = _vote(digits[0] in "23456789", True), _vote(digits[3:6] == "555")
    elif name == "ssn":
        strict, known = _vote(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[-4:] != "0000", True), 1
    elif name == "iban":
        flat = span.replace(" ", "")
        strict = _vote(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1, True)
        known = _vote(_IBAN_LENGTHS.get(flat[:2]) == len(flat), True)
    elif name == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        strict, known = _vote(mixed and len(span) >= 16, not mixed), _vote(any(c in near for c in _CUES[name]), True)
    elif name == "name":
        strict, known = _vote(" " in span), _vote(span.split()[0] in _GIVEN_NAMES)
    else:
        strict, known = _vote(span.count("at") >= 1), _vote(span.lower().rpartition("dot")[2].strip(" )]").lower() in _ENDINGS, True)
    edge = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return strict, known, _vote(any(c in near for c in _CUES[name]), any(c in near for c in _DENIALS)), _vote(not edge, edge)


def _bucket(text: str, start: int, end: int) -> tuple[int, int]:
    span = text[start:end]
    digits = sum(c.isdigit() for c in span) / len(span)
    return min(LENGTHS - 1, len(span) // 8), min(SHAPES - 1, int(digits * SHAPES))


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,regex:int,gazetteer:int,context:int,edge:int,length:int,shape:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), *((x, pa.int32()) for x in (*LABELERS, "length", "shape"))]))


def _stretches(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, apart from each other and in order."""
    starts, ends = [], []
    for start, end in sorted(x[1:] for x in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _candidates(text: str | None) -> list[dict]:
    out = []
    if text:
        certain = base_spans(text)
        starts, ends = _stretches(certain)
        further = [x for x in further_spans(text) if not (at := bisect_left(starts, x[2])) or ends[at - 1] <= x[1]]
        for base, spans in ((True, certain), (False, further)):
            for kind, start, end in spans:
                told = zip((*LABELERS, "length", "shape"), (*_votes(text, kind, start, end), *_bucket(text, start, end)), strict=True)
                out.append({"kind": kind, "start": start, "end": end, "base": base, **dict(told)})
    return out


def candidates(text: Column) -> Column:
    """Array of candidate spans with their votes."""

    @F.arrow_udf(CANDIDATES)
    def found(column: pa.Array) -> pa.Array:
        return pa.array([_candidates(x.as_py()) for x in column], _ARROW)

    return found(text)


def estimate_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability that each pattern (kind, votes..) is personal data: Dawid-Skene by kind, with add-one smoothing."""
    truth = np.clip(0.5 + 0.22 * (patterns[:, 1:5] - 1).sum(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        new = truth.copy()
        for kind in np.unique(patterns[:, 0]):
            rows = patterns[:, 0] == kind
            w = counts[rows]
            p, votes = truth[rows], patterns[rows, 1:5]
            prior = (w @ p + 1) / (w.sum() + 2)
            log_odds = np.full(rows.sum(), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                for v in (0, 1, 2):
                    of_true = (w @ (p * (votes[:, j] == v)) + (1, 1, 2)[v]) / (w @ p + 4)
                    of_false = (w @ ((1 - p) * (votes[:, j] == v)) + (2, 1, 1)[v]) / (w @ (1 - p) + 4)
                    log_odds += (votes[:, j] == v) * np.log(of_true / of_false)
            new[rows] = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - truth).max() < 1e-6:
            break
        truth = new
    return truth


_SLOTS = [(len(KINDS) * 3)] * 4 + [len(KINDS) * LENGTHS, len(KINDS) * SHAPES]


def _design(patterns: np.ndarray) -> np.ndarray:
    """0/1 columns: kind by vote of each labeler, kind by length, kind by shape."""
    out, at = np.zeros((len(patterns), sum(_SLOTS))), 0
    for j, wide in enumerate((3, 3, 3, 3, LENGTHS, SHAPES)):
        out[np.arange(len(patterns)), at + patterns[:, 0] * wide + patterns[:, j + 1]] = 1
        at += _SLOTS[j]
    return out


def train_classifier(patterns: np.ndarray, counts: np.ndarray, truth: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model fitted to the probabilities, each pattern weighted by the root of its count."""
    x, w = _design(patterns), np.sqrt(counts) / np.sqrt(counts).sum()
    weights, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        slope = x.T @ (w * (1 / (1 + np.exp(-(x @ weights))) - truth)) + 1e-4 * weights
        speed = 0.9 * speed - slope
        weights = weights + speed
    return weights


def learn(found: Column, df: DataFrame) -> np.ndarray:
    """Weights from the candidate column of a whole table."""
    fields = ("kind", *LABELERS, "length", "shape")
    rows = df.select(F.explode(found).alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in fields)).agg(F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return np.zeros(sum(_SLOTS))
    rows.sort()
    patterns, counts = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float)
    return train_classifier(patterns, counts, estimate_reliabilities(patterns, counts))


def accepted(found: Column, weights: np.ndarray) -> Column:
    """The candidates that are base matches or that the classifier takes, by kind, then start."""
    parts, at = [], 0
    for wide, slots in zip((3, 3, 3, 3, LENGTHS, SHAPES), _SLOTS, strict=True):
        parts.append((wide, F.array(*(F.lit(float(w)) for w in weights[at : at + slots]))))
        at += slots

    def taken(c: Column) -> Column:
        odds = F.lit(0.0)
        for field, (wide, table) in zip((*LABELERS, "length", "shape"), parts, strict=True):
            odds = odds + F.get(table, c["kind"] * wide + c[field])
        return c["base"] | (odds > 0)

    return F.sort_array(F.transform(F.filter(found, taken), lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"])))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _counted(spans: Column, kind: int) -> Column:
    # A second parameter of the function, even one with a default, would be given the place in the array.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_ of each base kind, base_sha256, spans (text), n_added."""
    ship_code(df.sparkSession)
    found = materialize(df.select(df[id_col].alias("id"), candidates(df[text_col]).alias("found")), "candidates")
    weights = learn(F.col("found"), found)
    out = found.select("id", F.filter(accepted(F.col("found"), weights), lambda s: s["base"]).alias("base"), accepted(F.col("found"), weights).alias("spans"))
    counts = [_counted(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select(
        F.col("id").alias(id_col), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each accepted span of the text replaced by its kind in angle brackets; all columns stay.

    The rows are written once with their candidates beside them; learning and masking read that table. Only texts with an
    accepted span go through the masking pass, which is linear in text and spans.
    """
    ship_code(df.sparkSession)
    (name,) = free_names(df, "pii_found")
    held = materialize(df.withColumn(name, candidates(df[text_col])), "candidates")
    spans = accepted(F.col(name), learn(F.col(name), held))
    hit = F.size(spans) > 0
    masked = _masked(F.when(hit, F.col(text_col)), F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return held.withColumn(text_col, F.when(hit, masked).otherwise(F.col(text_col))).select(*df.columns)


def mask_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with spans (kind, start, end) as kinds in angle brackets; of overlapping ones the first, then longest, wins."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = -end
    return "".join([*out, text[at:]])


def _masked(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def masked(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if not t.is_valid else mask_spans(t.as_py(), [tuple(s.values()) for s in f.as_py()]) for t, f in zip(texts, found, strict=True)], pa.string())

    return masked(text, spans)
