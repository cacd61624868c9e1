"""Source divergence, ranked search and SimHash against SQL, brute force, and on the odd cases of their docstrings."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import common, components, divergence, lexical_search, simhash
from waymark.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
LONG = "wort und haus sind lang " * 12_000


@pytest.mark.parametrize("name", ["op4_heavy_hitter_dedup", "op11_digest_source_divergence", "op12_bag_dedup_search"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = registered.queries()[name](spark, FOLDER)
    told = c.execute(registered.oracle_sql()[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(r[names.index(x)] for x in df.columns) for r in told.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == expected


def odd(spark):
    rows = [(1, "Ärger A b1 c", "de", "s"), (1, "Ärger A b1 c", "de", "s"), (2, None, "de", None), (3, "", None, "t"), (None, "a ärger", None, None), (4, " \t\n", "fr", "s"), (5, LONG, "de", "t"), (None, None, None, None)]
    return spark.createDataFrame([(*x, "q", "c", 1) for x in rows], "doc_id long, text string, lang string, source string, digest string, term string, cls int")


ITEMS = [(1, "a ärger"), (1, "haus"), (2, None), (3, "B1, b1"), (None, "wort WORT c"), (4, "none of these")]


def items(spark):
    return spark.createDataFrame([(*x, "w") for x in ITEMS], "item_id long, text string, words string")


def letters(text):
    return [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


LOWER = {k: k + 32 for k in range(65, 91)}


def plain_divergence(rows, least, top):
    """As the contract words it, with dictionaries."""
    docs = [(lang or "", source or "", letters(text)) for text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        kept = sorted(t for t in {t for x in own for t in x[2]} if sum(t in x[2] for x in own) >= least)

        def shares(chosen, kept=kept):
            counts = {t: sum(x[2].count(t) for x in chosen) for t in kept}
            total = sum(counts.values())
            return counts, {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        _, q = shares(own)
        by_source = {s: shares([x for x in own if x[1] == s]) for s in {x[1] for x in own}}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s, (counts, p) in by_source.items():
            pairs = [(o, sum(gap(p[t], by_source[o][1][t]) for t in kept)) for o in by_source if o != s]
            terms = [(t, gap(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def test_divergence_equals_brute_force_with_colliding_digests(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdeéß" for b in "xyzw"] + ["Ab", "AB"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["de", "fr", None]), rng.choice(["s", "t", "u", None])) for _ in range(120)]
    rows += [(None, "it", "s"), ("", "it", "t"), ("einmal", "es", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    expected = plain_divergence(rows, 4, 5)
    for bits in (64, 3):
        got = divergence.source_divergence(df, least_docs=4, top=5, bits=bits).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_divergence_of_odd_rows(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd(spark).collect()]
    for least in (1, 10):
        got = divergence.source_divergence(odd(spark), least_docs=least).collect()
        assert {tuple(r) for r in got} == plain_divergence(rows, least, 10)
    assert divergence.source_divergence(odd(spark).limit(0)).count() == 0


def test_one_term_run_for_each_text_that_touches_the_next(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ab", "cd", "", "ef gh", None, "x"])], "k int, t string").coalesce(1)
    out = divergence.source_divergence(df.select(F.lit("l").alias("lang"), F.lit("s").alias("source"), F.col("t").alias("text"), "k"), least_docs=1)
    assert out.count() == 0  # one source: no pairs, and p = q
    counted = divergence.kept_counts(df.withColumns({"lang": F.lit("l"), "source": F.lit("s")}), "t", "lang", "source", 1, 64)
    assert {r["name"] for r in counted[2].collect()} == {"ab", "cd", "ef", "gh", "x"}


def plain_search(docs, asked, top):
    import math

    words = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, words(t)) for i, t in docs]
    bags = [x for x in bags if x[1]]
    n_docs, total = len(bags), sum(len(x[1]) for x in bags)
    by_item = {}
    for item, text in asked:
        by_item.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in by_item.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in terms}
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * len(b) * n_docs) // total
            score = sum(w[t] * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in terms if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 6, 1 << 20])
def test_search_equals_brute_force(spark, block):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["É", "é", "W1"]
    docs = [(rng.choice([None, *range(60)]), " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40])))) for _ in range(150)]
    docs += [(200 + k % 40, "w1 w2 ,w3") for k in range(60)] + [(None, "w1 w2 w3")] * 3  # one large class, with repeated and null ids
    asked = [*ITEMS, (7, "w1 w2"), (8, "w3 É w9 w9 w11"), (9, " ".join(words))]
    got = lexical_search.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), top=20, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, asked, 20)


def test_search_in_odd_rows(spark):
    got = lexical_search.lexical_search(odd(spark), items(spark))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, ITEMS, 50)
    assert lexical_search.lexical_search(odd(spark).limit(0), items(spark)).count() == 0
    assert lexical_search.lexical_search(odd(spark), items(spark).limit(0)).count() == 0


def plain_fingerprint(text):
    words = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(ids, fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= distance:
                root[find(x)] = find(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"wort{k}" for k in range(200)] + ["É", "ß"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 60, 400]))) for _ in range(60)]
    for text in texts[:30]:
        for _ in range(3):
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append("\t" + " \n".join(parts).upper().replace("É", "é") + " ")
    texts += [None, "", " \r\n\x0b\x0c", "a", "a b", "a b c", LONG]
    ids = [rng.choice([None, *range(500)]) for _ in texts]
    rows = simhash.simhash_dedup(spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int")).collect()
    fps = [plain_fingerprint(t) for t in texts]
    expected = zip(ids, [f"{x:016x}" for x in fps], plain_components(ids, fps), strict=True)
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(expected, key=repr)
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("small", "crowd"), [(32, 4096), (2, 3), (3, 12)])
def test_links_connect_all_within_three_bits_also_when_variants_are_cut_further(spark, small, crowd):
    rng = random.Random(small)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                at ^= 1 << b
            if rng.random() < 0.3:
                at ^= rng.getrandbits(32) << rng.choice([0, 32])
    fps |= {0, 7, 15, 2**64 - 1, 2**63}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = common.materialize(simhash.links_of(spark.createDataFrame([(x,) for x in signed], "fp long"), small=small, crowd=crowd), "links")
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    roots = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    assert [roots.get(x, x) for x in signed] == plain_components(signed, fps)


def test_fingerprints_do_not_depend_on_the_run(spark):
    import numpy as np

    text = ("Ein Text mit vielen Wörtern und noch mehr " * 7).encode()
    assert {simhash.fingerprint(np.frombuffer(text, np.uint8), run=r) for r in (1, 5, 1 << 16)} == {(lambda x: x - 2**64 if x >= 2**63 else x)(plain_fingerprint(text.decode()))}
