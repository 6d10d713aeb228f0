"""SuperMinHash copies, periodic runs and slot negatives against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlake.llm import common, copies, periodic_runs, queries, slot_negatives, superminhash

EDGE = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two words"), (5, "ONE"), (6, "a " * 3000), (7, "ü ß " * 700)]


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    queries.ready(spark)


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({n: F.lit(1) for n in ("id", "node", "low", "n", "key", "at", "h", "root", "runs", "score", "slot", "best", "round") if n not in df.columns})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


# SuperMinHash

def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    for same in (20, 60, 120):
        both, one, two = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (same, 30, 30))
        h, row = np.concatenate([both, one, both, two]), np.repeat([0, 1], same + 30)
        found = superminhash.signatures(h, row, 2, 1000)
        assert (found != superminhash.EMPTY).all()
        assert abs((found[0] == found[1]).mean() - same / (same + 60)) < 0.06
    # the order of the elements does not matter, and a single element fills every slot with each rank once
    order = np.random.default_rng(1).permutation(len(h))
    order = order[np.argsort(row[order], kind="stable")]
    assert (superminhash.signatures(h[order], row, 2, 1000) == found).all()
    alone = superminhash.signatures(h[:1], np.zeros(1, np.int64), 1, 250)
    assert sorted((alone[0] >> np.uint64(32)).tolist()) == list(range(250))


def sets_of(rows, n=2):
    out = []
    for _, text in rows:
        w = words_of(text)
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(rows, percent):
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (id, _) in enumerate(rows):
        least[find(i)].append(id)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((id, len(s), low[find(i)]) for i, ((id, _), s) in enumerate(zip(rows, sets))), key=str)


def found_of(df):
    return sorted(((r["id"], r["n_shingles"], r["component"]) for r in df.collect()), key=str)


def edited(r, text, share):
    return [w if r.random() > share else f"x{r.randint(0, 10 ** 6)}" for w in text]


@pytest.mark.parametrize("seed, short, per_part", [(1, 32, 2000), (2, 3, 5)])
def test_near_duplicates(spark, monkeypatch, seed, short, per_part):
    """Groups of copies, chains, and a family of texts alike without being copies; short lists force the rare elements."""
    monkeypatch.setattr(copies, "SHORT", short)
    monkeypatch.setattr(copies, "PER_PART", per_part)
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        texts += [edited(r, base, r.choice([0, 0.02, 0.05, 0.08])) for _ in range(r.randint(1, 9))]
        texts += [base + [r.choice(vocabulary) for _ in range(len(base) // 5)], base[:len(base) * 4 // 5]]
    template = [r.choice(vocabulary) for _ in range(80)]
    for k in range(90):  # similarity of about 0.7 within the family, some pairs above the threshold
        own = [f"own{k}-{j}" for j in range(r.choice([10, 12, 16, 20]))]
        texts.append(template[:40] + own + template[40:])
        if k % 9 == 0:
            texts.append(edited(r, template[:40] + own + template[40:], 0.01))
    texts += [[], ["solo"], ["SOLO"], ["pair", "two"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + EDGE + [(None, "w1 w2 w3"), (None, "w1 w2 w3")]
    r.shuffle(rows)
    assert found_of(superminhash.near_duplicates(frame(spark, rows))) == brute_components(rows, 80)


def test_large_groups_are_not_squared(spark):
    """A thousand near copies, a thousand copies and a thousand alike texts: every copy is joined."""
    r = random.Random(9)
    base, template = ([f"{p}{r.randint(0, 10 ** 6)}" for _ in range(60)] for p in "bt")
    rows = [(k, " ".join(edited(r, base, 0.02))) for k in range(600)] + [(k, "same text again") for k in range(600, 1600)]
    rows += [(k, " ".join([*template, *(f"o{k}-{j}" for j in range(14))])) for k in range(1600, 2200)]
    assert found_of(superminhash.near_duplicates(frame(spark, rows))) == brute_components(rows, 80)


def test_near_duplicates_edges(spark):
    assert found_of(superminhash.near_duplicates(frame(spark, EDGE))) == brute_components(EDGE, 80)
    assert superminhash.near_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        superminhash.near_duplicates(frame(spark, EDGE), percent=20)


# periodic runs

def brute_runs(w, least=6, times=4):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, length, q) for (a, length), q in found.items())


def runs_in(texts, least=6, times=4):
    number, ids, edges = {}, [], [0]
    for t, w in enumerate(texts):
        ids += [number.setdefault((t, x), len(number)) for x in w]
        edges.append(len(ids))
    got = periodic_runs.runs_of(np.array(ids, np.int64), np.array(edges, np.int64), least, times).tolist()
    return [[tuple(x[1:]) for x in got if x[0] == t] for t in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4), st.sampled_from([(6, 4), (1, 3), (6, 3), (10, 5)]))
def test_runs_of_small_alphabets(texts, limits):
    assert runs_in(texts, *limits) == [brute_runs(w, *limits) for w in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    assert runs_in([w, w[::-1]]) == [brute_runs(w), brute_runs(w[::-1])]


def test_a_long_run_is_read_once():
    w = ["a"] * 200_000 + ["b"] + ["a", "c"] * 50_000
    assert runs_in([w]) == [[(0, 200_000, 1), (200_001, 100_000, 2)]]


def collapsed(w, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_find_runs(spark):
    r = random.Random(3)
    rows = list(EDGE)
    for k in range(60):
        w = [r.choice(["x", "Y", "zé"]) for _ in range(r.randint(0, 80))]
        rows.append((k, r.choice([" ", "\n", " \t "]).join(w * r.randint(1, 6)) + r.choice(["", " "])))
    rows.append((99, "long " + "one two three " * 300_000))  # beyond one pass
    got = periodic_runs.find_runs(frame(spark, rows)).collect()
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = [[(1, 900_000, 3)] if len(w) > 100_000 else brute_runs(w) for w in plain]
    key = lambda x: (str(x[0]), x[1], x[3])
    assert sorted(((x["id"], x["n_words"], [tuple(s) for s in x["runs"]], x["collapsed"]) for x in got), key=key) == sorted(
        ((id, len(w), runs, collapsed(w, runs)) for (id, _), w, runs in zip(rows, plain, want)), key=key)
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


def test_run_query(spark, tmp_path):
    """The query's repeated stretches and digests by a plain loop."""
    r = random.Random(8)
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 10 == 0][:40] + list(range(20))
    rows = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90)))) for k in sorted(set(ids))] + [(5000, None), (None, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for id, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str("" if id is None else id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        want[id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    got = {x["doc_id"]: tuple(x)[1:] for x in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == want and sum(x[0] > 0 for x in want.values()) > 15


# hard negatives

def brute_negatives(rows, anchors, positives=5, negatives=10):
    rows = [x for x in rows if None not in x and None not in x[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in (x for x in rows if anchors(x[0])):
        scored = sorted((-dot(va, v), i, lab) for i, lab, v in rows)
        for s, p, lab in [x for x in scored if x[2] == la and x[1] != a][:positives]:
            fit = [(t, n) for t, n, other in scored if other != la and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed, span, tile, pending, bytes_", [(1, 40, 1 << 21, 1 << 18, 8 << 20), (2, 6, 50, 10, 200), (3, 1 << 26, 1 << 10, 1, 1 << 9), (4, 2, 100, 5, 1000)])
def test_negatives(spark, monkeypatch, seed, span, tile, pending, bytes_):
    """Many ties, overlapping and empty windows, several rounds of anchors, small tiles and large numbers."""
    for name, value in (("TILE", tile), ("PENDING", pending), ("ROUND_BYTES", bytes_)):
        monkeypatch.setattr(slot_negatives, name, value)
    r = random.Random(seed)
    rows = [(k, r.randint(0, 3), [r.randint(-span // 3, span) for _ in range(4)]) for k in range(180)]
    rows += [(3, 1, [1, 1, 1, 1]), (None, 1, [1] * 4), (200, None, [1] * 4), (201, 1, None), (202, 1, [1, None, 1, 1]), (203, 1, [2, 2]),
             (210, 2, []), (220, 9, [span] * 6), (230, 1, [0] * 4)]
    df = frame(spark, rows, "vec_id long, label int, vector array<long>")
    got = slot_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(x) for x in got) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) > 100


def test_products_are_exact():
    for high in (1 << 20, 1 << 26, 1 << 27):
        a = np.array([[high, high - 1, 3, -high], [high, 0, 0, 1]], np.int64)
        b = np.array([[high, -high, 1, high - 1], [1, 2, 3, 4]], np.int64)
        assert slot_negatives._products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a]


def test_negatives_edges(spark):
    schema = "vec_id long, label int, vector array<long>"
    anchor = F.col("vec_id") % 10 == 0
    assert slot_negatives.mine(frame(spark, [], schema), anchor).count() == 0
    assert slot_negatives.mine(frame(spark, [(10, 1, [1]), (11, 2, [1])], schema), anchor).count() == 0  # no positive
    assert slot_negatives.mine(frame(spark, [(10, 1, [1]), (11, 1, [1])], schema), anchor).count() == 0  # no negative
    with pytest.raises(Exception, match="64 bits"):
        slot_negatives.mine(frame(spark, [(10, 1, [1 << 40]), (11, 1, [1 << 40])], schema), anchor).count()


def test_negative_query(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) + (k % 3) for _ in range(5)], r.randint(0, 9)) for k in range(400)]
    rows += [(500, [inf] * 5, 1), (600, [nan] * 5, 1), (700, [1.0, None, 1.0, 1.0, 1.0], 2), (800, None, 1), (900, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v])
             for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == brute_negatives(plain, lambda i: i % 100 == 0) and got


def test_squeezed_texts():
    """Texts of any kind come back whole, and texts that hold far more than their frames stay within a pass."""
    texts = ["", None, "a b c", "ÄÖ " * 50, "word " * 40_000, "x " * 90_000, "end"]
    column = common.squeezed(pa.array(texts))
    assert sum(len(x) for x in column.to_pylist()) < 2_000
    batch = pa.record_batch([pa.array(range(len(texts))), column, column], ["k", "ta", "tb"])
    parts = list(common.unsqueezed([batch, batch.slice(0, 0)], ["ta", "tb"], 1_000))
    assert [p.num_rows for p in parts] == [4, 1, 1, 1]
    for t in ("ta", "tb"):
        assert [x for p in parts for x in p.column(t).to_pylist()] == [(x or "").encode() for x in texts]
    assert [x for p in parts for x in p.column("k").to_pylist()] == list(range(len(texts)))


def test_copies_move_squeezed_texts(spark, monkeypatch):
    """What the search stores and shuffles of a text is its frame, and keys come with the node instead of by a join."""
    held = {}

    def kept(df, name):
        held.setdefault(name, []).append(df)
        return common.stage(df, name)

    monkeypatch.setattr(copies, "stage", kept)
    words = [f"word{k}" for k in range(400)]
    docs = [(k, " ".join(words[:380 - k % 3] + [f"own{k}"])) for k in range(12)]
    got = {x["id"]: x["component"] for x in superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(12), 0)
    assert held["texts"][0].schema["text"].dataType.typeName() == "binary"
    frames = held["texts"][0].selectExpr("sum(length(text))").first()[0]
    assert frames < 0.6 * sum(len(t) for _, t in docs)
    assert "keys" in held["nodes"][0].columns
