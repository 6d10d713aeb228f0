"""The operators for training text against brute force, and their edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldlake.llm import (
    bpe, byte_dedup, common, copies, decontaminate, graph, language_model, line_chunks, neighbours, packing, queries, simhash, suffix_array,
    token_counts, toxicity, url_filter)

SYLLABLES = "th an er in re on ou ti es la ße 東 ".split()
EDGE = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x\ny\nz\nx\ny\nz"), (6, "a" * 3000), (7, "ü " * 700)]


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    queries.ready(spark)


def words_of(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows, **extra):
    """Documents with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({n: F.lit(1) for n in ("id", "fp", "low", "n", "rank", "bucket", "n_lines", "word", "mark", "component")})


def empty(spark):
    return frame(spark, [])


# suffix arrays

def naive_removed(texts, width):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - width + 1):
            seen[t[p:p + width]].append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, p in at:
                gone[d][p:p + width] = True
    return gone


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    parts = [bytes(r.choice(b"ab" if k % 2 else b"a") for _ in range(r.randint(0, 60))) for k in range(30)]
    symbols, edges = suffix_array.joined(parts)
    key, sep, bits, reach = suffix_array.first_keys(symbols)
    order = suffix_array.suffix_array(key, sep, reach)
    ends = np.repeat(edges[1:], np.diff(edges))
    suffixes = [tuple(-1 if s == 256 else int(s) for s in symbols[p:ends[p]]) for p in order]
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert [s[:50] for s in suffixes] == sorted(s[:50] for s in suffixes)
    shared = suffix_array.common_prefixes(key, ends - 1 - np.arange(len(symbols)), order, bits, reach, 50)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        n = 0
        while n < min(len(a), len(b), 50) and a[n] == b[n] != -1:
            n += 1
        assert shared[k] == n


@pytest.mark.parametrize("seed, shard_contexts", [(1, 4096), (2, 2), (3, 1), (4, 3)])
def test_byte_dedup(spark, seed, shard_contexts):
    r = random.Random(seed)
    shared = [words_of(r, 25) for _ in range(4)]
    texts = ["ab" * 90, "a" * 70, "a" * 100, "xyz" * 40 + "q", "", words_of(r, 3)]
    for _ in range(40):
        parts = [words_of(r, r.randint(0, 20)), r.choice(shared)[r.randint(0, 30):], words_of(r, r.randint(0, 9)), r.choice(shared)]
        texts.append("".join(r.sample(parts, r.randint(1, 4))))
    texts += texts[10:14]
    bodies = [t.encode() for t in texts]
    gone = naive_removed(bodies, 30)
    found = byte_dedup.dedup_bytes(frame(spark, list(enumerate(texts))), width=30, gram=8, shard_contexts=shard_contexts).collect()
    assert len(found) == len(texts)
    for row in found:
        mask = gone[row["id"]]
        assert row["n_bytes"] == len(bodies[row["id"]])
        assert row["n_removed"] == mask.sum(), (row["id"], texts[row["id"]])
        assert bytes(row["kept"]) == bytes(np.frombuffer(bodies[row["id"]], np.uint8)[~mask])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert [(s["low"], s["high"]) for s in row["spans"]] == list(zip(runs[::2].tolist(), runs[1::2].tolist()))


def test_byte_dedup_edges(spark):
    rows = EDGE + [(8, "b" * 250), (8, "b" * 250), (None, "c" * 199)]
    found = byte_dedup.dedup_bytes(frame(spark, rows)).collect()
    gone = {(r["id"], r["n_bytes"]): r["n_removed"] for r in found}
    assert len(found) == len(rows) and gone[8, 250] == 250 and gone[6, 3000] == 3000 and gone[None, 199] == 0 and gone[1, 0] == 0
    assert byte_dedup.dedup_bytes(empty(spark)).count() == 0


# URL filter

def test_url_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/a?x", "https://m.example.com/en/1", "https://example.com/de/", "ftp://x.net/es/1", "http://a.net/fr/#t",
            "http://com", "http://notexample.com/en/", "http://x.org/a//b?c", "mailto:x", None, "http://É.com/Ü", "http://net/es/", "a://b://c/d"]
    got = url_filter.verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")))
    rows = {r["id"]: (r["host"], r["path"], r["rule"]) for r in got.collect()}
    assert [rows[k] for k in range(len(urls))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("m.example.com", "/en/1", "example.com/en/"), ("example.com", "/de/", "com/"),
        ("x.net", "/es/1", "net/es/"), ("a.net", "/fr/", "net/fr/"), ("com", "", None), ("notexample.com", "/en/", "com/"),
        ("x.org", "/a//b", None), ("", "", None), ("", "", None), ("É.com", "/Ü", "com/"), ("net", "/es/", "net/es/"), ("b:", "//c/d", None)]
    said = {r["id"]: r["verdict"] for r in got.collect()}
    assert (said[0], said[1], said[3], said[8], said[9]) == ("allow", "block", "block", "allow", "allow")


def test_propagation(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "d", 3), ("d", "a", 1), ("e", "a", 1)]
    seeds = {"a": 1.0, "e": 3.0}
    got = url_filter.propagate(spark.createDataFrame([("t", *e) for e in edges], "kind string, src string, dst string, n long"),
                               spark.createDataFrame([("t", h, s) for h, s in seeds.items()], "kind string, host string, seed double"))
    out = Counter()
    for s, _, n in edges:
        out[s] += n
    rank = {h: s / 4 for h, s in seeds.items()}
    for _ in range(200):
        new = Counter({h: 0.3 * s / 4 for h, s in seeds.items()})
        for s, d, n in edges:
            new[d] += 0.7 * rank.get(s, 0) * n / out[s]
        rank = new
    got = {r["host"]: r["rank"] for r in got.collect()}
    assert got.keys() == rank.keys() and all(abs(got[h] - rank[h]) < 1e-3 for h in rank)


def test_links_decide(spark):
    rows = [(1, "http://good.com/1", '<a href="http://friend.org/x">'), (2, "http://spam.net/es/1", None), (3, "http://farm.org/1", "<a HREF='//SPAM.net/es/1'>"),
            (4, "http://friend.org/2", ""), (5, "http://alone.org/3", "<a href=/local>")]
    got = {r["id"]: r["verdict"] for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# token ids, counts and packing

def ids_of(text):
    return bpe._tokenizer(bpe.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def random_text(r, n):
    kinds = ["word", "a1", "  ", "\n", " \n ", "don't", "'s", "\u00a0", "\u2003 ", "\u3000", "\x1f", "É", "東京", "!?", "\t", "\r\n", "\x85", "<|endoftext|>", "12", "%%%"]
    return "".join(r.choice(kinds) + r.choice(["", " ", " "]) for _ in range(n))


def test_ids_are_those_of_the_tokenizer():
    import pyarrow as pa

    from fieldlake.llm.common import raw

    r = random.Random(5)
    texts = [random_text(r, r.randint(0, 40)) for _ in range(600)] + ["", " ", "a", None]
    data, offsets = raw(pa.array(texts))
    ids, each, starts = bpe.encode(data, offsets, bpe.vocabulary_path())
    edges = bpe.row_edges(each, starts, offsets)
    for k, t in enumerate(texts):
        assert ids[edges[k]:edges[k + 1]].tolist() == ids_of(t), repr(t)


def test_edits(spark):
    r = random.Random(6)
    rows = []
    for k in range(150):
        text = random_text(r, r.randint(0, 120)) if k % 3 else words_of(r, r.randint(0, 300))
        edits, at = [], 0
        for _ in range(r.randint(0, 6)):
            at += r.randint(0, 60)
            n = r.choice([0, 1, 3, 40])
            edits.append((at, n, r.choice(["", "x", " ", "new words\n", None])))
            at += n + r.randint(0, 1)
        rows.append((k, text, edits))
    rows += [(900, None, [(0, 1, "q")]), (901, "abc", None), (902, "abc", [None, (None, 1, "z"), (-5, None, ">"), (99, 9, "<")])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits array<{token_counts.EDIT}>")
    got = {x["id"]: x for x in token_counts.count_edited(df, "edits", leaf=4).collect()}
    assert len(got) == len(rows)
    for k, text, edits in rows:
        old = text or ""
        places = np.append([len(old[:i].encode()) for i in range(len(old))], len(old.encode())).astype(int)
        dicts = [e and dict(zip(("start", "length", "replacement"), e)) for e in edits or []]
        new, at = b"", 0
        for a, b, text_in in token_counts.merged_edits(dicts, places):
            new += old.encode()[at:a] + text_in
            at = b
        new = (new + old.encode()[at:]).decode()
        assert got[k]["n_tokens"] == len(ids_of(old)) and got[k]["n_tokens_after"] == len(ids_of(new)), (old, edits)
    assert sum(x["n_segments_redone"] for x in got.values()) < sum(x["n_segments"] for x in got.values())
    assert token_counts.count_edited(df.limit(0), "edits").count() == 0


def test_packing(spark):
    r = random.Random(7)
    rows = EDGE + [(100 + k, words_of(r, r.randint(0, 700) if k % 4 else 30)) for k in range(120)] + [(500, words_of(r, 5000))]
    got = packing.pack(frame(spark, rows), capacity=256, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*ids_of(t), packing.END]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((x["id"], x["piece"], x["start"], x["length"], x["ids_crc32"], tuple(x["ids"])) for x in got) == want
    places = defaultdict(list)
    for x in got:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(x["length"] for x in got)
    assert len(places) <= -(-total // 256) + 2
    assert packing.pack(empty(spark)).count() == 0


def test_plan_is_best_fit():
    r = random.Random(8)
    for _ in range(30):
        histogram = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(1, 20))}
        rows = packing.plan(histogram, 64)
        for length, n in histogram.items():
            assert sum(x[1] for x in rows if x[0] == length) == n
        room = []
        for length in sorted((v for v, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [k for k, left in enumerate(room) if left >= length]
            best = min(fits, key=lambda k: room[k], default=None)
            if best is None:
                room.append(64)
                best = len(room) - 1
            room[best] -= length
        assert max(x[1] + x[2] for x in rows) == len(room)


def test_ranks_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    got = packing.pack(frame(spark, [(k % 50, "same words") for k in range(300)])).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in got}) == 300


# lines

def lines_oracle(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.execute(queries.LINES_SQL).fetchall())


def test_line_chunks(spark):
    r = random.Random(9)
    pool = [words_of(r, r.randint(0, 3)) for _ in range(30)]
    block = [words_of(r, 4) for _ in range(14)]
    rows = []
    for k in range(80):
        own = [r.choice(pool) for _ in range(r.randint(0, 6))]
        rows.append((k, "\n".join(own + (block[r.randint(0, 3):] if k % 2 else []) + [words_of(r, 2)] * (k % 3))))
    rows += [(200, None), (201, ""), (202, "\n"), (203, rows[1][1]), (204, "\n".join(block * 40))]
    got = line_chunks.dedup_lines(frame(spark, rows))
    assert got.columns.count("n_lines") == 1 and "bucket" in got.columns
    found = got.select("doc_id", "n_lines", "n_lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("m")).collect()
    assert sorted(tuple(x) for x in found) == lines_oracle(rows)
    assert any(x["n_lines_removed"] for x in found)
    assert got.filter("doc_id = 200").first()["text"] is None


def test_shared_passages_go_and_every_line_stays_once(spark):
    r = random.Random(31)
    passages = [[words_of(r, 60)] for _ in range(20)] + [[words_of(r, r.randint(12, 30)) for _ in range(6)] for _ in range(100)]
    rows = []
    for k in range(260):
        own = [words_of(r, r.randint(8, 80)) for _ in range(4)]
        rows.append((k, "\n".join(own[:2] + (passages[k % 120] if k < 240 else []) + own[2:])))
    left = {x["doc_id"]: x["text"].split("\n") for x in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert all(left[k] == texts[k].split("\n") for k in [*range(120), *range(240, 260)])
    assert all(len(left[k]) == 4 for k in range(120, 140))  # a long line is a chunk of its own
    # six short lines between others: nine in ten lose some, and over half of all lines go
    assert sum(len(left[k]) < 10 for k in range(140, 240)) >= 88
    assert sum(len(left[k]) - 4 for k in range(140, 240)) <= 0.5 * 600
    assert {line for t in texts.values() for line in t.split("\n")} == {line for t in left.values() for line in t}


def test_line_chunk_edges(spark):
    assert line_chunks.dedup_lines(empty(spark)).count() == 0
    got = line_chunks.dedup_lines(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and {x["doc_id"] for x in got} == {i for i, _ in EDGE}


def test_line_chunks_have_no_python(spark, sf):
    plan = queries.QUERIES["op4_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[50:90] = v[0]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0] * 3), (5500, [float("inf")] * 16),
           (None, [1.0] * 16), (5600, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("b", F.lit(1)).withColumn("q", F.lit(1))
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0"), 10).collect()
    by = defaultdict(dict)
    for x in got:
        by[x["query_id"]][x["rank"]] = x
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(len(v)), d)) if k != q][:10]
        hits += len(set(order) & {x["vec_id"] for x in found.values()})
        scores = [found[k]["score"] for k in range(1, 11)]
        assert scores == sorted(scores) and all(abs(found[k]["score"] - d[found[k]["vec_id"]]) < 1e-12 for k in found)
    assert hits / (10 * len(by)) >= 0.9
    assert [by[0][k]["vec_id"] for k in range(1, 11)] == list(range(50, 60))  # ties go to the smaller id


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id = 0"), 10).collect()
    assert [(x["query_id"], x["rank"], x["vec_id"]) for x in got] == [(0, 1, 1)]
    assert neighbours.nearest(df.limit(0), df, 10).count() == 0


# benchmark items

def test_contamination(spark):
    r = random.Random(11)
    items = [(k, words_of(r, r.choice([1, 3, 5, 12, 40, 90]))) for k in range(40)] + [(98, None), (99, "  "), (None, "only null id words here now")]
    rows = list(EDGE)
    for k in range(80):
        parts = [words_of(r, r.randint(0, 60))]
        if k % 2:
            given = items[r.randrange(40)][1].split()
            if k % 4 == 1 and len(given) > 20:
                given[r.randrange(len(given))] = "changed"
            parts.append(" \n ".join(given).translate({97 + k: 65 + k for k in range(26)}))
        rows.append((100 + k, " ".join(parts + [words_of(r, r.randint(0, 30))])))

    def shingles(t):
        return decontaminate._texts((t or "").encode().lower(), 5)

    want = {}
    for i, t in rows:
        have = shingles(t)
        for j, b in items:
            s = shingles(b)
            if s and len(s & have) >= 0.8 * len(s) - 1e-9:
                want[i, j] = (len(s & have), len(s))
    df = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["id"], x["item_id"]): (x["n_shared"], x["n_item"]) for x in decontaminate.contaminated(df, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(i for i, _ in rows if i not in {a for a, _ in want})
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(rows)


def test_contamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    r = random.Random(12)
    items = [(k, words_of(r, 12)) for k in range(20)]
    df = frame(spark, [(k, "start " + t) for k, t in items])
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["id"], x["item_id"]) for x in got} >= {(k, k) for k in range(20)}
    assert decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).count() == 0


# toxicity

def test_ordinal_fit():
    rng = np.random.default_rng(4)
    n, p = 3000, 6
    x = rng.random((n, p)) < 0.3
    w = np.array([2.0, 1.0, 0.0, -1.0, 3.0, 0.5])
    z = x @ w + rng.logistic(size=n)
    grades = np.digitize(z, [1.0, 2.5, 4.0])
    rows, columns = np.nonzero(x)
    weights, t = toxicity.fit_ordinal(rows, columns, grades, p)
    assert np.all(np.diff(t) > 0) and np.allclose(weights, w, atol=0.4) and np.allclose(t, [1.0, 2.5, 4.0], atol=0.5)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.fit(docs, labels.filter(fold == 0))
    assert model is not None and np.all(np.diff(model.thresholds) > 0)
    got = toxicity.score(docs, model).join(labels.filter(fold == 1), F.col("id") == F.col("doc_id")).collect()
    right = sum((x["expected_severity"] >= toxicity.REJECT) == bool(x["toxic"]) for x in got)
    assert right / len(got) > 0.96
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_toxicity_edges(spark):
    df = frame(spark, EDGE)
    labels = spark.createDataFrame([(2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels) is None and toxicity.fit(df.limit(0), labels) is None
    assert [x["expected_severity"] for x in toxicity.score(df, None).collect()] == [0.0] * len(EDGE)
    assert toxicity.reject(df, None).count() == len(EDGE)


# near copies

def fingerprint(text, n):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k:k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    r = random.Random(13)
    base = [words_of(r, 200) for _ in range(12)]
    rows = EDGE + [(50, ""), (51, "ONE")]
    for k in range(120):
        w = r.choice(base).split(" ")
        for _ in range(k % 3):
            w[r.randrange(len(w))] = "new"
        rows.append((100 + k, ("  " if k % 5 else "\n").join(w)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((x["id"], x["fp"] & (1 << 64) - 1) for x in got) == Counter((i, fingerprint(t, 3)) for i, t in rows)
    prints = {x["fp"] & (1 << 64) - 1 for x in got}
    roots = grouped(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for x in got:
        root = roots[x["fp"] & (1 << 64) - 1]
        low[root] = min((v for v in (low.get(root), x["id"]) if v is not None), default=None)
    assert all(x["component"] == low[roots[x["fp"] & (1 << 64) - 1]] for x in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_of_similar_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for x in docs.collect():
        w = x["text"].encode().lower().split()
        sets[x["doc_id"]] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    meet = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    like = {p: n / len(sets[p[0]] | sets[p[1]]) for p, n in meet.items()}
    got = {x["id"]: x["component"] for x in simhash.similar_documents(docs).collect()}
    clear = [p for p, j in like.items() if j >= 0.85]
    assert sum(got[a] == got[b] for a, b in clear) >= 0.97 * len(clear)
    for i, c in got.items():  # nothing is dropped without a document like it
        assert c == i or max(j for p, j in like.items() if i in p) >= 0.7
    rows = EDGE + [(4, "one"), (20, "one"), (21, "")]
    kept = simhash.keep_one(frame(spark, rows))
    assert "bucket" in kept.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.keep_one(empty(spark)).count() == 0


def test_pigeonring_gives_candidates_of_similar_documents(spark):
    """Without posting lists, copies within two bits of the short fingerprint are found, and no unlike texts are joined."""
    r = random.Random(23)
    rows = []
    for d in range(0, 60, 2):
        text = words_of(r, 600).split()
        edited = list(text)
        edited[300 + d] = "new"
        rows += [(d, " ".join(text)), (d + 1, " ".join(edited))]
    rows += [(100 + k, f"word{k}") for k in range(20)] + [(200, ""), (201, None)]
    bits = {i: fingerprint(t, 5) for i, t in rows}
    near = [d for d in range(0, 60, 2) if (bits[d] ^ bits[d + 1]).bit_count() <= 2]
    docs = frame(spark, rows)
    prints = docs.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("at"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("mark"))
    prints = common.stage(prints, "prints")
    at = {x["at"]: x["id"] for x in prints.collect()}
    pairs = {frozenset((at[x["a"]], at[x["b"]])) for x in simhash._ring_pairs(prints, 5).collect()}
    assert len(near) >= 5 and all({d, d + 1} in pairs for d in near)
    whole = prints.withColumn("keys", F.array().cast("array<long>"))
    least = {bytes(x["mark"]): x["least"] for x in copies.grouped(whole, 5, 80, simhash._ring_pairs(prints, 5)).collect()}
    got = {i: least[(t or "").encode()] for i, t in rows}
    assert all(got[d + 1] == d for d in near) and all(got[i] in (i, i - 1) for i in got)


def test_copies_that_gain_or_lose_text(spark):
    """Sets of shingles of unequal size at a similarity of 0.82 to 0.85: one text is the other with a part appended or cut off."""
    r = random.Random(8)
    rows = []
    for d in range(0, 80, 2):
        text = [words_of(r, 1) for _ in range(1000)]
        share = r.uniform(0.15, 0.18)
        rows += [(d, " ".join(text)), (d + 1, " ".join(text[:int(1000 * (1 - share))] if d % 4 else text + [words_of(r, 1) for _ in range(int(1000 * share / (1 - share)))]))]
    got = {x["id"]: x["component"] for x in simhash.similar_documents(frame(spark, rows)).collect()}
    assert all(got[d] == d for d in range(0, 80, 2)), "unlike texts must not meet"
    assert sum(got[d + 1] == d for d in range(0, 80, 2)) >= 38


def test_votes_of_whole_texts():
    """Bits and smallest hashes of a long fingerprint against a plain count over every distinct shingle."""
    r = random.Random(9)
    texts = [words_of(r, n) for n in (0, 3, 5, 250, 700, 2000)]
    h, row = copies.sets(pa.array(texts), 5)
    got = simhash.long_fingerprints(h, row, len(texts))[0].view(np.int64).tolist()
    for text, prints in zip(texts, got, strict=True):
        data, offsets = common.raw(pa.array([text]))
        starts, ends, owner = common.words(common.LOWER[data], offsets)
        h = np.unique(common.shingles(common.span_hash(common.prefix_hash(common.LOWER[data]), starts, ends), owner, 1, 5)[0])
        for w, seed in enumerate(common.mixed(np.arange(1, simhash.WORDS + 1, dtype=np.uint64))):
            g = common.mixed(h ^ seed)
            want = sum(1 << b for b in range(64) if 2 * int(((g >> np.uint64(b)) & np.uint64(1)).sum()) > len(g))
            assert prints[w] % (1 << 64) == want


def test_rows_that_share_an_id_leave_by_their_own_text(spark):
    r = random.Random(18)
    a, b, c, d = (words_of(r, 200) for _ in range(4))
    rows = [(1, a), (1, b), (2, c), (2, a), (2, b + " end"), (3, d), (3, d), (3, d + " end"), (None, a)]
    kept = simhash.keep_one(frame(spark, rows))
    left = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert Counter(x for x in left if x[0] != 3) == Counter([(1, a), (1, b), (2, c), (None, a)])
    assert len([x for x in left if x[0] == 3]) == 1 and len(kept.columns) == len(frame(spark, rows).columns)


@pytest.mark.parametrize("short", [1000, 2])
def test_all_pairs_of_a_list_are_joined_or_compared(spark, monkeypatch, short):
    """Copies that meet only in lists led by unlike texts; long lists are joined on their rarest elements, which finds no less."""
    monkeypatch.setattr(copies, "SHORT", short)
    r = random.Random(17)
    texts = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(6, 40))] for _ in range(60)]
    for t in list(texts):
        texts += [[w if r.random() > 0.04 else f"v{k}" for k, w in enumerate(t)] for _ in range(r.randint(0, 3))]
    r.shuffle(texts)
    keys = [r.sample(range(40), 3) for _ in texts]
    sets = [{tuple(t[k:k + 2]) for k in range(len(t) - 1)} for t in texts]
    column = pa.array([" ".join(t) for t in texts])
    size, node = copies.marks(*copies.sets(column, 2), len(texts))
    rows = [(k, s, k, int(n), m, q) for k, (s, n, m, q) in enumerate(zip(column.to_pylist(), size, node.to_pylist(), keys))]
    prints = spark.createDataFrame(rows, "id long, text string, at long, n long, mark binary, keys array<long>")
    least = {bytes(x["mark"]): x["least"] for x in copies.grouped(prints, 2, 80).collect()}
    got = {k: least[m] for k, m in enumerate(node.to_pylist())}
    first = {}
    for k, m in enumerate(node.to_pylist()):  # of equal sets one row's keys count
        first.setdefault(m, k)
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    listed = lambda a, b: similar(a, b) and bool(set(keys[first[rows[a][4]]]) & set(keys[first[rows[b][4]]]) or sets[a] == sets[b])
    if len(first) == len(texts) and short == 1000:
        assert got == grouped(range(len(texts)), listed)
    least_wanted, whole = grouped(range(len(texts)), listed), grouped(range(len(texts)), similar)
    assert all(got[k] == got[least_wanted[k]] and whole[k] == whole[got[k]] for k in got) and len(set(got.values())) < len(texts)


@pytest.mark.parametrize("members", [60, 1500])
def test_copies_beside_a_template_family(spark, members):
    """Pairs above the threshold are found whatever the number of texts that share two thirds of their shingles with them."""
    r = random.Random(members)
    template = [f"t{k}" for k in range(90)]
    own = lambda k, n: [f"o{k}-{j}" for j in range(n)]
    rows = [(k, " ".join(template + own(k, 40))) for k in range(members)]
    pairs = []
    for k in range(40):
        text = template + own(members + k, 40)
        edited = list(text)
        for at in r.sample(range(len(text)), 2):  # each edit changes five shingles of 126: similarity 0.85 or more
            edited[at] = f"e{k}-{at}"
        pairs.append((members + 2 * k, members + 2 * k + 1))
        rows += [(pairs[-1][0], " ".join(text)), (pairs[-1][1], " ".join(edited))]
    got = {x["id"]: x["component"] for x in simhash.similar_documents(frame(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 36
    assert all(got[k] == k for k in range(members)), "members of the family are no copies"


@pytest.mark.parametrize("distance, segments, bucket", [(2, 5, 64), (2, 5, 2), (2, 5, 1), (2, 7, 3), (4, 9, 64), (4, 9, 2), (0, 3, 4)])
def test_links_lose_nothing(spark, distance, segments, bucket):
    r = random.Random(14)
    near = set()
    for _ in range(8):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            near.add(x)
    near |= {0, 1, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, segments, bucket)
    assert all(((x["a"] ^ x["b"]) & (1 << 64) - 1).bit_count() <= distance for x in edges.collect())
    roots = {x["node"]: x["root"] for x in graph.components(edges).collect()}
    want = grouped(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
    assert {n: roots.get(n, n) for n in signed} == want


def test_components(spark):
    r = random.Random(15)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    both = {frozenset(e) for e in edges}
    assert got == grouped(sorted(nodes), lambda a, b: frozenset((a, b)) in both)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "stage", lambda df, name: tables.append(name) or common.stage(df, name))
    stars = [(1, k) for k in range(2, 9)] + [(11, k) for k in range(12, 15)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 9)} | {k: 11 for k in range(11, 15)}
    assert len(tables) == 1  # the edges are stars: no round
    tables.clear()
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {x["node"]: x["root"] for x in graph.components(path).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(tables) == 2  # one round makes the path a star


# language model

def brute_scores(rows, held):
    """The automaton as plain dictionaries, read token by token."""
    texts = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    train = [texts[k] for k, (i, _) in enumerate(rows) if not held(i)]
    words = Counter(w for t in train for w in t)
    n = sum(words.values())
    total, ends = n + len(train), len(train)
    distinct = len(words) + bool(train)
    frequent = {w for w, c in words.items() if c >= language_model.FREQUENT * n}
    very = {w for w, c in words.items() if c >= language_model.VERY_FREQUENT * n}

    def states(t):
        one, two = "<s>", None
        for k, w in enumerate([*t, "</s>"]):
            yield one, two, w
            one = w if w in frequent else "<other>"
            two = (t[k - 1], w) if k and t[k - 1] in very and w in very else None

    first, second = defaultdict(Counter), defaultdict(Counter)
    for t in train:
        for one, two, w in states(t):
            first[one][w if w in frequent or w == "</s>" else "<other>"] += 1
            if two:
                second[two][w if w in very or w == "</s>" else "<other>"] += 1

    def discount(counts):
        once, twice = (sum(c == k for c in counts) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    d0 = discount(words.values())
    d1, d2 = (discount([c for t in table.values() for w, c in t.items() if w != "<other>"]) for table in (first, second))

    def arc(table, d, state, w, below):
        seen = table.get(state)
        if not seen:
            return below
        follow = sum(seen.values())
        weights = {v: max(c - d, 0) / follow for v, c in seen.items() if v != "<other>"}
        return weights.get(w, 0) + (1 - sum(weights.values())) * below

    out = []
    for k, (i, _) in enumerate(rows):
        score = base = known = 0
        for one, two, w in states(texts[k]):
            c = ends if w == "</s>" else words[w]
            p = ((c - d0) if c else d0 * distinct) / total
            p = arc(first, d1, one, w, p)
            p = arc(second, d2, two, w, p)
            score += np.log10(p)
            base += np.log10((c + 1) / (total + distinct + 1))
            known += c > 0
        out.append((i, held(i), len(texts[k]) + 1, known, total, base, score))
    return out


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 0.02)
    monkeypatch.setattr(language_model, "VERY_FREQUENT", 0.05)
    r = random.Random(16)
    rows = EDGE + [(100 + k, " ".join(r.choice(["the", "of", "And", "la"]) if r.random() < 0.6 else words_of(r, 1) for _ in range(r.randint(0, 80)))) for k in range(150)]

    def held(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2

    got = sorted((tuple(x) for x in language_model.score(frame(spark, rows)).collect()), key=repr)
    want = sorted(brute_scores(rows, held), key=repr)
    assert len(got) == len(want) and any(x[1] for x in got)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[2], x[3])), sorted(want, key=lambda x: (str(x[0]), x[2], x[3]))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_model_counts_pairs_and_triples_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BATCH_BYTES", 3000)  # several batches ask for the same states
    r = random.Random(17)
    rows = EDGE + [(100 + k, " ".join(r.choice(["the", "of", "And", "la"]) if r.random() < 0.4 else words_of(r, 1) for _ in range(r.randint(0, 80)))) for k in range(150)]
    phrase = [f"rare{k}" for k in range(12)]
    rows += [(k, " ".join(phrase)) for k in range(1000, 1020)] + [(k, " ".join(r.sample(phrase, 12))) for k in range(2000, 2020)]

    def held(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 or (i or 0) >= 2000

    got = [tuple(x) for x in language_model.score(frame(spark, rows), held_out=language_model.is_held_out(F.col("doc_id")) | (F.coalesce("doc_id", F.lit(0)) >= 2000)).collect()]
    want = brute_scores(rows, held)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[2], x[3])), sorted(want, key=lambda x: (str(x[0]), x[2], x[3]))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert min(x[6] for x in got if 1000 <= (x[0] or 0) < 1020) > max(x[6] for x in got if (x[0] or 0) >= 2000) + 5


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_language_model_edges(spark):
    assert language_model.score(empty(spark)).count() == 0
    none = language_model.score(frame(spark, EDGE), held_out=F.lit(True)).collect()
    assert len(none) == len(EDGE) and all(x["train_tokens"] == 0 and x["n_known"] == 0 and x["score"] == 0 for x in none)


# queries and pipeline

def test_oracles(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert sorted(tuple(x) for x in df.collect()) == sorted(con.sql(f"select {', '.join(df.columns)} from ({sql})").fetchall()), name


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    current, kept = docs, {}
    for name, step in p.STAGES[:-1]:
        after = step(spark, current, sf)
        assert after.columns == docs.columns
        after = p.stage(after, name)
        assert {x["doc_id"] for x in after.select("doc_id").collect()} <= {x["doc_id"] for x in current.select("doc_id").collect()}
        kept[name], current = after, after
    left = {x["doc_id"] for x in kept["toxicity"].collect()}
    assert not [i for i, t in labels.items() if not t and i not in left]
    assert sum(i not in left for i, t in labels.items() if t) >= 0.6 * sum(labels.values())
    assert kept["line_dedup"].count() == kept["toxicity"].count()
    assert decontaminate.contaminated(kept["decontamination"], bench).count() == 0
    assert simhash.similar_documents(kept["near_duplicates"]).filter("id <> component").count() <= 2
    packed = p.STAGES[-1][1](spark, current, sf)
    assert packed.filter("piece = 0").count() == current.count()
    assert p.run(spark, sf).count() == packed.count()


def test_language_model_counts_words_with_the_question(spark, monkeypatch):
    """Batches bring the training counts of their words, so no second pass over the texts shuffles them; many batches score as one does."""
    texts = [pa.table({"__text": common.squeezed(pa.array(t)), "__held": h, "__batch": [k] * len(t)})
             for k, (t, h) in enumerate([(["A b b", "c"], [False, True]), (["b d", None], [False, False])])]
    asked = pa.concat_tables([language_model._wanted(3)(t) for t in texts])
    told = pa.concat_tables([language_model._told(3)(asked.filter(pc.equal(asked["bucket"], k))) for k in range(3)])
    model = language_model._totals(told.filter(pc.equal(told["batch"], 0)), language_model.Totals(0, 0, 3, 0, 3, 0, 0))
    assert (model.total, model.distinct) == (3 + 2 + 3, 3 + 1)  # a, b, b and b, d, with the ends of three texts; c is held out
    counts = language_model._unpacked(told, "counts", language_model.LONG)[0].tolist()
    numbers = language_model._unpacked(told, "numbers", language_model.INT)[0].tolist()
    assert sorted(counts) == [0, 1, 1, 3, 3]
    assert len(set(numbers)) == 4 and all((n == language_model.OTHER) == (c == 0) for n, c in zip(numbers, counts, strict=True))

    rows = [(k, " ".join(f"w{k * j % 17}" for j in range(30))) for k in range(60)]
    one = sorted(tuple(x) for x in language_model.score(frame(spark, rows)).collect())
    monkeypatch.setattr(language_model, "BATCH_BYTES", 1_000)
    for a, b in zip(one, sorted(tuple(x) for x in language_model.score(frame(spark, rows)).collect()), strict=True):
        assert a == pytest.approx(b)
    assert language_model._packed(np.arange(10_000), np.array([0, 10_000]), language_model.LONG)[0].as_buffer().size < 8 * 10_000 // 4
