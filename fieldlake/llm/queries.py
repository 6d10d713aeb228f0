"""The registered queries of these operators on the driver's tables, and their DuckDB text where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm import (
    byte_dedup, decontaminate, language_model, line_chunks, neighbours, packing, periodic_runs, simhash, slot_negatives, superminhash, token_counts,
    toxicity, url_filter)
from fieldlake.llm.common import prepare
from fieldlake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ready(spark: SparkSession) -> None:
    ship(spark)
    prepare(spark)


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ready(spark)
            return f(lambda table: spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_suffix_dedup")
def _op1(table):
    found = byte_dedup.dedup_bytes(table("documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_url_filter")
def _op2(table):
    return url_filter.verdicts(table("pages")).withColumnRenamed("id", "page_id")


#: What the count query edits: addresses, long numbers and runs of marks are replaced.
REDACTIONS = {"mail": (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<mail>"), "number": (r"\b\d[\d ().-]{6,}\d\b", "<number>"),
              "marks": (r"[%*&#=~_-]{3,}", "")}
_redact = re.compile("|".join(f"(?P<{name}>{pattern})" for name, (pattern, _) in REDACTIONS.items()))


def edits_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": m.start(), "length": m.end() - m.start(), "replacement": REDACTIONS[m.lastgroup][1]}
                                for m in _redact.finditer(t or "")])


@query("op3_token_counts")
def _op3(table):
    find = F.pandas_udf(edits_of, f"array<{token_counts.EDIT}>")
    docs = table("documents").select("doc_id", "text").withColumn("edits", find("text"))
    return token_counts.count_edited(docs, "edits").withColumnRenamed("id", "doc_id")


LINES_SQL = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents),
e as (select doc_id, unnest(lines) line, generate_subscripts(lines, 1) i, len(lines) n from l),
h as (select *, cast('0x' || substr(md5(line), 1, 8) as bigint) v, length(line) - length(replace(line, ' ', '')) >= 49 big from e),
w as (select *, coalesce(lag(v) over (partition by doc_id order by i), 0) u, coalesce(lead(big) over (partition by doc_id order by i), true) next,
  lead(v) over (partition by doc_id order by i) a1, lead(v, 2) over (partition by doc_id order by i) a2 from h),
r as (select doc_id, line, i, big, f, big or next or ((v + f * u) >> 8) % 3 = 0 or coalesce(((a2 + f * a1) >> 8) % 3 = 1, false) stop from w, (values (31), (101), (1009)) x(f)),
k as (select *, coalesce(sum(stop::int) over (partition by doc_id, f order by i rows between unbounded preceding and 1 preceding), 0) k from r),
c as (select distinct doc_id, min(i) a, count(*) n, string_agg(line, chr(10) order by i) body from k group by doc_id, f, k having count(*) >= 2 or bool_or(big)),
g as (select doc_id, a, n, row_number() over (partition by body order by doc_id, a) > 1 gone from c),
x as (select distinct doc_id, unnest(range(a, a + n)) i from g where gone)
select e.doc_id, count(*) n_lines, count(x.i) n_lines_removed,
  md5(coalesce(string_agg(line, chr(10) order by e.i) filter (x.i is null), '')) kept_md5
from e left join x on x.doc_id = e.doc_id and x.i = e.i group by e.doc_id"""


@query("op4_line_dedup", LINES_SQL)
def _op4(table):
    kept = line_chunks.dedup_lines(table("documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_lines_removed").cast("long").alias("n_lines_removed"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op5_neighbours")
def _op5(table):
    vectors = table("embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


SHINGLES_SQL = r"""
with t as (select 'd' kind, doc_id id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') w from t),
s as (select distinct kind, id, unnest(case when len(w) < 6 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from w where len(w) > 0),
q as (select id, count(*) n from s where kind = 'b' group by id)
select d.id doc_id, b.id item_id, count(*) n_shared, any_value(q.n) n_item, round(count(*) / any_value(q.n), 6) containment
from s d join s b using (s) join q on q.id = b.id where d.kind = 'd' and b.kind = 'b'
group by d.id, b.id having count(*) >= 0.8 * any_value(q.n) - 1e-9"""


@query("op6_decontamination", SHINGLES_SQL)
def _op6(table):
    found = decontaminate.contaminated(table("documents"), table("benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


@query("op7_toxicity")
def _op7(table):
    docs = table("documents")
    found = toxicity.score(docs, toxicity.fit(docs, table("labels")))
    return found.select(F.col("id").alias("doc_id"), "expected_severity", (F.col("expected_severity") >= toxicity.REJECT).alias("toxic"))


@query("op8_simhash")
def _op8(table):
    found = simhash.near_duplicates(table("documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op9_language_model")
def _op9(table):
    return language_model.score(table("documents")).withColumnRenamed("id", "doc_id")


@query("op10_packing")
def _op10(table):
    return packing.pack(table("documents")).withColumnRenamed("id", "doc_id")


WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

COPIES_SQL = rf"""
with recursive w as (select doc_id, {WORDS_SQL} w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 2 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) end) s from w where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, root) as (select doc_id, doc_id from documents union select l.a, r.root from r join l on l.b = r.doc_id where r.root < l.a),
m as (select doc_id, min(root) root from r group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.root component_id, d.doc_id = m.root kept
from documents d join m using (doc_id) left join n using (doc_id)"""


@query("op11_superminhash", COPIES_SQL)
def _op11(table):
    found = superminhash.near_duplicates(table("documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: The checksum of an id's digits, bit by bit; 3988292384 is the reversed polynomial.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"""

RUNS_SQL = rf"""
with d as (select doc_id, {CRC_SQL} h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
g as (select *, len(w) n, (h // 10) % greatest(len(w), 1) a, 3 + (h // 10) % 8 e from d),
t as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i+1] else w[a + (i - a) % (1 + (n - a) // e) + 1] end) else w end w from g),
k as (select doc_id, unnest(range(n - 4)) i, n, w from t where n >= 6),
x as materialized (select doc_id, i, n, md5(w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5]) gram from k),
p as (select a.doc_id, a.i, b.i - a.i q from x a join x b on a.doc_id = b.doc_id and a.gram = b.gram and b.i > a.i and 4 * (b.i - a.i) <= a.n),
s as (select *, i - row_number() over (partition by doc_id, q order by i) island from p),
c as (select doc_id, q, min(i) a, count(*) + 4 + q len from s group by doc_id, q, island having count(*) + 4 + q >= greatest(6, 4 * q)),
r as materialized (select doc_id, a, len, min(q) q from c group by all),
f as (select doc_id, count(*) n_runs, max_by(struct_pack(a := a, len := len, q := q), (len, -a, -q)) m, string_agg(a || ',' || len || ',' || q || chr(10), '' order by a, q) t from r group by 1),
z as (select distinct doc_id, unnest(range(a + q, a + len)) i from r),
u as (select doc_id, unnest(range(n)) i, unnest(w) w from t),
v as (select u.doc_id, string_agg(u.w, ' ' order by u.i) t from u anti join z on z.doc_id = u.doc_id and z.i = u.i group by 1)
select t.doc_id, coalesce(n_runs, 0) n_runs, f.m.a as start, f.m.len as length, f.m.q as period, 1000 * f.m.len // f.m.q as exponent_milli,
  sha256(coalesce(f.t, '')) runs_sha256, sha256(coalesce(v.t, '')) collapsed_sha256
from t left join f using (doc_id) left join v using (doc_id)"""


def _tiled(docs: DataFrame) -> DataFrame:
    """The documents of the run query: one id in ten has its words from a place on replaced by a repeated stretch."""
    found = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    words = found.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    placed = words.withColumn("n", n).withColumn("a", g % F.greatest(F.col("n"), F.lit(1)))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    piece = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    whole = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.flatten(F.array_repeat(piece, times))), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", RUNS_SQL)
def _op12(table):
    found = periodic_runs.find_runs(_tiled(table("documents")))
    order = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
                         .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                         .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("m", F.get(order, F.lit(0))).withColumn("listed", listed)
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *[F.col(f"m.{c}").alias(c) for c in ("start", "length", "period")],
                        F.expr("1000 * m.length div m.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


NEGATIVES_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id a, b.vec_id b, a.lab = b.lab same, list_inner_product(a.v, b.v)::bigint score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b p, p.score ps, s.b n, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) r
  from p join s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select a anchor_id, p positive_id, r::int "rank", n negative_id, ps positive_score, ns negative_score from n where r <= 10"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def _op13(table):
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table("embeddings").filter("embedding is not null").filter(finite).select("vec_id", turned.alias("label"), whole.alias("vector"))
    return slot_negatives.mine(rows, F.col("vec_id") % 100 == 0)
