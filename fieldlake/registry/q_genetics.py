"""Population genetics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.config import GeneticConfig
from fieldlake.operators import genetics
from fieldlake.registry.core import query, rounded
from fieldlake.registry.views import table, view


def _binned(spark, sf):
    return view(spark, sf, "v_edna_samples").withColumn("time_bin", F.year("collection_date").cast("string"))


def freqs(period):
    return f"""
calls as (select project_id, target_species, h3_cell, {period} as period, locus_name, sample_id, unnest(string_split(allele_state, '/')) as allele, 1.0 as w from v_edna_samples),
samples as (select project_id, target_species, h3_cell, period, locus_name, count(distinct sample_id) as n from calls group by all),
alleles as (select project_id, target_species, h3_cell, period, locus_name, allele, sum(w) as copies, count(distinct sample_id) as k from calls group by all),
freq as (select *, copies / sum(copies) over (partition by project_id, target_species, h3_cell, period, locus_name) as p from alleles join samples using (project_id, target_species, h3_cell, period, locus_name))"""


@query("allele_frequencies", f"""
with {freqs('year(collection_date)::varchar')}
select target_species, h3_cell, period as time_bin, locus_name, allele, round(copies, 4) as copies, k as allele_samples, n as sample_count, round(p, 6) as p from freq""")
def _(spark, sf):
    df = genetics.allele_frequencies(_binned(spark, sf))
    df = df.select("target_species", "h3_cell", "time_bin", "locus_name", "allele", "copies", "allele_samples", "sample_count", "p")
    return rounded(rounded(df, "copies"), "p", digits=6)


@query("expected_heterozygosity", f"""
with {freqs('year(collection_date)::varchar')}
select target_species, h3_cell, period as time_bin, locus_name, round(1 - sum(p * p), 6) as expected_heterozygosity from freq group by all having count(*) >= 2""")
def _(spark, sf):
    df = genetics.expected_heterozygosity(genetics.allele_frequencies(_binned(spark, sf)))
    return rounded(df.drop("project_id"), "expected_heterozygosity", digits=6)


RICH = """
g as (select project_id, target_species, period, locus_name, min(n) as g from samples group by all),
absent as (select f.*, g.g, case when n - k < g.g then 0.0 else list_reduce(list_prepend(1.0::double, list_transform(range(g.g), lambda i: (n - k - i)::double / (n - i))), lambda a, b: a * b) end as pa
  from freq f join g using (project_id, target_species, period, locus_name)),
rich as (select project_id, target_species, h3_cell, period, locus_name, sum(1 - pa) as richness, max(g) as g, max(n) as n, 1 - sum(p * p) as he, count(*) as types from absent group by all)"""


@query("rarefied_richness", f"""
with {freqs('year(collection_date)::varchar')}, {RICH}
select target_species, h3_cell, period as time_bin, locus_name, round(richness, 5) as allelic_richness, g as rarefaction_size, n as sample_count from rich""")
def _(spark, sf):
    df = genetics.rarefied_richness(genetics.allele_frequencies(_binned(spark, sf)))
    return rounded(df.drop("project_id"), "allelic_richness", digits=5)


NE = """
f as (select * from freq_y), loci as (select distinct project_id, target_species, h3_cell, locus_name, period, n from f),
pairs as (select a.project_id, a.target_species, a.h3_cell, a.locus_name, a.period as y1, b.period as y2, a.n as n1, b.n as n2 from loci a join loci b
  on a.target_species = b.target_species and a.h3_cell = b.h3_cell and a.locus_name = b.locus_name and a.period < b.period),
al as (select distinct target_species, h3_cell, locus_name, allele, y1, y2, n1, n2 from pairs join (select target_species, h3_cell, locus_name, period, allele from f) x
  using (target_species, h3_cell, locus_name) where x.period in (y1, y2)),
d as (select al.*, coalesce(a.p, 0) as p1, coalesce(b.p, 0) as p2 from al
  left join f a on a.target_species = al.target_species and a.h3_cell = al.h3_cell and a.locus_name = al.locus_name and a.allele = al.allele and a.period = y1
  left join f b on b.target_species = al.target_species and b.h3_cell = al.h3_cell and b.locus_name = al.locus_name and b.allele = al.allele and b.period = y2),
e as (select target_species, h3_cell, locus_name, y1, y2, avg(greatest(0, pow(p2 - p1, 2) / (((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) - (0.5 / n1 + 0.5 / n2))) as drift
  from d where ((p1 + p2) / 2) * (1 - (p1 + p2) / 2) > 0 group by all),
ne as (select target_species, h3_cell, median(((y2 - y1) / 5.0) / (2 * drift)) as ne, count(*) as estimates from e where drift > 0 group by all)"""
NE_CTE = freqs("year(collection_date)").replace("calls", "calls_y").replace("samples as", "samples_y as").replace("join samples", "join samples_y") \
    .replace("alleles as", "alleles_y as").replace("from alleles", "from alleles_y").replace("freq as", "freq_y as").replace("v_edna_samples_y", "v_edna_samples")


@query("temporal_ne", f"""
with {NE_CTE}, {NE}
select target_species, h3_cell, round(ne, 3) as effective_population_size, estimates from ne""")
def _(spark, sf):
    return rounded(genetics.temporal_ne(view(spark, sf, "v_edna_samples"), 5.0).drop("project_id"), "effective_population_size", digits=3)


@query("shared_loci", f"""
with {freqs('year(collection_date)')}, loci as (select distinct target_species, h3_cell, locus_name, period, n from samples)
select a.target_species, a.h3_cell, a.locus_name, a.period::int as first_year, b.period::int as second_year, a.n as first_sample_count, b.n as second_sample_count
from loci a join loci b on a.target_species = b.target_species and a.h3_cell = b.h3_cell and a.locus_name = b.locus_name and a.period < b.period""")
def _(spark, sf):
    yearly = view(spark, sf, "v_edna_samples").withColumn("year", F.year("collection_date"))
    f = genetics.allele_frequencies(yearly, [*genetics.POPULATION, "year"])
    loci = f.groupBy(*genetics.POPULATION, "locus_name", "year").agg(F.max("sample_count").alias("sample_count"))
    return genetics.shared_loci(loci).drop("project_id")


@query("population_metrics", f"""
with {freqs('year(collection_date)::varchar')}, {RICH}, {NE_CTE}, {NE},
m as (select project_id, target_species, h3_cell, period, count(*) as locus_count, avg(he) as he, avg(richness) as richness, min(least(g, n)) as g
  from rich where n >= 2 and types >= 2 group by all),
s as (select target_species, h3_cell, year(collection_date)::varchar as period, count(distinct sample_id) as n from v_edna_samples group by all)
select m.target_species, m.h3_cell, m.period as time_bin, s.n as sample_count, locus_count, round(he, 5) as mean_expected_heterozygosity, round(richness, 5) as mean_allelic_richness,
  g as rarefaction_sample_size, round(ne, 3) as effective_population_size, case when ne is null then 'INSUFFICIENT_DATA' when ne < 50 then 'CRITICAL_INBREEDING_RISK'
  when ne < 500 then 'VULNERABLE_POPULATION_RISK' else 'LOW_RISK' end as risk_status
from m join s using (target_species, h3_cell, period) left join ne using (target_species, h3_cell)""")
def _(spark, sf):
    df = genetics.population_metrics(view(spark, sf, "v_edna_samples"), GeneticConfig(generation_years=5.0))
    df = df.drop("project_id", "effective_population_method", "critical_inbreeding_risk")
    return rounded(rounded(df, "mean_expected_heterozygosity", "mean_allelic_richness", digits=5), "effective_population_size", digits=3)


@query("edna_batch_summary", """
select project_id, count(distinct sample_id) as sample_count, count(*) as record_count, count(distinct h3_cell) as cell_count from v_edna_samples group by 1""")
def _(spark, sf):
    return genetics.edna_batch_summary(view(spark, sf, "v_edna_samples")).select("project_id", "sample_count", "record_count", "cell_count")


@query("genotype_matrix", """
with d as (select sample_id, locus_name, allele_state, dense_rank() over (partition by locus_name order by allele_state) - 1 as code from v_edna_samples)
select sample_id, """ + ", ".join(f"coalesce(max(code) filter (locus_name = 'locus-{i}'), -1)::int as locus_{i}" for i in range(1, 8)) + " from d group by 1")
def _(spark, sf):
    loci = [f"locus-{i}" for i in range(1, 8)]
    df = genetics.genotype_matrix(view(spark, sf, "v_edna_samples"), loci)
    return df.select("sample_id", *[F.col(f"`{n}`").alias(n.replace("-", "_")) for n in loci])


@query("genetics_summary", """
with r as (select row_number() over () as x, l_orderkey as id, (l_suppkey % 5 + 1)::bigint as species_id, 's' || l_orderkey as sample, 'L' || l_linenumber as locus, l_shipdate::date as d,
    l_discount * 10 as p, l_quantity::int as ind, l_tax * 10 as he, 1 + l_discount as rich, case when l_linenumber = 3 then l_quantity * 10 + l_partkey / 100000.0 end as ne, l_partkey from lineitem),
k as (select r.*, s.scope_id from r join (select id as scope_id, id as species_id from v_species) s using (species_id) where d between date '1997-01-01' and date '1998-01-01'),
h as (select scope_id, count(distinct sample) as edna_sample_count, round(avg(he), 5) as expected_heterozygosity, round(avg(rich), 5) as allelic_richness from k group by 1),
c as (select scope_id, locus, allele, sum(n) as n from (
  select scope_id, locus, 'A' as allele, round_even(round(p, 6) * 2 * ind, 0)::bigint as n from k union all select scope_id, locus, 'B', round_even((1 - round(p, 6)) * 2 * ind, 0)::bigint from k) group by all having sum(n) > 0),
t as (select scope_id, locus, 1 - sum(n * n)::double / pow(sum(n), 2) as he from c group by all)
select h.*, l.loci, l.heterozygosity_from_counts from h join (select scope_id, count(*) as loci, round(avg(he), 5) as heterozygosity_from_counts from t group by 1) l using (scope_id)""")
def _(spark, sf):
    rec = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as id", "cast(l_suppkey % 5 + 1 as bigint) as species_id", "'c' as h3_cell", "concat('s', cast(l_orderkey as string)) as sample_id",
        "concat('L', cast(l_linenumber as string)) as locus_name", "cast(l_shipdate as date) as collection_date",
        "map('A', round(l_discount * 10, 6), 'B', 1 - round(l_discount * 10, 6)) as allele_frequencies", "cast(l_quantity as int) as genotyped_individuals",
        "l_tax * 10 as expected_heterozygosity", "1 + l_discount as allelic_richness", "case when l_linenumber = 3 then l_quantity * 10 end as effective_population_size")
    scopes = view(spark, sf, "v_species").selectExpr("id as scope_id", "id as species_id", "'c' as h3_cell", "883612800000L as window_end_ms")
    df = genetics.genetics_summary(rec, scopes).drop("effective_population_size")
    return rounded(df, "expected_heterozygosity", "allelic_richness", "heterozygosity_from_counts", digits=5)
