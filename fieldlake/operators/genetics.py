"""Population genetics over allele calls, in long form: (group, locus, allele, p).

Groups are never collected: calls are exploded, combined map-side per (group, locus, allele)
and everything after works on that much smaller table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.config import DAY_MS, GENETICS, RISK, GeneticConfig, RiskConfig
from fieldlake.functions.h3grid import cell_bounds
from fieldlake.functions.mathx import clamp
from fieldlake.functions.text import split_alleles
from fieldlake.functions.timex import time_bin
from fieldlake.session import cut_lineage

POPULATION = ("project_id", "target_species", "h3_cell")


def sample_alleles(df: DataFrame, keys) -> DataFrame:
    """Copies ``w`` of each allele per (group, locus, sample); a null allele marks that the sample has any call.

    A multi-allele call splits its copies evenly. One pass: every call emits its alleles and the marker. Calls are dealt out by sample before
    they are exploded, so a call is shuffled once and not once per allele.
    """
    sequence = "sequence" if "sequence" in df.columns else None
    group = [*keys, "locus_name"]
    calls = df.select(*group, "sample_id", "allele_count", "allele_state", *([sequence] if sequence else [])).repartition("locus_name", "sample_id")
    # one exploded row: the optimizer would split the text again in every filter below
    rows = calls.withColumn("__a", F.explode(F.array(split_alleles("allele_state", sequence)))).filter(F.size("__a") > 0)
    copies = F.coalesce(F.col("allele_count").cast("double"), F.size("__a").cast("double"))
    usable = (copies > 0) & (copies < float("inf"))
    marked = F.when(usable, F.array_append("__a", F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string")))
    each = rows.select(*group, "sample_id", (copies / F.size("__a")).alias("w"), F.explode(marked).alias("allele"))
    return each.groupBy(*group, "sample_id", "allele").agg(F.sum("w").alias("w"))


def frequencies(per_sample: DataFrame, keys) -> DataFrame:
    """Frequency of each allele per (group, locus) from one row per sample and allele: rows per allele are the samples that
    carry it and markers are all samples, so no distinct count and no join is needed."""
    group = [*keys, "locus_name"]
    counts = per_sample.groupBy(*group, "allele").agg(F.sum("w").alias("copies"), F.count(F.lit(1)).alias("allele_samples"))
    locus = Window.partitionBy(*group)  # the alleles of one locus
    real = F.col("allele").isNotNull()
    out = counts.select("*", F.max(F.when(~real, F.col("allele_samples"))).over(locus).alias("sample_count"),
                        F.sum(F.when(real, F.col("copies"))).over(locus).alias("gene_copies"), F.count("allele").over(locus).alias("allele_types"))
    return out.filter(real).withColumn("p", F.col("copies") / F.nullif("gene_copies", F.lit(0.0)))


def allele_frequencies(df: DataFrame, keys=(*POPULATION, "time_bin")) -> DataFrame:
    """Frequency of each allele per (group, locus); ``sample_count`` counts samples with any call, even one whose copy count adds nothing."""
    return frequencies(sample_alleles(df, keys), keys)


def expected_heterozygosity(freqs: DataFrame, keys=(*POPULATION, "time_bin", "locus_name"), monomorphic: bool = False) -> DataFrame:
    """1 - Σp² per locus; a locus with one allele is dropped, or 0 with ``monomorphic``."""
    loci = freqs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("homozygosity"))
    value = clamp(F.lit(1.0) - F.col("homozygosity"), 0.0, 1.0)
    loci = loci.withColumn("expected_heterozygosity", F.when(F.col("n") >= 2, value).otherwise(F.lit(0.0)))
    return (loci if monomorphic else loci.filter("n >= 2")).drop("n", "homozygosity")


FACTORS = 32  # up to so many factors are multiplied, more are taken from Stirling's series


def _log_factorial(x: Column) -> Column:
    """ln x!: a table for small x, else Stirling's series."""
    small = F.get(F.array(*[F.lit(math.lgamma(n + 1)) for n in range(16)]), x.cast("int"))
    y = F.greatest(x, F.lit(16.0))
    series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return F.when(x < 16, small).otherwise(series)


def _absent(n: Column, k: Column, g: Column) -> Column:
    """Chance that none of g samples drawn from n carries an allele seen in k: (n-k)! (n-g)! / (n! (n-k-g)!).

    The shorter of two equal products, if it is short. Else Stirling's series of the four factorials, joined so that the large
    terms cancel on paper: what is left are logarithms of ratios, good to eight digits at 10^9 samples.
    """
    n, k, g = (c.cast("double") for c in (n, k, g))
    steps, other = F.least(g, k), F.greatest(g, k)
    product = F.aggregate(F.sequence(F.lit(0), F.least(F.greatest(steps - 1, F.lit(0.0)), F.lit(FACTORS - 1.0)).cast("int")), F.lit(1.0),
                          lambda acc, i: acc * (n - other - i) / F.nullif(n - i, F.lit(0.0)))
    b, c, d = n - k, n - g, n - k - g
    inverse = lambda power: 1 / F.pow(b, F.lit(power)) + 1 / F.pow(c, F.lit(power)) - 1 / F.pow(d, F.lit(power)) - 1 / F.pow(n, F.lit(power))
    joined = (b + 0.5) * F.log1p(-k / n) + (c + 0.5) * F.log1p(-g / n) - (d + 0.5) * F.log1p(-(k + g) / n) + inverse(1.0) / 12 - inverse(3.0) / 360
    few_left = _log_factorial(b) + _log_factorial(c) - _log_factorial(n) - _log_factorial(d)
    return (F.when(d < 0, F.lit(0.0)).when(steps <= 0, F.lit(1.0)).when(steps <= FACTORS, product)
            .otherwise(F.exp(F.when(d < 16, few_left).otherwise(joined))))


def rarefied_richness(freqs: DataFrame, keys=(*POPULATION, "time_bin"), compare=("project_id", "target_species", "time_bin")) -> DataFrame:
    """Alleles expected at the smallest sample size among the cells compared."""
    group = [*keys, "locus_name"]
    # the table of frequencies is small by now: one window over the compared cells' alleles of a locus
    rows = freqs.withColumn("rarefaction_size", F.min("sample_count").over(Window.partitionBy(*compare, "locus_name")))
    seen = F.lit(1.0) - _absent(F.col("sample_count"), F.col("allele_samples"), F.col("rarefaction_size"))
    return rows.groupBy(*group).agg(F.sum(seen).alias("allelic_richness"), F.max("rarefaction_size").alias("rarefaction_size"),
                                    F.max("sample_count").alias("sample_count"))


def shared_loci(loci: DataFrame, keys=POPULATION, year: str = "year", carry=("sample_count",)) -> DataFrame:
    """Every earlier/later year pair of a group that shares a locus. Years per locus are few."""
    group = [*keys, "locus_name"]
    first = loci.select(*group, F.col(year).alias("first_year"), *[F.col(c).alias(f"first_{c}") for c in carry])
    second = loci.select(*group, F.col(year).alias("second_year"), *[F.col(c).alias(f"second_{c}") for c in carry])
    return first.join(second, group).filter(F.col("first_year") < F.col("second_year"))


def _generation(species: str, cfg: GeneticConfig, default: float | None) -> Column:
    value = F.lit(default if default is not None else cfg.generation_years).cast("double")
    if cfg.generation_years_by_species:
        table = F.create_map(*[F.lit(x) for kv in cfg.generation_years_by_species.items() for x in (kv[0], float(kv[1]))])
        return F.coalesce(F.try_element_at(table, F.col(species)), value)
    return value


def temporal_ne(df: DataFrame | None, generation_years: float | None = None, keys=POPULATION, cfg: GeneticConfig = GENETICS,
                freqs: DataFrame | None = None) -> DataFrame:
    """Effective size from allele-frequency drift between calendar years: the median over year pairs and loci.

    ``freqs`` are frequencies by (keys, ``year``) if they are known already. Every allele of a locus holds its frequencies by year, and the
    locus' years with their samples come beside it, so each pair of years is one row per allele and nothing is joined.
    """
    if freqs is None:
        freqs = allele_frequencies(df.withColumn("year", F.year("collection_date")), [*keys, "year"])
    group = [*keys, "locus_name"]
    alleles = freqs.filter("year is not null").groupBy(*group, "allele").agg(F.map_from_entries(F.collect_list(F.struct("year", "p"))).alias("p"),
                                                  F.collect_list(F.struct("year", "sample_count")).alias("__y"))
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_set("__y").over(Window.partitionBy(*group)))))
    pairs = F.flatten(F.transform("__y", lambda a, i: F.transform(F.slice("__y", i + 2, F.size("__y")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    each = alleles.withColumn("__y", years).select(*group, "p", F.explode(pairs).alias("t"))
    p1, p2 = (F.coalesce(F.try_element_at("p", F.col(f"t.{s}.year")), F.lit(0.0)) for s in ("first", "second"))
    both = each.select(*group, "t", p1.alias("p1"), p2.alias("p2"))
    mean = (F.col("p1") + F.col("p2")) / 2.0
    spread = mean * (F.lit(1.0) - mean)
    noise = F.lit(0.5) / F.col("t.first.sample_count") + F.lit(0.5) / F.col("t.second.sample_count")
    drift = F.greatest(F.lit(0.0), F.pow(F.col("p2") - F.col("p1"), F.lit(2.0)) / F.nullif(spread, F.lit(0.0)) - noise)
    drifts = both.filter(spread > 0).groupBy(*group, F.col("t.first.year").alias("first_year"), F.col("t.second.year").alias("second_year")).agg(
        F.avg(drift).alias("drift")).filter("drift > 0")
    generations = (F.col("second_year") - F.col("first_year")) / F.nullif(_generation(keys[1], cfg, generation_years), F.lit(0.0))
    # year pairs x loci of one population: a few thousand values at most enter the exact median
    return drifts.withColumn("ne", generations / (F.col("drift") * 2.0)).filter(F.col("ne").isNotNull()).groupBy(*keys).agg(
        F.percentile("ne", F.lit(0.5)).alias("effective_population_size"), F.count(F.lit(1)).alias("estimates"))


def population_metrics(df: DataFrame, cfg: GeneticConfig = GENETICS, generation_years: float | None = None,
                       season_mode: str = "calendar") -> DataFrame:
    """Diversity, effective size and risk status per project, species, cell and period."""
    binned = df.withColumn("time_bin", time_bin("collection_date", cfg.time_bin, season_mode))
    keys = [*POPULATION, "time_bin"]
    freqs = cut_lineage(allele_frequencies(binned, keys))
    # a period that is a calendar year has the drift's frequencies already
    yearly = freqs.withColumn("year", F.col("time_bin").cast("int")) if cfg.time_bin == "year" else None
    rich = rarefied_richness(freqs, keys)
    he = expected_heterozygosity(freqs)
    loci = he.join(rich, [*keys, "locus_name"]).filter(F.col("sample_count") >= cfg.minimum_samples)
    groups = loci.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("locus_count"), F.avg("expected_heterozygosity").alias("mean_expected_heterozygosity"),
        F.avg("allelic_richness").alias("mean_allelic_richness"),
        F.min(F.least("rarefaction_size", "sample_count")).alias("rarefaction_sample_size"))
    samples = binned.groupBy(*keys).agg(F.countDistinct("sample_id").alias("sample_count"))
    ne = temporal_ne(df, generation_years, POPULATION, cfg, yearly).drop("estimates")
    out = groups.join(samples, keys).join(ne, list(POPULATION), "left")
    size = F.col("effective_population_size")
    status = (F.when(size.isNull(), "INSUFFICIENT_DATA").when(size < cfg.critical_ne, "CRITICAL_INBREEDING_RISK")
              .when(size < cfg.vulnerable_ne, "VULNERABLE_POPULATION_RISK").otherwise("LOW_RISK"))
    return (out.withColumn("effective_population_method", F.when(size.isNotNull(), "TEMPORAL_VARIANCE_APPROXIMATION"))
            .withColumn("critical_inbreeding_risk", F.coalesce(size < cfg.critical_ne, F.lit(False))).withColumn("risk_status", status))


def genetics_summary(records: DataFrame, scopes: DataFrame, scope=("scope_id",), cfg: RiskConfig = RISK) -> DataFrame:
    """Per assessment scope: samples, diversity and the newest effective size of the year before its end.

    ``heterozygosity_from_counts`` averages loci with one allele as 0, as the scorer does when
    no record carries its own estimate.
    """
    rows = records.join(scopes.select(*scope, "species_id", "h3_cell", "window_end_ms"), ["species_id", "h3_cell"])
    end = F.to_date(F.timestamp_millis("window_end_ms"))
    start = F.to_date(F.timestamp_millis(F.col("window_end_ms") - int(cfg.genetics_lookback_days * DAY_MS)))
    rows = rows.filter(F.col("collection_date").between(start, end))
    ne = F.col("effective_population_size")
    head = rows.groupBy(*scope).agg(
        F.countDistinct("sample_id").alias("edna_sample_count"), clamp(F.avg("expected_heterozygosity"), 0.0, 1.0).alias("expected_heterozygosity"),
        F.avg("allelic_richness").alias("allelic_richness"),
        F.greatest(F.lit(0.0), F.max_by(ne, F.when(ne.isNotNull(), F.struct("collection_date", "id")))).alias("effective_population_size"))
    copies = F.bround(F.col("frequency") * 2 * F.col("genotyped_individuals")).cast("bigint")
    counts = (rows.select(*scope, "locus_name", "genotyped_individuals", F.explode("allele_frequencies").alias("allele", "frequency"))
              .groupBy(*scope, "locus_name", "allele").agg(F.sum(copies).alias("copies")).filter("copies > 0"))
    totals = counts.groupBy(*scope, "locus_name").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("copies")).alias("sq"))
    loci = totals.groupBy(*scope).agg(F.count(F.lit(1)).alias("loci"),
                                      F.avg(F.lit(1.0) - F.col("sq") / (F.col("n") * F.col("n"))).alias("heterozygosity_from_counts"))
    return head.join(loci, list(scope), "left")


def edna_batch_summary(df: DataFrame) -> DataFrame:
    """Per project: samples, records, cells and the extent of the cells (the cells themselves: ``edna_batch_cells``)."""
    cells = edna_batch_cells(df).withColumn("b", cell_bounds("h3_cell"))
    extent = cells.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("cell_count"), F.min("b.min_lat").alias("min_latitude"), F.max("b.max_lat").alias("max_latitude"),
        F.min("b.min_lon").alias("min_longitude"), F.max("b.max_lon").alias("max_longitude"))
    return df.groupBy("project_id").agg(F.countDistinct("sample_id").alias("sample_count"), F.count(F.lit(1)).alias("record_count")).join(extent, "project_id")


def edna_batch_cells(df: DataFrame) -> DataFrame:
    return df.select("project_id", "h3_cell").distinct()


def genotype_codes(df: DataFrame) -> DataFrame:
    """Code of each distinct genotype of a locus, in text order, from 0."""
    value = F.coalesce(F.col("allele_state"), F.col("sequence")) if "sequence" in df.columns else F.col("allele_state")
    kinds = df.select("project_id", "locus_name", value.alias("genotype")).filter("genotype is not null").distinct()
    order = Window.partitionBy("project_id", "locus_name").orderBy("genotype")
    return kinds.withColumn("code", F.row_number().over(order) - 1)


def genotype_matrix(df: DataFrame, loci) -> DataFrame:
    """Sample × locus matrix of codes, -1 where nothing was called. ``loci`` is the configured assay list."""
    value = F.coalesce(F.col("allele_state"), F.col("sequence")) if "sequence" in df.columns else F.col("allele_state")
    long = df.select("project_id", "sample_id", "locus_name", value.alias("genotype")).join(
        genotype_codes(df), ["project_id", "locus_name", "genotype"], "left")
    return long.groupBy("project_id", "sample_id").pivot("locus_name", list(loci)).agg(F.max("code")).fillna(-1)
