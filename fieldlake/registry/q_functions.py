"""Scalar functions over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.config import MEASUREMENTS
from fieldlake.functions import jsonx, mathx, text, timex
from fieldlake.registry.core import query, rounded
from fieldlake.registry.views import table, view


@query("norm_text", "select c_custkey, nullif(lower(trim('  ' || c_mktsegment || ' ')), '') as segment, upper(trim(c_name)) as name from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.norm_text(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment"),
                                               F.upper(F.trim("c_name")).alias("name"))


@query("fmt_metric", "select c_custkey, coalesce(case when c_custkey % 5 > 0 then printf('%.2f', c_acctbal) end, 'NULL') as balance from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", text.fmt_metric(F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")), 2).alias("balance"))


def _case(expr, mapping, other="''"):
    return f"case {expr} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + f" else {other} end"


# written out by hand, beside the expressions they check
UNITS = dict(zip(MEASUREMENTS, ("pH", "mg/L", "NTU", "°C", "PSU", "m/s", "µS/cm", "°C", "%", "hPa", "mg/L", "mg/L", "mg/L", "level", "level")))
LABELS = {m: " ".join(w.capitalize() for w in m.split("_")) for m in MEASUREMENTS}
NAME_OF = "case event_id % 15 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MEASUREMENTS)) + " end"


@query("unit_and_label", f"""
select name, {_case('name', UNITS)} as unit, {_case('name', LABELS)} as label, count(*) as events
from (select {NAME_OF} as name from events) group by 1""")
def _(spark, sf):
    df = table(spark, sf, "events").select(F.expr(NAME_OF).alias("name"))
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("events")).select(
        "name", "events", text.unit_of("name").alias("unit"), text.label_of("name").alias("label"))


@query("split_alleles", """
select allele, count(*) as copies from (select unnest(list_filter(list_transform(regexp_split_to_array(allele_state, '[/|;,]'), lambda a: trim(a)), lambda a: a <> '')) as allele
  from (select case when l_linenumber % 3 = 0 then l_returnflag || ' ; ' || l_linestatus when l_linenumber % 3 = 1 then l_returnflag || '|' || l_linestatus || ','
    else l_returnflag end as allele_state from lineitem)) group by 1""")
def _(spark, sf):
    state = F.expr("""case when l_linenumber % 3 = 0 then l_returnflag || ' ; ' || l_linestatus
        when l_linenumber % 3 = 1 then l_returnflag || '|' || l_linestatus || ',' else l_returnflag end""")
    return (table(spark, sf, "lineitem").select(F.explode(text.split_alleles(state)).alias("allele"))
            .groupBy("allele").agg(F.count(F.lit(1)).alias("copies")))


@query("clean_sequence", r"""
select item_id, length(cleaned) as letters, regexp_full_match(cleaned, '[ACGTN]+') as is_sequence, cleaned
from (select item_id, upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'SS')) as cleaned from benchmark)""")
def _(spark, sf):
    df = table(spark, sf, "benchmark").select("item_id", text.clean_sequence("text").alias("cleaned"),
                                              text.is_nucleotides("text").alias("is_sequence"))
    return df.withColumn("letters", F.length("cleaned").cast("bigint"))


@query("header_fields", """
select l_orderkey, l_linenumber, l_orderkey::varchar || ' x' as sample, 'L' || l_linenumber as locus, l_returnflag as flag, 3 as fields from lineitem""")
def _(spark, sf):
    header = F.concat(F.lit("read sample=\""), F.col("l_orderkey").cast("string"), F.lit(" x\" Locus = L"), F.col("l_linenumber").cast("string"),
                      F.lit("; flag='"), F.col("l_returnflag"), F.lit("' tail"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.header_fields(header).alias("m"))
    return df.select("l_orderkey", "l_linenumber", F.col("m.sample").alias("sample"), F.col("m.locus").alias("locus"),
                     F.col("m.flag").alias("flag"), F.size("m").alias("fields"))


@query("mean_phred", """
select p_partkey, round(list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c) - 33)) / length(p_name), 6) as quality from part""")
def _(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", text.mean_phred("p_name").alias("quality")), "quality", digits=6)


@query("excerpt", "select doc_id, md5(case when length(text) > 400 then substring(text, 1, 400) || '...' else text end) as digest from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.excerpt("text", 400)).alias("digest"))


@query("render", """
select o_orderkey, 'CRI is ' || printf('%.1f', round(o_totalprice / 5000, 1)) || ' for ' || o_orderpriority || '.' as line from orders""")
def _(spark, sf):
    score = text.fmt_metric(F.round(F.col("o_totalprice") / 5000, 1))
    return table(spark, sf, "orders").select("o_orderkey", text.render("CRI is {{CRI}} for {{NAME}}.", CRI=score, NAME="o_orderpriority").alias("line"))


@query("threat_weight", """
select class_name, case class_name when 'gunshot' then 1.0 when 'chainsaw' then 0.7 when 'vehicle_engine' then 0.4 else 0.5 end::double as weight,
  class_name like '%carcass%' as mortality, count(*) as events from v_detections group by 1""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").groupBy("class_name").agg(F.count(F.lit(1)).alias("events"))
    return df.select("class_name", "events", text.threat_weight("class_name").alias("weight"), text.is_mortality("class_name").alias("mortality"))


@query("extract_levels", """
select c_custkey, 0 as position, (c_custkey % 5 + 1)::int as level, 'Watch ' || c_name as action from customer
union all select c_custkey, 1, (c_nationkey % 5 + 1)::int, 'Patrol ' || c_mktsegment from customer""")
def _(spark, sf):
    body = F.concat(F.lit("Summary\n- Level "), (F.col("c_custkey") % 5 + 1).cast("string"), F.lit(": **Watch** "), "c_name",
                    F.lit("\nLevel 3: prose\n * **Level "), (F.col("c_nationkey") % 5 + 1).cast("string"), F.lit("** - Patrol "), "c_mktsegment", F.lit("  \n"))
    return text.extract_levels(table(spark, sf, "customer").select("c_custkey", body.alias("report")), "report", "c_custkey")


@query("cursor_round_trip", """
select id, rtrim(translate(base64(encode('["gps",' || recorded_epoch_ms || ',' || id || ']')), '+/', '-_'), '=') as cursor, recorded_epoch_ms as ms, id as back
from v_telemetry""")
def _(spark, sf):
    df = view(spark, sf, "v_telemetry").select("id", text.encode_cursor(F.lit("gps"), "recorded_epoch_ms", "id").alias("cursor"))
    got = text.decode_cursor("cursor")
    return df.select("id", "cursor", got["epoch_ms"].alias("ms"), got["id"].alias("back"))


@query("timestamps", """
select event_id, MS(ts) as iso_ms, MS(ts) as packed_ms, (MS(ts) - 19800000) as offset_ms, (epoch_us(ts) // 1000000) * 1000 as exif_ms, MS(ts) // 86400000 as day from events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        "event_id", timex.epoch_ms(timex.to_utc(iso)).alias("iso_ms"),
        timex.epoch_ms(timex.parse_packed(F.date_format("ts", timex.PACKED_PATTERN))).alias("packed_ms"),
        timex.epoch_ms(timex.to_utc(F.concat(iso, F.lit("+05:30")))).alias("offset_ms"),
        timex.epoch_ms(timex.parse_exif_time(F.date_format("ts", timex.EXIF_PATTERN))).alias("exif_ms"),
        timex.day_index(timex.epoch_ms("ts")).alias("day"))


@query("epoch_round_trip", "select event_id, strftime(make_timestamp(MS(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') as text from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", timex.format_utc(timex.from_epoch_ms(timex.epoch_ms("ts"))).alias("text"))


SEASON = "case when m in (12, 1, 2) then 'winter' when m < 6 then 'spring' when m < 9 then 'summer' else 'autumn' end"


@query("time_bins", f"""
select year, month, season, reference_season, count(*) as n from (select y::varchar as year, strftime(collection_date, '%Y-%m') as month,
  (y + case when m = 12 then 1 else 0 end)::varchar || '-' || {SEASON} as season,
  (y - case when m = 12 then 1 else 0 end)::varchar || '-' || {SEASON} as reference_season
  from (select *, year(collection_date) as y, month(collection_date) as m from v_edna_samples)) group by all""")
def _(spark, sf):
    df = view(spark, sf, "v_edna_samples")
    return df.groupBy(timex.time_bin("collection_date", "year").alias("year"), timex.time_bin("collection_date", "month").alias("month"),
                      timex.time_bin("collection_date", "season").alias("season"),
                      timex.time_bin("collection_date", "season", "reference").alias("reference_season")).agg(F.count(F.lit(1)).alias("n"))


@query("scoring_formulas", """
select event_id, round(greatest(0, least(100, 100 * (value / 100) / 0.5)), 6) as linear,
  round(pow(2, -(event_id % 1000) / 48.0), 6) as decayed, round(100 * (1 - exp(-value / 100)), 6) as saturated,
  round(case when value / 50 <= 0 then 0 when value / 50 < 2 then 40 * pow(value / 100, 2) else 40 + 60 * (1 - exp(-1.5 * (value / 50 - 2))) end, 6) as climate,
  round(case when value <= 0.5 then 1 else 1 - pow(1 - 1 / (2 * value), 10) end, 6) as inbreeding,
  round(48.0 / ((event_id + 1) * ln(2)) * (1 - pow(2, -(event_id + 1) / 48.0)), 6) as spread,
  round(case event_id % 3 when 0 then greatest(0, (value - 50) / 10) when 1 then greatest(0, (50 - value) / 10) else abs(value - 50) / 10 end, 6) as adverse,
  round(case when event_id % 4 = 0 then 0.3 * 50 + 0.3 * 20 when event_id % 4 = 1 then 0.4 * value / 10 + 0.3 * 50 + 0.3 * 20 else 0.4 * value / 10 + 0.3 * 20 end
    / case when event_id % 4 = 0 then 0.6 when event_id % 4 = 1 then 1.0 else 0.7 end, 6) as weighted,
  case when value < 20 then 1 when value < 40 then 2 when value < 60 then 3 when value <= 80 then 4 else 5 end::int as level,
  case when value >= 80 then 'IMMEDIATE' when value >= 60 then 'HIGH' when value >= 40 then 'ELEVATED' when value >= 20 then 'ROUTINE' else 'MONITOR' end as tier
from events""")
def _(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    third = i % 4
    out = table(spark, sf, "events").select(
        "event_id", mathx.scale_to_risk("herd_decline", v / 100).alias("linear"), mathx.decay(i % 1000, 48.0).alias("decayed"),
        mathx.saturate(v / 100, 3.0).alias("saturated"), mathx.escalate_climate(v / 50).alias("climate"), mathx.projected_f("value").alias("inbreeding"),
        mathx.mean_decay(i + 1, 48.0).alias("spread"),
        mathx.adverse_z("value", F.lit(50.0), F.lit(10.0), F.when(i % 3 == 0, 1).when(i % 3 == 1, -1).otherwise(0)).alias("adverse"),
        mathx.weighted_score({"trend": F.when(third != 0, v / 10), "viability": F.when(third <= 1, 50.0), "recruitment": F.lit(20.0)},
                             {"trend": 0.4, "viability": 0.3, "recruitment": 0.3}).alias("weighted"),
        mathx.escalation_level("value").alias("level"), mathx.priority_tier("value").alias("tier"))
    return rounded(out, "linear", "decayed", "saturated", "climate", "inbreeding", "spread", "adverse", "weighted", digits=6)


@query("delta_trend", """
select o_orderkey, round(case when p is null then null when p = 0 then case when c = 0 then 0 end else (c - p) / abs(p) * 100 end, 6) as percent,
  case when p is null then 'unknown' when p = 0 then case when c > 0 then 'up' when c < 0 then 'down' else 'flat' end
    when abs((c - p) / abs(p) * 100) < 1 then 'flat' when c > p then 'up' else 'down' end as trend
from (select o_orderkey, o_custkey % 7 as c, case when o_orderkey % 11 = 0 then null else o_orderkey % 7 end as p from orders)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("c"),
                                           F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 7).alias("p"))
    percent, trend = mathx.delta_trend("c", "p")
    return rounded(df.select("o_orderkey", percent.alias("percent"), trend.alias("trend")), "percent", digits=6)


@query("clamp_unit", """
select event_id, case when x < 0 and x >= -0.000001 then 0 when x > 1 and x <= 1.000001 then 1 else x end as unit
from (select event_id, case event_id % 4 when 0 then -0.0000005 when 1 then 1.0000005 when 2 then 1.5 else 0.25 end::double as x from events)""")
def _(spark, sf):
    x = F.expr("cast(case event_id % 4 when 0 then -0.0000005 when 1 then 1.0000005 when 2 then 1.5 else 0.25 end as double)")
    return table(spark, sf, "events").select("event_id", mathx.clamp_unit(x).alias("unit"))


@query("json_paths", """
select event_id, cast(json_extract_string(props, '$.k') as double) as k, cast(null as double) as absent, 'k' as keys,
  '{"id":' || event_id || ',"kind":"' || event_type || '"}' as document from events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", jsonx.json_num("props", "$.k").alias("k"), jsonx.json_num(F.concat("props", F.lit("}")), "$.zz").alias("absent"),
        F.array_join(F.map_keys(jsonx.allele_map("props")), ",").alias("keys"),
        jsonx.to_document(F.col("event_id").alias("id"), F.col("event_type").alias("kind")).alias("document"))


@query("decode_json", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, false as text_decodes from events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", jsonx.decode_json("props").alias("v"), jsonx.decode_json("event_type").alias("t"))
    return df.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("t").isNotNull().alias("text_decodes"))


@query("map_keys", """
select l_orderkey, l_linenumber, case when l_returnflag = l_linestatus then l_returnflag else '' end as shared,
  array_to_string(list_sort(list_distinct([l_returnflag, l_linestatus])), ',') as together from lineitem""")
def _(spark, sf):
    one, two = F.create_map("l_returnflag", F.lit(0.5)), F.create_map("l_linestatus", F.lit(0.5))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(jsonx.shared_keys(one, two), ",").alias("shared"),
        F.array_join(jsonx.all_keys(one, two), ",").alias("together"))


@query("merge_ids", """
select o_orderkey, array_to_string(list_sort(list_distinct([o_custkey % 7, o_custkey % 3, o_orderkey % 7])), ',') as ids,
  case when o_orderpriority = o_orderstatus then o_orderpriority else o_orderpriority || ',' || o_orderstatus end as ordered from orders""")
def _(spark, sf):
    a = F.array(F.col("o_custkey") % 7, F.col("o_custkey") % 3)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(jsonx.merge_ids(a, F.array(F.col("o_orderkey") % 7), F.lit(None).cast("array<bigint>")), ",").alias("ids"),
        F.array_join(jsonx.distinct_ordered(F.array("o_orderpriority", "o_orderstatus", "o_orderpriority")), ",").alias("ordered"))


@query("measurements_map", """
select id, case when relative_humidity_percent is null then 'ambient_temperature_c' else 'ambient_temperature_c,relative_humidity_percent' end as reported,
  relative_humidity_percent as humidity from v_sensor_readings""")
def _(spark, sf):
    from fieldlake.operators.filters import measurements_view
    df = measurements_view(view(spark, sf, "v_sensor_readings"))
    return df.select("id", F.array_join(F.array_sort(F.map_keys("measurements")), ",").alias("reported"),
                     F.try_element_at("measurements", F.lit("relative_humidity_percent")).alias("humidity"))


@query("clock_check", f"""
select count(*) as early from events where MS(ts) <= {1705363200000} + 300000""")
def _(spark, sf):
    from fieldlake.operators.filters import not_future
    df = table(spark, sf, "events").select(timex.epoch_ms("ts").alias("ms"))
    return df.filter(not_future("ms", 300, F.lit(1705363200000))).agg(F.count(F.lit(1)).alias("early"))
