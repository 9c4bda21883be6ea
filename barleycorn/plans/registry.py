"""The queries of the core package by name, and DuckDB SQL with the same rows."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Classify, Scoring, Template
from ..functions.alignment import Letters
from ..functions.estimators import ln_mean, percentile_of_score, stars, two_sided
from ..functions.sequence import degenerate, expected_errors, find_with_substitutions, gc_count, hamming, longest_run, passes_chastity, reverse_complement
from ..operators import align, annotate, cohorts, demux, denoise, errormodel, fits, multiple, pairs, quantify, resample, tumors
from ..operators import reads as rd
from ..sources.fastq import fastq_text, header_fields
from ..sources.tables import merge_replicates, sam_lines, transition_matrix, with_metadata
from . import adapters as ad
from .adapters import ANNOTATE, CLUSTERS, COMBINED, GUIDES, INERT_BRANDS, QUANTIFY, READS, SPIKE_BRAND, TESTS, TUMORS

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "relative_ln_means"

INERT_SQL = ", ".join(f"'{b}'" for b in INERT_BRANDS)


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floating-point numbers depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- tumour sizes

LN_MEANS = f"""{TUMORS}, means as (
  select target, count(*) as n, exp(avg(ln(cells)) + var_pop(ln(cells)) / 2) as ln_mean from tumors group by target)"""


@query(f"with {TUMORS} select sample, target, barcode, cells from tumors where sample not in (select cast(s_suppkey as varchar) from supplier where s_acctbal < 0)")
def without_samples(spark: SparkSession, d: str) -> DataFrame:
    poor = ad.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("sample"))
    return tumors.without_samples(ad.tumors(spark, d), poor).select("sample", "target", "barcode", "cells")


@query(f"""with {TUMORS}, f as (select target, avg(ln(cells)) as m, stddev_pop(ln(cells)) as d, count(*) as n, count(case when cells > 50000 then 1 end) as k, sum(case when cells > 50000 then ln(cells / 50000) end) as s
  from tumors where cells > 0 group by target), x as (select cast(i as integer) as k, pow(10.0, 3 + 2.0 * i / 40) as size from range(41) r(i))
select target, x.k, round(size, 6) as size, round(1e6 * exp(-pow((ln(size) - m) / d, 2) / 2) / (size * d * sqrt(2 * pi())), 6) as log_normal,
  case when size >= 50000 then round(1e6 * (1 + f.k / s) * pow(50000, f.k / s) * pow(size, -1 - f.k / s) * f.k / n, 6) end as power_law from f, x""")
def density_curves(spark: SparkSession, d: str) -> DataFrame:
    own = ad.tumors(spark, d)
    curves = tumors.density_curves(own, tumors.power_tails(own, 50_000.0), 3.0, 2.0, 41)
    return rounded(curves.withColumns({c: 1e6 * F.col(c) for c in ("log_normal", "power_law")}), "size", "log_normal", "power_law")


@query(f"with {LN_MEANS} select target, n, round(ln_mean, 6) as ln_mean, round(ln_mean / (select median(ln_mean) from means where target in ({INERT_SQL})), 6) as relative from means")
def relative_ln_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.relative_ln_means(ad.tumors(spark, d), INERT_BRANDS), "ln_mean", "relative")


@query(f"with {TUMORS} select sample, target, count(*) as n, round(exp(avg(ln(cells)) + var_pop(ln(cells)) / 2), 6) as ln_mean from tumors group by sample, target")
def ln_means_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.ln_means(ad.tumors(spark, d), ("sample", "target")), "ln_mean")


@query(f"""with {TUMORS}, p as (select unnest([50, 60, 70, 80, 90, 95, 99]) as percent)
select target, percent, round(quantile_cont(cells, percent / 100), 6) as cells from tumors, p group by target, percent""".replace("quantile_cont(cells, percent / 100)", "case percent " + " ".join(f"when {p} then quantile_cont(cells, {p / 100})" for p in (50, 60, 70, 80, 90, 95, 99)) + " end"))
def size_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.size_percentiles(ad.tumors(spark, d)), "cells").select("target", "percent", "cells")


@query(f"""with {TUMORS}, levels as (select sample, median(cells) as level from tumors where target in ({INERT_SQL}) group by sample)
select sample, target, barcode, cells, round(cells / nullif(level, 0), 6) as relative from tumors left join levels using (sample)""")
def inert_normalized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.inert_normalized(ad.tumors(spark, d), INERT_BRANDS), "relative").select("sample", "target", "barcode", "cells", "relative")


@query(f"""with {TUMORS}, counts as (select target, cast(floor(log10(cells)) as integer) as decade, count(*) as n from tumors where cells > 0 group by all)
select target, decade, n, round(n / sum(n) over (partition by target), 9) as share from counts""")
def decade_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.decade_shares(ad.tumors(spark, d)), "share", digits=9)


@query(f"""with {TUMORS}, counts as (select target, cast(floor(log10(cells) * 4) as integer) as bin, count(*) as n from tumors where cells > 0 group by all)
select target, bin, n, round(n / sum(n) over (partition by target) / (pow(10.0, (bin + 1) / 4) - pow(10.0, bin / 4)), 12) as density from counts""")
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.log_histogram(ad.tumors(spark, d)), "density", digits=12)


@query(f"""with {TUMORS}, y as (select target, ln(cells) as y from tumors), sums as (select target, count(*) as n, sum(y) as s, sum(y * y) as q from y group by target),
m as (select target, n, y, q, (s - y) / (n - 1) as m from y join sums using (target) where n > 1),
o as (select target, exp(m + ((q - y * y) / (n - 1) - m * m) / 2) as o from m),
d as (select target, o - avg(o) over (partition by target) as d from o)
select target, round(sum(pow(d, 3)) / nullif(6 * pow(sum(pow(d, 2)), 1.5), 0), 6) as acceleration from d group by target""")
def jackknife_ln_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.jackknife_ln_means(ad.tumors(spark, d)), "acceleration")


@query(f"""with {TUMORS}, sums as (select sample, target, avg(ln(cells)) as m, count(*) as n, sum(ln(cells) * ln(cells)) as q, sum(ln(cells)) as s from tumors group by all)
select round(1 - sum(q - n * m * m) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) as r2 from sums""")
def levels_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.levels_r2(ad.tumors(spark, d).withColumn("y", F.ln("cells")), ["sample", "target"], "y"), "r2")


@query(f"""with {TUMORS}, one as (select distinct sample, target, barcode from tumors)
select x.sample as a, y.sample as b, count(*) as shared from one x join one y using (target, barcode) where x.sample < y.sample group by all""")
def barcode_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return tumors.barcode_overlaps(ad.tumors(spark, d))


@query(f"""with {TUMORS}, seen as (select target, barcode, count(distinct sample) as k from tumors group by all)
select target, count(*) as observed, round(avg(k), 6) as mean_samples from seen group by target""")
def observed_barcodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tumors.observed_barcodes(ad.tumors(spark, d)), "mean_samples")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    s = ad.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("sample"), F.col("s_nationkey").alias("genotype"), (F.col("s_acctbal") < 0).alias("dropped"), F.concat(F.lit("merged"), (F.col("s_suppkey") % 10).cast("string")).alias("merger"))


@query(f"""with {TUMORS}, meta as (select cast(s_suppkey as varchar) as sample, s_nationkey as genotype, s_acctbal < 0 as dropped, 'merged' || (s_suppkey % 10) as merger from supplier)
select genotype, merger as sample, target, barcode, round(avg(cells), 6) as cells from tumors join meta using (sample) where not coalesce(dropped, false) group by all""")
def meta_join_drop_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(with_metadata(ad.tumors(spark, d), _metadata(spark, d), ["genotype"], "dropped", "merger"), "cells")


@query(f"with {TUMORS} select target, barcode, round(median(cells), 6) as cells from tumors group by all")
def replicate_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(merge_replicates(ad.tumors(spark, d), ["target", "barcode"], "median"), "cells")


@query(f"""with {TUMORS}, means as (select sample, target, exp(avg(ln(cells)) + var_pop(ln(cells)) / 2) as v from tumors group by all),
cohort as (select target, exp(avg(ln(cells)) + var_pop(ln(cells)) / 2) as c from tumors group by all),
p as (select target, avg(cast(v < c as integer)) * 0.5 + avg(cast(v <= c as integer)) * 0.5 as place from means join cohort using (target) group by target)
select target, round(place, 9) as place, round(2 * least(place, 1 - place), 9) as p,
  case when round(2 * least(place, 1 - place), 9) < 0.0001 then '****' when round(2 * least(place, 1 - place), 9) < 0.001 then '***' when round(2 * least(place, 1 - place), 9) < 0.01 then '**' when round(2 * least(place, 1 - place), 9) < 0.05 then '*' else '' end as stars from p""")
def cohort_places(spark: SparkSession, d: str) -> DataFrame:
    t = ad.tumors(spark, d)
    means = tumors.ln_means(t, ("sample", "target")).withColumnRenamed("ln_mean", "v")
    cohort = t.groupBy("target").agg(ln_mean(F.col("cells")).alias("c"))
    place = means.join(cohort, "target").groupBy("target").agg(percentile_of_score(F.col("v"), F.col("c")).alias("place"))
    out = place.select("target", F.round("place", 9).alias("place"), F.round(two_sided(F.col("place")), 9).alias("p"))
    return out.withColumn("stars", stars(F.col("p")))


# ---- many P-values

_M = "(select count(*) from tests)"


@query(f"with {TESTS} select name, p, p <= 0.05 / {_M} as reject from tests")
def fwer_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return multiple.bonferroni(ad.tests(spark, d))


@query(f"with {TESTS} select name, p, p <= 1 - pow(0.95, 1.0 / {_M}) as reject from tests")
def fwer_sidak(spark: SparkSession, d: str) -> DataFrame:
    return multiple.sidak(ad.tests(spark, d))


_RANKED = f"ranked as (select name, p, row_number() over (order by p, name) - 1 as k, {_M} as m from tests), marked as (select *, p > 0.05 / (m + 1 - k) as over from ranked)"


@query(f"with {TESTS}, {_RANKED.replace(' as over ', ' as above ')} select name, p, coalesce(p < (select min(p) from marked where above), true) as reject from marked")
def fwer_holm(spark: SparkSession, d: str) -> DataFrame:
    return multiple.holm(ad.tests(spark, d))


@query(f"with {TESTS}, {_RANKED.replace(' as over ', ' as above ')} select name, p, coalesce(k < (select min(k) from marked where above), true) as reject from marked")
def fwer_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return multiple.hochberg(ad.tests(spark, d))


# ---- reads


@query(f"with {READS} select sample, read_id, header, dna, qc from reads where not contains(header, ':Y:')")
def chastity_filter(spark: SparkSession, d: str) -> DataFrame:
    return rd.chaste(ad.reads(spark, d))


@query(f"with {READS} select sample, read_id, dna from reads where not contains(dna, 'N')")
def degenerate_filter(spark: SparkSession, d: str) -> DataFrame:
    return rd.without_degenerate(ad.reads(spark, d)).select("sample", "read_id", "dna")


@query(f"""with {READS}, cut as (select read_id, substr(dna, 1, 28 + cast(read_id % 5 as integer) // 4) as dna from reads),
few as (select length(dna) as n from cut order by read_id limit 999) select read_id, dna from cut where length(dna) = (select cast(floor(median(n)) as integer) from few)""")
def length_mode_filter(spark: SparkSession, d: str) -> DataFrame:
    cut = ad.reads(spark, d).select("read_id", F.substring("dna", F.lit(1), F.lit(28) + F.floor((F.col("read_id") % 5) / 4).cast("int")).alias("dna"))
    return rd.usual_length(cut)


@query(f"with {READS} select read_id, substr(dna, 5, 12) as dna, substr(qc, 5, 12) as qc from reads")
def co_slice(spark: SparkSession, d: str) -> DataFrame:
    return rd.co_sliced(ad.reads(spark, d), 4, 16).select("read_id", "dna", "qc")


@query(f"""with {READS}, b as (select *, cast(read_id % 7 as integer) as s from reads)
select read_id, substr(dna, s + 1, 8) || substr(dna, s + 13, 4) as dna, substr(qc, s + 1, 8) || substr(qc, s + 13, 4) as qc from b""")
def vector_slice(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("read_id") % 7).cast("int")
    bounded = ad.reads(spark, d).withColumns({"a": s, "b": s + 8, "a2": s + 12, "b2": s + 16})
    return rd.sliced_by(bounded, "a", "b", "a2", "b2").select("read_id", "dna", "qc")


@query(f"with {READS} select read_id, round(list_sum(list_transform(string_split(qc, ''), lambda c: pow(10.0, (33 - ascii(c)) / 10.0))), 6) as ee from reads")
def expected_error_sums(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).select("read_id", F.round(expected_errors(F.col("qc")), 6).alias("ee"))


@query(f"with {READS} select read_id from reads where list_sum(list_transform(string_split(qc, ''), lambda c: pow(10.0, (33 - ascii(c)) / 10.0))) <= 3.0")
def max_expected_errors(spark: SparkSession, d: str) -> DataFrame:
    return rd.few_errors(ad.reads(spark, d), 3.0).select("read_id")


@query(f"with {READS} select read_id from reads where not contains(qc, '#')")
def trusted_quality(spark: SparkSession, d: str) -> DataFrame:
    return rd.trusted_quality(ad.reads(spark, d)).select("read_id")


@query(f"with {ad.COPIES} select sample, dna as sequence, count(*) as abundance from reads group by all")
def derep(spark: SparkSession, d: str) -> DataFrame:
    return rd.dereplicated(ad.copies(spark, d))


@query(f"""with {ad.COPIES}
select sample, dna as sequence, count(*) as abundance, cast(r.i as integer) as place, round(avg(ascii(substr(qc, cast(r.i as integer), 1)) - 33), 6) as mean_q
from reads, range(1, 33) r(i) group by sample, dna, r.i""")
def derep_mean_quality(spark: SparkSession, d: str) -> DataFrame:
    means = rd.mean_qualities(ad.copies(spark, d)).select("sample", "sequence", "abundance", F.posexplode("mean_q").alias("k", "q"))
    return means.select("sample", "sequence", "abundance", (F.col("k") + 1).alias("place"), F.round("q", 6).alias("mean_q"))


@query(f"with {READS}, g as (select length(regexp_replace(dna, '[^GC]', '', 'g')) as gc, count(*) as n from reads group by all) select cast(i as integer) as gc, coalesce(n, 0) as n from range(33) r(i) left join g on g.gc = r.i")
def gc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rd.dense_counts(ad.reads(spark, d).select(gc_count(F.col("dna")).alias("gc")), "gc", 32)


_LIKE = "ACGT" * 8


@query(f"""with {READS}, s as (select cast(32 - hamming(dna, '{_LIKE}') as integer) as score, count(*) as n from reads group by all)
select cast(r.i as integer) as score, coalesce(n, 0) as n, r.i >= 10 as passed from range(33) r(i) left join s on s.score = r.i""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    score = 32 - hamming(F.col("dna"), F.lit(_LIKE), 32)
    return rd.score_histogram(ad.reads(spark, d).select(score.alias("score")), "score", 32, 10)


@query(f"""with {READS}, placed as (select *, instr(dna, 'ACG') + 2 as start from reads where instr(dna, 'ACG') > 0), cut as (
  select read_id, substr(dna, cast(start as integer) - 1, 16) as dna, substr(qc, cast(start as integer) - 1, 16) as qc from placed where start >= 2 and start + 14 <= length(dna))
select * from cut where not contains(dna, 'N')""")
def cluster_slices(spark: SparkSession, d: str) -> DataFrame:
    placed = ad.reads(spark, d).where(F.instr("dna", "ACG") > 0).withColumn("start", F.instr("dna", "ACG") + 2)
    return rd.cluster_slices(placed, "start", length=12, flank=2).select("read_id", "dna", "qc")


@query(f"""with {READS}, g as (select cast(length(regexp_replace(dna, '[^GC]', '', 'g')) as integer) as gc, count(*) as n from reads group by all)
select (select gc from g order by n desc, gc limit 1) as gc, round(max(n) / sum(n), 9) as share from g""")
def commonest_gc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rd.commonest(rd.dense_counts(ad.reads(spark, d).select(gc_count(F.col("dna")).alias("gc")), "gc", 32), "gc"), "share", digits=9)


@query(f"""with {ad.COPIES}, g as (select dna as s, count(*) as n from reads group by dna)
select s as sequence, n, round(n / (select count(*) from reads), 9) as share from g where n / (select count(*) from reads) >= 0.015""")
def unaligned_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rd.frequent(ad.copies(spark, d), 0.015), "share", digits=9)


@query(f"""with {READS}, known as (select distinct substr(translate(md5(cast(n_nationkey as varchar)), '{ad.HEX}', '{ad.BASES}'), i, 6) as k from nation, range(1, 28) r(i))
select read_id from reads where len(list_intersect(list_transform(range(1, 28), lambda i: substr(dna, i, 6)), (select list(k) from known))) > 0""")
def contaminant_kmers(spark: SparkSession, d: str) -> DataFrame:
    known = ad.table(spark, d, "nation").select(F.translate(F.md5(F.col("n_nationkey").cast("string").cast("binary")), ad.HEX, ad.BASES).alias("seq"))
    return rd.sharing_kmers(ad.reads(spark, d), known, 6).select("read_id")


@query(f"""with {READS}, b as (select dna as barcode from reads), p as (select cast(i - 1 as integer) as place, substr(barcode, i, 1) as base, count(*) as n from b, range(1, 33) r(i) group by all)
select place, base, n, round(n / sum(n) over (partition by place), 9) as share from p""".replace("cast(i - 1", "cast(r.i - 1").replace("barcode, i, 1", "barcode, cast(r.i as integer), 1"))
def barcode_pwm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rd.position_weights(ad.reads(spark, d).select(F.col("dna").alias("barcode"))), "share", digits=9)


@query(f"with {READS} select header || chr(10) || dna || chr(10) || '+' || chr(10) || qc as value from reads")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    return fastq_text(ad.reads(spark, d))


@query(f"with {READS} select read_id, 'M' as instrument, '1' as run, 'FC' as flowcell, split_part(split_part(header, ' ', 1), ':', 4) as lane, '1' as mate, split_part(split_part(header, ' ', 2), ':', 4) as \"index\" from reads")
def header_metadata(spark: SparkSession, d: str) -> DataFrame:
    return header_fields(ad.reads(spark, d)).select("read_id", "instrument", "run", "flowcell", "lane", "mate", "index")


@query(f"with {READS} select read_id, reverse(translate(dna, 'ACGT', 'TGCA')) as dna from reads")
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).select("read_id", reverse_complement(F.col("dna")).alias("dna"))


@query(f"""with {READS} select read_id, cast(coalesce(list_filter(range(0, 27), lambda i: hamming(substr(dna, cast(i as integer) + 1, 6), 'ACGTAC') <= 2)[1], -1) as integer) as place from reads""")
def find_motif(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).select("read_id", find_with_substitutions(F.col("dna"), "ACGTAC", 2).alias("place"))


@query(f"with {READS} select read_id, cast(hamming(substr(dna, 1, 16), substr(dna, 17, 16)) as integer) as distance from reads")
def half_distances(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).select("read_id", hamming(F.substring("dna", 1, 16), F.substring("dna", 17, 16), 16).alias("distance"))


@query(f"""with {READS}, ids as (select distinct substr(dna, 1, 8) as id from reads where not contains(dna, 'N'))
select id from ids where length(regexp_replace(id, '[^GC]', '', 'g')) = 4 and not regexp_matches(id, 'AAA|CCC|GGG|TTT') and not contains('GC' || id || 'AT', 'GAATTC') and not contains('GC' || id || 'AT', 'GGATCC')""")
def sgid_design_filters(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.design import usable

    ids = rd.without_degenerate(ad.reads(spark, d)).select(F.substring("dna", 1, 8).alias("id")).distinct()
    return usable(ids, 8, ("GAATTC", "GGATCC"), "GC", "AT")


@query(f"""with recursive {READS}, ids as (select distinct substr(dna, 1, 6) as id from reads where not contains(dna, 'N')),
fit as materialized (select id, row_number() over (order by id) as k from ids where length(regexp_replace(id, '[^GC]', '', 'g')) = 3 and not regexp_matches(id, 'AAA|CCC|GGG|TTT')),
g(k, taken) as (select cast(0 as bigint), cast([] as varchar[]) union all
  select f.k, case when len(list_filter(taken, lambda t: hamming(t, f.id) < 3)) = 0 then list_append(taken, f.id) else taken end from g join fit f on f.k = g.k + 1)
select unnest(taken) as id from g where k = (select count(*) from fit)""")
def sgid_design(spark: SparkSession, d: str) -> DataFrame:
    """Ids that reads show, at least three substitutions from each other."""
    from ..operators.design import taken_apart, usable

    ids = rd.without_degenerate(ad.reads(spark, d)).select(F.substring("dna", 1, 6).alias("id")).distinct()
    return taken_apart(usable(ids, 6), 6)


@query(f"""with {READS} select read_id, cast(list_max(list_transform(regexp_extract_all(dna, 'A+|C+|G+|T+|N+'), lambda r: length(r))) as integer) as longest from reads""")
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).select("read_id", longest_run(F.col("dna")).alias("longest"))


# ---- demultiplexing

_INDEX = f"""known as (select substr(translate(md5(cast(s_suppkey as varchar)), '{ad.HEX}', '{ad.BASES}'), 1, 6) as barcode, min(cast(s_suppkey as varchar)) as sample from supplier group by 1)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    s = ad.table(spark, d, "supplier")
    index = F.substring(F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), ad.HEX, ad.BASES), 1, 6)
    return s.groupBy(index.alias("barcode")).agg(F.min(F.col("s_suppkey").cast("string")).alias("sample"))


_MATCHED = """hits as (select o.index, max(case when k.barcode = o.index then k.sample end) as exact, count(k.barcode) as hits, min(k.sample) as only_one
  from observed o left join known k on hamming(o.index, k.barcode) <= 1 group by o.index),
matched as (select index, case when exact is not null then exact when hits = 1 then only_one when hits > 1 then 'conflict' else 'unknown' end as assigned,
  case when exact is not null then 'exact' when hits = 1 then 'recovered' when hits > 1 then 'conflict' else 'unknown' end as how from hits)""".replace("index", '"index"').replace('o."index"', 'o."index"')


@query(f"""with {READS}, {_INDEX}, observed as (select distinct substr(dna, 8, 6) as "index" from reads), {_MATCHED} select "index", assigned, how from matched""")
def match_indices(spark: SparkSession, d: str) -> DataFrame:
    return demux.matched_indices(ad.reads(spark, d).select(F.substring("dna", 8, 6).alias("index")).distinct(), _known(spark, d))


def _dual(spark: SparkSession, d: str) -> DataFrame:
    mate = F.when(F.col("read_id") % 4 == 0, F.substring("dna", 20, 6)).otherwise(F.translate(F.substring("dna", 8, 6), "N", "A"))
    return ad.reads(spark, d).select("read_id", F.substring("dna", 8, 6).alias("index1"), mate.alias("index2"))


_DUAL = f"""{READS}, {_INDEX}, dual as (select read_id, substr(dna, 8, 6) as index1, case when read_id % 4 = 0 then substr(dna, 20, 6) else replace(substr(dna, 8, 6), 'N', 'A') end as index2 from reads),
filled as (select *, list_aggregate(list_transform(range(1, 7), lambda i: case when substr(index1, cast(i as integer), 1) = 'N' then substr(index2, cast(i as integer), 1) else substr(index1, cast(i as integer), 1) end), 'string_agg', '') as f1,
  list_aggregate(list_transform(range(1, 7), lambda i: case when substr(index2, cast(i as integer), 1) = 'N' then substr(index1, cast(i as integer), 1) else substr(index2, cast(i as integer), 1) end), 'string_agg', '') as f2 from dual),
observed as (select f1 as "index" from filled union select f2 from filled), {_MATCHED},
assigned as (select f.read_id, f.index1, f.index2, case when a.assigned = b.assigned then a.assigned else 'conflict' end as assigned from filled f join matched a on a."index" = f.f1 join matched b on b."index" = f.f2)"""


@query(f"with {_DUAL} select read_id, index1, index2, assigned from assigned")
def demux_dual_index(spark: SparkSession, d: str) -> DataFrame:
    return demux.dual_index(_dual(spark, d), _known(spark, d))


@query(f"with {_DUAL} select assigned, count(*) as n, round(count(*) / (select count(*) from assigned), 9) as share from assigned group by assigned")
def demux_tallies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(demux.tallied(demux.dual_index(_dual(spark, d), _known(spark, d)), ["assigned"]), "share", digits=9)


_SPACED = f"""{READS}, placed as (select read_id, sample, cast(coalesce(list_filter(range(0, 29), lambda i: hamming(substr(dna, cast(i as integer) + 1, 4), 'ACGT') <= 1)[1], -1) as integer) as p,
  cast(coalesce(list_filter(range(0, 29), lambda i: hamming(substr(reverse(translate(dna, 'ACGT', 'TGCA')), cast(i as integer) + 1, 4), 'CATG') <= 1)[1], -1) as integer) as q from reads),
spaced as (select read_id, sample, cast(case when p between 1 and 3 then 2 when p between 4 and 6 then 5 when p between 7 and 9 then 8 end as integer) as forward,
  cast(case when q between 1 and 3 then 2 when q between 4 and 6 then 5 when q between 7 and 9 then 8 end as integer) as reverse from placed),
routes as (select cast(n_nationkey % 3 * 3 + 2 as integer) as forward, cast(n_nationkey // 3 % 3 * 3 + 2 as integer) as reverse, min(n_name) as sample from nation group by all),
routed as (select s.read_id, s.sample as file, s.forward, s.reverse, coalesce(r.sample, (select min_by(sample, t.reverse) from routes t where t.forward = s.forward), 'Failed') as assigned from spaced s left join routes r on r.forward = s.forward and r.reverse = s.reverse)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    r = ad.reads(spark, d).select("read_id", F.col("sample").alias("file"), "dna").withColumn("dna2", reverse_complement(F.col("dna")))
    spaced = demux.with_spacers(demux.with_spacers(r, "dna", "ACGT", [2, 5, 8], 1, 1, "forward"), "dna2", "CATG", [2, 5, 8], 1, 1, "reverse")
    k = F.col("n_nationkey")
    routes = ad.table(spark, d, "nation").groupBy((k % 3 * 3 + 2).cast("int").alias("forward"), (F.floor(k / 3) % 3 * 3 + 2).cast("int").alias("reverse")).agg(F.min("n_name").alias("sample"))
    return demux.routed_by_spacer(spaced.drop("dna", "dna2"), routes)


@query(f"with {_SPACED} select read_id, file, forward, reverse, assigned from routed")
def spacer_route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("read_id", "file", "forward", "reverse", "assigned")


@query(f"with {_SPACED} select file, count(*) as n, round(avg(cast(assigned = 'Failed' as integer)), 9) as failed from routed group by rollup (file)")
def spacer_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(demux.spacer_summary(_routed(spark, d), "file"), "failed", digits=9)


@query("""with f as (select distinct l_suppkey as name from lineitem where l_returnflag = 'R'), r as (select distinct s_suppkey as name from supplier where s_acctbal > 0)
select coalesce(f.name, r.name) as name, case when f.name is not null and r.name is not null then 'both' when f.name is not null then 'forward' else 'reverse' end as mates from f full join r on f.name = r.name""")
def mate_match(spark: SparkSession, d: str) -> DataFrame:
    f = ad.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("name"))
    return demux.mate_files(f, ad.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("name")))


# ---- clusters

_A, _K = ANNOTATE.flank, ANNOTATE.id_length
_OF_CLUSTERS = f"""{GUIDES},
exact as (select c.*, substr(sequence, {_A + 1}, {_K}) as xid, substr(sequence, {_A + _K + 1}, length(sequence) - {2 * _A + _K}) as xbarcode, substr(sequence, {_A - 1 + 1}, {_K + 3}) as w, g.target as xtarget
  from clusters c left join guides g on g.id = substr(sequence, {_A + 1}, {_K})),
misses as (select distinct sequence, w from exact where xtarget is null),
places as (select sequence, id as gid, target as gtarget, list_filter(range(0, 4), lambda i: hamming(substr(w, cast(i as integer) + 1, {_K}), id) <= 1)[1] as place from misses, guides),
hits as (select sequence, count(place) as n, count(case when place = 1 then 1 end) as there, max(case when place = 1 then gtarget end) as there_target, max(case when place is not null then gtarget end) as any_target,
  max(case when place is not null then gid end) as any_id, max(place) as any_place from places group by sequence),
annotated as (select e.sample, e.sequence, e.abundance, e.n0, e.n1, e.nunq, e.pval, e.birth_pval, e.birth_ham,
  case when coalesce(h.there, 0) <> 1 and h.n = 1 then h.any_id else xid end as id,
  coalesce(xtarget, case when h.there = 1 then there_target when h.n = 1 then any_target else 'Unknown' end) as target,
  case when coalesce(h.there, 0) <> 1 and h.n = 1 then substr(e.sequence, cast(any_place as integer) + {_A - 1 + _K + 1}, length(e.sequence) - {_A} - (cast(any_place as integer) + {_A - 1 + _K})) else xbarcode end as barcode,
  case when xtarget is not null then 'exact' when h.there = 1 or h.n = 1 then 'salvaged' else 'unknown' end as found
  from exact e left join hits h on h.sequence = e.sequence)"""
_ANNOTATED, _COPIES_ANNOTATED = f"{CLUSTERS}, {_OF_CLUSTERS}", f"{ad.COPIED_CLUSTERS}, {_OF_CLUSTERS}"


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotated(ad.clusters(spark, d), ad.guides(spark, d), ANNOTATE)


@query(f"with {CLUSTERS}, {GUIDES} select sample, sequence, id, target from clusters join guides on id = substr(sequence, {_A + 1}, {_K})")
def sgid_annotate_exact(spark: SparkSession, d: str) -> DataFrame:
    return _annotated(spark, d).where("found = 'exact'").select("sample", "sequence", "id", "target")


@query(f"with {_ANNOTATED} select sample, sequence, id, target, barcode, found from annotated")
def sgid_annotate_salvage(spark: SparkSession, d: str) -> DataFrame:
    return _annotated(spark, d).select("sample", "sequence", "id", "target", "barcode", "found")


@query(f"""with {ad.COPIES}, clusters as (select sample, dna as sequence, count(*) as abundance, 0 as n0, 0 as n1, 0 as nunq, 0 as pval, 0 as birth_pval, 0 as birth_ham from reads where not contains(dna, 'N') group by sample, dna),
{_OF_CLUSTERS} select sample, sequence, abundance, id, target, barcode, found from annotated""")
def derep_annotated(spark: SparkSession, d: str) -> DataFrame:
    exact = rd.dereplicated(ad.copies(spark, d).where(~degenerate(F.col("dna"))))
    return annotate.annotated(exact, ad.guides(spark, d), ANNOTATE)


_FIXED = _COPIES_ANNOTATED.replace(f"length(e.sequence) - {_A} - (cast(any_place as integer) + {_A - 1 + _K})", "16")


@query(f"""with {_FIXED} select sample, target as "RNA", barcode, cast(sum(abundance) as bigint) as abundance, cast(sum(nunq) as bigint) as nunq, cast(sum(n0 + n1) as bigint) as n10
from annotated group by sample, target, barcode""")
def cluster_merge_fixed(spark: SparkSession, d: str) -> DataFrame:
    found = annotate.annotated(ad.clusters(spark, d, molecules=400), ad.guides(spark, d), replace(ANNOTATE, barcode_length=20))
    return annotate.merged_counts(found)


@query(f"""with {_COPIES_ANNOTATED}, ids as (select sample, target, barcode, id, count(*) as k from annotated group by all),
ranked as (select *, row_number() over (partition by sample, target, barcode order by k desc, id) as r from ids)
select s.sample, s.target, s.barcode, max(r.id) as id, cast(sum(abundance) as bigint) as abundance, cast(sum(n0) as bigint) as n0, cast(sum(n1) as bigint) as n1, cast(sum(nunq) as bigint) as nunq,
  case when product(pval) > 0 then round(log10(product(pval)), 6) end as log_pval, case when product(birth_pval) > 0 then round(log10(product(birth_pval)), 6) end as log_birth_pval, min(birth_ham) as birth_ham
from annotated s join ranked r on r.sample = s.sample and r.target = s.target and r.barcode = s.barcode and r.r = 1 group by s.sample, s.target, s.barcode""")
def cluster_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = annotate.merged(annotate.annotated(ad.clusters(spark, d, molecules=400), ad.guides(spark, d), ANNOTATE))
    # products of many probabilities are told apart by their logarithms; that of 0 is null
    logs = [F.round(F.log10(c), 6).alias(f"log_{c}") for c in ("pval", "birth_pval")]
    return merged.select(*[c for c in merged.columns if "pval" not in c], *logs)


_SHARES = ", ".join(f"round(avg(cast(found = '{k}' as integer)), 9) as {k}_share, round(sum(case when found = '{k}' then abundance else 0 end) / sum(abundance), 9) as {k}_abundance" for k in ("exact", "salvaged", "unknown"))


@query(f"with {_ANNOTATED} select sample, count(*) as clusters, {_SHARES} from annotated group by sample")
def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("exact", "salvaged", "unknown")
    return rounded(annotate.annotation_summary(_annotated(spark, d)), *[f"{k}_{c}" for k in kinds for c in ("share", "abundance")], digits=9)


@query(f"with {CLUSTERS} select sample, round(max(abundance) / sum(abundance), 9) as share from clusters group by sample")
def largest_cluster_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(denoise.largest_shares(ad.clusters(spark, d)), "share", digits=9)


# ---- quantification

_RESIDUALS = f"""{COMBINED}, y as materialized (select *, length(regexp_replace(id || barcode, '[^GC]', '', 'g')) as gcs, ln(cast(n0 + n1 as double)) as y from combined),
residuals as materialized (select *, y - avg(y) over (partition by sample, target) as residual from y)"""
_FIT = f"""{_RESIDUALS}, ranked as materialized (select gcs, residual, row_number() over (partition by gcs order by residual) as r, count(*) over (partition by gcs) as n from residuals),
points as materialized (select gcs, avg(residual) as trimmed, max(n) as n from ranked where r > floor(0.01 * n) and r <= n - floor(0.01 * n) group by gcs),
sums as (select sum(n) as w, sum(n * gcs) as wx, sum(n * trimmed) as wy, sum(n * gcs * gcs) as wxx, sum(n * gcs * trimmed) as wxy from points),
fit as materialized (select (wxy * w - wx * wy) / (wxx * w - wx * wx) as slope, (wy - (wxy * w - wx * wy) / (wxx * w - wx * wx) * wx) / w as intercept from sums)"""
_CORRECTED = f"{_FIT}, corrected as materialized (select r.*, exp(y - (select intercept from fit) - (select slope from fit) * gcs) as gc_corrected from residuals r)"
_SPIKES = f"""{_CORRECTED}, spike_sums as (select barcode, sum(gc_corrected) as s from corrected where target = '{SPIKE_BRAND}' group by barcode),
spikes as materialized (select barcode, s / whole as share from spike_sums, (select sum(s) as whole from spike_sums) where s / whole > {QUANTIFY.spike_share})"""
_CELLS = f"""{_SPIKES}, scales as (select sample, {QUANTIFY.spike_cells} / avg(gc_corrected) as scale from corrected where target = '{SPIKE_BRAND}' and barcode in (select barcode from spikes) group by sample),
cells as (select c.*, gc_corrected * scale as cells, case when abundance - n1 - n0 = 0 then case when n0 = 0 then cast('nan' as double) else cast('infinity' as double) end else cast(n0 as double) / (abundance - n1 - n0) end as concentration
  from corrected c left join scales using (sample)),
final as (select *, coalesce((concentration >= 1 and cells >= 500) or cells >= 5000, false) as pass_filter from cells),
marked as (select *, target = '{SPIKE_BRAND}' and pass_filter and barcode not in (select barcode from spikes) as false_positive from final)"""


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    return quantify.gc_residuals(ad.combined(spark, d), QUANTIFY)


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    r = _residuals(spark, d)
    return quantify.gc_corrected(r, quantify.gc_fit(r, QUANTIFY)[0])


@query(f"with {_RESIDUALS} select sample, target, barcode, gcs, round(residual, 6) as residual from residuals".replace("gcs, round", "cast(gcs as integer) as gcs, round"))
def gc_residual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_residuals(spark, d), "residual").select("sample", "target", "barcode", "gcs", "residual")


@query(f"with {_FIT} select cast(gcs as integer) as gcs, round(trimmed, 6) as trimmed, n from points")
def trimmed_mean_by_gc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.trimmed_means(_residuals(spark, d), "gcs", "residual", 0.01), "trimmed")


@query(f"with {_CORRECTED} select sample, target, barcode, round(gc_corrected, 5) as gc_corrected from corrected")
def gc_fit_order1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_corrected(spark, d), "gc_corrected", digits=5).select("sample", "target", "barcode", "gc_corrected")


def _search_sql(orders: tuple[int, ...] = (2, 3, 4, 5, 6)) -> str:
    """Weighted fits of all orders by orthogonal polynomials: each has its sums over the points, of which there is one for each GC count."""
    steps, most = [f"{_FIT}, t0 as materialized (select gcs, cast(gcs as double) as x, trimmed as y, cast(n as double) as w, cast(1 as double) as p0 from points)"], max(orders)
    for k in range(most + 1):
        steps.append(f"n{k} as materialized (select sum(w * p{k} * p{k}) as d, sum(w * x * p{k} * p{k}) / sum(w * p{k} * p{k}) as a, sum(w * y * p{k}) / sum(w * p{k} * p{k}) as c from t{k})")
        if k < most:
            less = f" - (select d from n{k}) / (select d from n{k - 1}) * p{k - 1}" if k else ""
            steps.append(f"t{k + 1} as materialized (select *, (x - (select a from n{k})) * p{k}{less} as p{k + 1} from t{k})")
    fitted = {k: " + ".join(f"(select c from n{j}) * p{j}" for j in range(k + 1)) for k in orders}
    whole = f"(select sum(w * (y - (select c from n0)) * (y - (select c from n0))) from t{most})"
    steps.append("tried as materialized (" + " union all ".join(f"select {k} as k, 1 - (select sum(w * (y - ({fitted[k]})) * (y - ({fitted[k]}))) from t{most}) / {whole} * ((select count(*) from t{most}) - 1) / ((select count(*) from t{most}) - {k} - 1) as r2" for k in orders) + ")")
    steps.append("best as materialized (select k from tried order by r2 desc, k limit 1)")
    return f"with {', '.join(steps)} select cast(gcs as integer) as gcs, (select k from best) as \"order\", round(case (select k from best) {' '.join(f'when {k} then {fitted[k]}' for k in orders)} end, 6) as fitted from t{most}"


@query(_search_sql())
def gc_fit_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.gc_fitted(_residuals(spark, d), QUANTIFY), "fitted")


@query(f"with {_SPIKES} select barcode, round(share, 7) as share from spikes")
def spike_infer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.spikes(_corrected(spark, d), QUANTIFY), "share", digits=7)


@query(f"with {_CELLS} select sample, target, barcode, round(cells, 2) as cells, round(case when isfinite(concentration) then concentration end, 6) as concentration, pass_filter, false_positive from marked")
def spike_scale_cells(spark: SparkSession, d: str) -> DataFrame:
    out = quantify.quantified(ad.combined(spark, d), QUANTIFY)
    finite = F.when(F.abs("concentration") < float("inf"), F.col("concentration"))
    return out.select("sample", "target", "barcode", F.round("cells", 2).alias("cells"), F.round(finite, 6).alias("concentration"), "pass_filter", "false_positive")


@query(f"with {_CELLS} select cast(count(*) filter (pass_filter) as bigint) as passed, cast(count(*) filter (false_positive) as bigint) as false_positives, round(count(*) filter (false_positive) / nullif(count(*) filter (pass_filter), 0), 9) as fdr from marked")
def final_filter_fdr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.false_discovery(quantify.quantified(ad.combined(spark, d), QUANTIFY)), "fdr", digits=9)


# ---- errors

_REF = f"translate(md5('reference'), '{ad.HEX}', '{ad.BASES}')"
_TALLIES = f"""{READS}, tallies as (select sample, substr({_REF}, cast(r.i as integer), 1) || '2' || substr(dna, cast(r.i as integer), 1) as mutation, cast(ascii(substr(qc, cast(r.i as integer), 1)) - 33 as integer) as phred, count(*) as n
  from reads, range(1, 33) r(i) where substr(dna, cast(r.i as integer), 1) <> 'N' group by all)"""


def _tallies(spark: SparkSession, d: str, by_sample: bool = True) -> DataFrame:
    return denoise.transitions(ad.reads(spark, d), hashlib.md5(b"reference").hexdigest().translate(str.maketrans(ad.HEX, ad.BASES)), by_sample)


@query(f"with {_TALLIES} select sample, mutation, phred, n from tallies")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tallies(spark, d)


_ERRORS = f"""{_TALLIES}, rates as (select sample, phred, cast(sum(n) as bigint) as n, 1 - sum(case when mutation[1] = mutation[3] then n else 0 end) / sum(n) as error from tallies group by all)"""


@query(f"with {_ERRORS} select sample, phred, n, round(error, 9) as error from rates")
def error_rate_by_phred(spark: SparkSession, d: str) -> DataFrame:
    return rounded(denoise.error_rates(_tallies(spark, d)), "error", digits=9)


@query(f"with {_ERRORS} select sample, round(sum((error - pow(10.0, -phred / 10.0)) * n) / sum(n), 9) as excess from rates group by sample")
def error_excess(spark: SparkSession, d: str) -> DataFrame:
    return rounded(denoise.error_excess(denoise.error_rates(_tallies(spark, d))), "excess", digits=9)


@query(f"""with {_TALLIES}, totals as (select mutation[1] as base, phred, sum(n) as total from tallies group by all), each as (select mutation, phred, sum(n) as n from tallies where mutation[1] <> mutation[3] group by all)
select mutation, round(sum((n / total - pow(10.0, -e.phred / 10.0) / 3) * total) / sum(total), 9) as excess from each e join totals t on t.base = e.mutation[1] and t.phred = e.phred group by mutation""")
def mutation_excess(spark: SparkSession, d: str) -> DataFrame:
    return rounded(denoise.mutation_excess(_tallies(spark, d, by_sample=False)), "excess", digits=9)


@query(f"""with {_TALLIES} select cast((phred >= 10)::int + (phred >= 20)::int + (phred >= 25)::int + (phred >= 30)::int + (phred >= 35)::int as integer) as cohort, cast(sum(n) as bigint) as n,
  round(1 - sum(case when mutation[1] = mutation[3] then n else 0 end) / sum(n), 9) as error from tallies group by 1""")
def error_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(denoise.cohort_errors(_tallies(spark, d, by_sample=False)), "error", digits=9)


@query(f"with {_TALLIES} select mutation, {', '.join(f'cast(coalesce(sum(case when phred = {p} then n end), 0) as bigint) as \"{p}\"' for p in range(41))} from tallies group by mutation")
def transition_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    return transition_matrix(_tallies(spark, d, by_sample=False), 40)


_REFERENCED = f"""{ad.REFERENCED}, tallies as (select substr(reference, cast(r.i as integer), 1) || '2' || substr(dna, cast(r.i as integer), 1) as mutation, cast(ascii(substr(qc, cast(r.i as integer), 1)) - 33 as integer) as phred, count(*) as n
  from reads, range(1, 33) r(i) group by all)"""
_BASE = "(values ('A'), ('C'), ('G'), ('T'))"
_LOESS = f"""{_REFERENCED}, grid as materialized (
  select m.mutation, p.phred, coalesce(c.n, 0) as n, cast(sum(coalesce(c.n, 0)) over (partition by m.mutation[1], p.phred) as double) as total
  from (select a || '2' || b as mutation from {_BASE} t(a), {_BASE} u(b)) m cross join (select unnest(range(0, (select max(phred) + 1 from tallies))) as phred) p left join tallies c on c.mutation = m.mutation and c.phred = p.phred),
points as materialized (select mutation, cast(phred as double) as x, log10((n + 1) / total) as y, total as w from grid where mutation[1] <> mutation[3] and total > 0),
ends as (select mutation, min(x) as f, max(x) as l, cast(greatest(1, floor(count(*) * 0.75 + 1e-5)) as integer) as k from points group by mutation),
spread as materialized (select g.mutation, g.phred, k, p.x - least(greatest(cast(g.phred as double), f), l) as u, p.y, p.w from grid g join ends e on e.mutation = g.mutation join points p on p.mutation = g.mutation),
reach as (select mutation, phred, list_sort(list(abs(u)))[max(k)] as h from spread group by all),
weighed as (select s.mutation, s.phred, u, y, w * case when h > 0 then pow(1 - pow(least(abs(u) / h, 1.0), 3), 3) else cast(u = 0 as integer) end as v from spread s join reach r on r.mutation = s.mutation and r.phred = s.phred),
sums as (select mutation, phred, {', '.join(f'sum(v * pow(u, {k})) as s{k}' for k in range(5))}, {', '.join(f'sum(v * pow(u, {k}) * y) as t{k}' for k in range(3))} from weighed group by all),
wrong as materialized (select s.mutation, s.phred, g.n, least(greatest(pow(10.0, {errormodel.QUADRATIC}), {errormodel.LEAST_RATE}), {errormodel.MOST_RATE}) as rate from sums s join grid g on g.mutation = s.mutation and g.phred = s.phred),
model as materialized (select mutation, phred, n, rate from wrong
  union all select g.mutation, g.phred, g.n, 1 - (select sum(rate) from wrong w where w.mutation[1] = g.mutation[1] and w.phred = g.phred) as rate from grid g where g.mutation[1] = g.mutation[3])"""


def _model(spark: SparkSession, d: str) -> DataFrame:
    return errormodel.loess_rates(denoise.transitions(ad.referenced(spark, d), F.col("reference"), by_sample=False))


@query(f"with {_LOESS} select mutation, phred, n, round(rate, 9) as rate from model")
def loess_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_model(spark, d), "rate", digits=9)


@query(f"""with {_LOESS} select cast((phred >= 10)::int + (phred >= 20)::int + (phred >= 25)::int + (phred >= 30)::int + (phred >= 35)::int as integer) as cohort, min(phred) as low, cast(sum(n) as bigint) as n,
  round(sum(case when mutation[1] <> mutation[3] then n else 0 end) / nullif(sum(n), 0), 9) as error, round(1 - avg(case when mutation[1] = mutation[3] then rate end), 9) as smoothed from model group by 1""")
def loess_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(errormodel.cohort_rates(_model(spark, d)), "error", "smoothed", digits=9)


@query()
def trained_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Training reads are those of one molecule a sample."""
    reads = rd.mean_qualities(rd.without_degenerate(ad.amplified(spark, d, molecules=1)))
    return errormodel.trained(reads)[0]


@query()
def divided_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of whole reads of many molecules a sample under the rates that the training reads show."""
    reads = rd.mean_qualities(rd.without_degenerate(ad.amplified(spark, d)))
    model = errormodel.rates_of(trained_error_rates(spark, d))
    return errormodel.clusters(reads, model)


# ---- kernels, tested against plain versions

TEMPLATE = Template("ACGTTGCA" + "N" * 29 + "CATGGACT", flank=8)
STRICT = Scoring(mismatch=-1)


def _amplicons(spark: SparkSession, d: str) -> DataFrame:
    """Reads with the template's flanks around a barcode of their own, some of them with substitutions or short."""
    r, k = ad.reads(spark, d), F.col("read_id")
    whole = F.concat(F.lit("ACGTTGCA"), F.substring("dna", 1, TEMPLATE.barcode_length), F.lit("CATGGACT"))
    changed = F.when(k % 11 == 0, F.concat(F.substring(whole, 1, 2), F.lit("T"), F.substring(whole, 4, len(TEMPLATE.full)))).when(k % 13 == 0, F.substring(whole, 4, len(TEMPLATE.full))).when(k % 17 == 0, F.col("dna")).otherwise(whole)
    return r.withColumn("dna", changed).withColumn("qc", F.substring(F.repeat("qc", 2), F.lit(1), F.length("dna")))


@query()
def sw_align(spark: SparkSession, d: str) -> DataFrame:
    return align.align_reads(_amplicons(spark, d), TEMPLATE.reference, STRICT).withColumn("mapq", align.mapping_quality(F.col("score"), F.col("score2")))


#: The sets of bases that ambiguity codes stand for.
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def ambiguity_letters(match: int = 4, mismatch: int = -4) -> Letters:
    """Scores by the share of base pairs of two codes that are alike; N neither helps nor harms."""
    share = lambda a, b: 0.5 if "N" in (a, b) else len(set(AMBIGUOUS[a]) & set(AMBIGUOUS[b])) / (len(AMBIGUOUS[a]) * len(AMBIGUOUS[b]))
    return Letters([*AMBIGUOUS], [[round(share(a, b) * match + (1 - share(a, b)) * mismatch) for b in AMBIGUOUS] for a in AMBIGUOUS])


@query()
def align_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Reads against a reference with codes for several bases."""
    return align.align_by_matrix(_amplicons(spark, d), "ACGTYGCA" + "W" * 4 + "N" * 21 + "S" * 4 + "CATGRACT", ambiguity_letters(), Scoring(gap_open=6, gap_extend=1), least=24)


@query()
def classify_reads(spark: SparkSession, d: str) -> DataFrame:
    how = Classify(training_flank=6, cluster_flank=6)
    return align.classified(_amplicons(spark, d), TEMPLATE, how, STRICT).select("sample", "read_id", "score", "outcome", "training", "cluster")


@query()
def read_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return align.outcomes(classify_reads(spark, d))


@query()
def denoise_clusters(spark: SparkSession, d: str) -> DataFrame:
    return denoise.clustered(rd.dereplicated(rd.without_degenerate(ad.amplified(spark, d))), error=0.01)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    t = ad.tumors(spark, d)
    return resample.intervals(resample.bootstrap_ln_means(t, 500), tumors.ln_means(t))


@query()
def inert_p_values(spark: SparkSession, d: str) -> DataFrame:
    return resample.inert_p_values(ad.tumors(spark, d), INERT_BRANDS, 300)


@query()
def ln_mean_summary(spark: SparkSession, d: str) -> DataFrame:
    return resample.ln_mean_summary(ad.tumors(spark, d), INERT_BRANDS, replicates=300)


@query()
def percentile_table(spark: SparkSession, d: str) -> DataFrame:
    return resample.percentile_table(ad.tumors(spark, d), INERT_BRANDS)


@query()
def bootstrap_within_samples(spark: SparkSession, d: str) -> DataFrame:
    t = ad.tumors(spark, d)
    return resample.intervals(resample.ln_means_of(resample.level_sums(t, ["target"], ["sample"], 200)), tumors.ln_means(t))


_LARGE = 80_000


@query(f"""with recursive {TUMORS}, sized as materialized (
  select sample, target, count(*) as n, list(ln(cells) order by cells) as ys from tumors where cells > {_LARGE} group by all having count(*) <= 5),
picks(n, p) as (
  select n, [i] from (select distinct n from sized), range(1, 6) r(i) where i <= n
  union all select n, list_append(p, j) from picks, range(1, 6) r(j) where len(p) < n and j >= p[len(p)] and j <= n),
drawn as (select sample, target, ys, list_transform(p, lambda i: ys[i]) as y from sized s join picks k on k.n = s.n where len(p) = k.n),
boots as (select sample, target, exp(list_avg(y) + greatest(0, list_avg(list_transform(y, lambda v: v * v)) - list_avg(y) * list_avg(y)) / 2) as b,
  exp(list_avg(ys) + greatest(0, list_avg(list_transform(ys, lambda v: v * v)) - list_avg(ys) * list_avg(ys)) / 2) as ln_mean from drawn)
select sample, target, count(*) as multisets, round(max(ln_mean), 4) as ln_mean, round(quantile_cont(b, 0.025), 4) as low, round(quantile_cont(b, 0.975), 4) as high from boots group by all""")
def enumerated_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Of the large tumours of a sample and target, where they are few."""
    boot = resample.enumerated(ad.tumors(spark, d).where(F.col("cells") > _LARGE), ("sample", "target"), most=5)
    return rounded(resample.enumerated_intervals(boot, ("sample", "target")), "ln_mean", "low", "high", digits=4)


@query()
def power_analysis(spark: SparkSession, d: str) -> DataFrame:
    return resample.power(ad.tumors(spark, d), [10, 50], inerts=INERT_BRANDS)


@query()
def outlier_mice(spark: SparkSession, d: str) -> DataFrame:
    return resample.outlier_mice(ad.tumors(spark, d), 200)


@query()
def contamination(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.contaminated_pairs(ad.contaminated(spark, d), 1000.0, alpha=0.01)


@query()
def contamination_mixture(spark: SparkSession, d: str) -> DataFrame:
    """For the pairs of samples that share more large barcodes than chance brings."""
    t = ad.contaminated(spark, d, share=10).groupBy("sample", "target", "barcode").agg(F.sum("cells").alias("cells"))
    return cohorts.ratio_mixtures(cohorts.size_ratios(t, cohorts.contaminated_pairs(t, 1000.0, alpha=0.01)))


@query()
def library_diversity(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.diversity(ad.tumors(spark, d))


@query()
def power_law_fit(spark: SparkSession, d: str) -> DataFrame:
    return fits.power_law_fits(ad.tumors(spark, d))


@query()
def best_distribution(spark: SparkSession, d: str) -> DataFrame:
    return fits.best_families(ad.tumors(spark, d))


@query(f"with {READS} select sample, count(*) as n, cast(count(*) filter (not contains(header, ':Y:')) as bigint) as passed from reads group by sample")
def chastity_tallies(spark: SparkSession, d: str) -> DataFrame:
    return ad.reads(spark, d).groupBy("sample").agg(F.count("*").alias("n"), F.sum(passes_chastity(F.col("header")).cast("long")).alias("passed"))


@query()
def bca_intervals(spark: SparkSession, d: str) -> DataFrame:
    t = ad.tumors(spark, d)
    return resample.bca_intervals(resample.bootstrap_ln_means(t, 500), tumors.ln_means(t), tumors.jackknife_ln_means(t))


@query()
def error_intervals(spark: SparkSession, d: str) -> DataFrame:
    return denoise.error_intervals(_tallies(spark, d, by_sample=False))


@query()
def histogram_intervals(spark: SparkSession, d: str) -> DataFrame:
    return denoise.with_intervals(tumors.log_histogram(ad.tumors(spark, d)))


@query()
def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = rd.without_degenerate(ad.reads(spark, d))
    forward = r.select(F.col("read_id").cast("string").alias("name"), F.substring("dna", 1, 24).alias("dna"), F.substring("qc", 1, 24).alias("qc"))
    reverse = r.select(F.col("read_id").cast("string").alias("name"), reverse_complement(F.substring("dna", 9, 24)).alias("dna"), F.reverse(F.substring("qc", 9, 24)).alias("qc"))
    return pairs.merged_pairs(forward, reverse, least_overlap=12, least_length=30, wrong=0.05)


@query()
def both_strands(spark: SparkSession, d: str) -> DataFrame:
    r = _amplicons(spark, d).select("sample", "read_id", "dna")
    turned = r.withColumn("dna", F.when(F.col("read_id") % 2 == 0, F.col("dna")).otherwise(reverse_complement(F.col("dna"))))
    return align.align_both_strands(turned, TEMPLATE.reference, STRICT)


@query()
def sam_records(spark: SparkSession, d: str) -> DataFrame:
    found = align.align_reads(_amplicons(spark, d), TEMPLATE.reference, STRICT)
    return sam_lines(found.withColumns({"name": F.col("read_id").cast("string"), "reverse": F.lit(False)}), "amplicon")


@query()
def guide_hits(spark: SparkSession, d: str) -> DataFrame:
    known = ad.guides(spark, d).select(F.col("target").alias("name"), F.repeat("id", 3).alias("sequence"))
    return align.best_hits(ad.reads(spark, d), known, most_e=1e-3)


@query()
def target_components(spark: SparkSession, d: str) -> DataFrame:
    names, weights, _ = cohorts.target_components(ad.tumors(spark, d).withColumn("value", F.ln("cells")))
    return spark.createDataFrame(list(zip(names, [round(float(w), 6) for w in weights], strict=True)), "target string, weight double")


_P = lambda k: f"nullif(cast(coalesce(list_filter(range(0, {33 - 4}), lambda i: hamming(substr(dna, cast(i as integer) + 1, 4), '{k}') <= 1)[1], -1) as integer), -1)"


@query(f"""with {READS}, placed as (select read_id, coalesce({_P("ACGT")} + 4, {_P("TTGA")} + 8) as start, coalesce({_P("CATG")}, {_P("GGAC")} - 4) as stop from reads)
select read_id, cast(case when abs(start - 8) <= 4 then start end as integer) as start, cast(case when abs(stop - 16) <= 4 then stop end as integer) as stop from placed""")
def kmer_flanks(spark: SparkSession, d: str) -> DataFrame:
    return rd.between_kmers(ad.reads(spark, d), ("ACGT", "TTGA"), ("CATG", "GGAC"), (8, 16)).select("read_id", "start", "stop")


@query()
def template_repair(spark: SparkSession, d: str) -> DataFrame:
    return rd.repaired_by_template(ad.reads(spark, d), "ACGTTGCAGGCTAACCATGGACTTACGATCCGAT").select("read_id", "dna")
