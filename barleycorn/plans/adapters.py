"""The order tables seen as a sequencing experiment.

Each line item is a read: its DNA and qualities are digests of its keys, its supplier is the sample, and its
index bases, guide and barcode are parts of the DNA.  Line items are also tumours: the part's brand is the
target, the part the barcode, the price the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Annotate, Quantify

#: Barcodes of the spike-in, which repeat; other barcodes hardly do.
SPIKE_BARCODES = 150
INERT_BRANDS = tuple(f"Brand#{k}" for k in range(1, 6))
SPIKE_BRAND = "Brand#25"
ANNOTATE = Annotate(flank=6, id_length=4, indel=1, substitutions=1)
#: Cells of the spike-in such that others lie on both sides of the final filter's limits.
QUANTIFY = Quantify(spike_cells=2500.0, spike_target=SPIKE_BRAND, spike_share=0.005, metric="n0 + n1", order=1)

HEX, BASES, PHRED = "0123456789abcdef", "ACGTACGTACGTACGT", "!#%)+-/1357:=@DI"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(*columns: str):
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, read_id, header, dna, qc; the third line of an order has an N, returned lines failed the filter."""
    return _reads(spark, sf_dir, F.translate(_digest("l_orderkey", "l_linenumber"), HEX, BASES))


def amplified(spark: SparkSession, sf_dir: str, molecules: int = 40, wrong: int = 100) -> DataFrame:
    """reads() of molecules that are read more than once: the DNA is a digest of the sample and the part's number modulo molecules, and one base in wrong of a read is another one."""
    molecule = F.translate(F.md5(F.concat_ws("-", F.col("l_suppkey").cast("string"), (F.col("l_partkey") % molecules).cast("string")).cast("binary")), HEX, BASES)
    hit = lambda i: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", i), F.lit(wrong)) == 0
    copied = F.transform(F.filter(F.split(molecule, ""), lambda c: c != ""), lambda c, i: F.when(hit(i), F.translate(c, "ACGT", "CGTA")).otherwise(c))
    return _reads(spark, sf_dir, F.array_join(copied, ""))


def _reads(spark: SparkSession, sf_dir: str, dna: Column) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    masked = F.when(F.col("l_linenumber") == 3, F.concat(F.substring("d", 1, 10), F.lit("N"), F.substring("d", 12, 21))).otherwise(F.col("d"))
    flag = F.when(F.col("l_returnflag") == "R", "Y").otherwise("N")
    header = F.concat(F.lit("@M:1:FC:"), F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_orderkey").cast("string"), F.lit(" 1:"), flag, F.lit(":0:"), F.col("l_linenumber").cast("string"))
    return rows.withColumn("d", dna).select(
        F.col("l_suppkey").cast("string").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), header.alias("header"), masked.alias("dna"),
        F.translate(_digest("l_linenumber", "l_orderkey"), HEX, PHRED).alias("qc"),
    )


READS = f"""reads as (
  select sample, read_id, header, case when n = 3 then substr(d, 1, 10) || 'N' || substr(d, 12, 21) else d end as dna, qc from (
    select cast(l_suppkey as varchar) as sample, l_orderkey * 10 + l_linenumber as read_id, l_linenumber as n,
      '@M:1:FC:' || l_suppkey || ':' || l_orderkey || ' 1:' || case when l_returnflag = 'R' then 'Y' else 'N' end || ':0:' || l_linenumber as header,
      translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{BASES}') as d,
      translate(md5(l_linenumber || '-' || l_orderkey), '{HEX}', '{PHRED}') as qc
    from lineitem))"""


def copied(molecules: int) -> Column:
    """The DNA of one of so many molecules, by the part's number; in a tenth of the reads one base, anywhere, is another one."""
    m = F.translate(F.md5((F.col("l_partkey") % molecules).cast("string").cast("binary")), HEX, BASES)
    place = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 320).cast("int")
    changed = F.concat(F.substring(m, F.lit(1), place), F.translate(F.substring(m, place + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(m, place + 2, F.lit(32)))
    return F.when(place < 32, changed).otherwise(m)


def _copied_sql(molecules: int) -> str:
    m, place = f"translate(md5(cast(l_partkey % {molecules} as varchar)), '{HEX}', '{BASES}')", "cast((l_orderkey * 7 + l_linenumber) % 320 as integer)"
    return f"case when {place} < 32 then substr({m}, 1, {place}) || translate(substr({m}, {place} + 1, 1), 'ACGT', 'CGTA') || substr({m}, {place} + 2, 32) else {m} end"


def copies(spark: SparkSession, sf_dir: str, molecules: int = 40) -> DataFrame:
    """reads() of few molecules, each read many times over whole, as copied() has them."""
    return _reads(spark, sf_dir, copied(molecules))


def referenced(spark: SparkSession, sf_dir: str, molecules: int = 40) -> DataFrame:
    """sample, reference, dna, qc: copies() with the molecule that each is a read of."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3")
    reference = F.translate(F.md5((F.col("l_partkey") % molecules).cast("string").cast("binary")), HEX, BASES)
    return rows.select(F.col("l_suppkey").cast("string").alias("sample"), reference.alias("reference"), copied(molecules).alias("dna"), F.translate(_digest("l_linenumber", "l_orderkey"), HEX, PHRED).alias("qc"))


REFERENCED = f"""reads as (
  select cast(l_suppkey as varchar) as sample, translate(md5(cast(l_partkey % 40 as varchar)), '{HEX}', '{BASES}') as reference, {_copied_sql(40)} as dna, translate(md5(l_linenumber || '-' || l_orderkey), '{HEX}', '{PHRED}') as qc
  from lineitem where l_linenumber <> 3)"""


COPIES = READS.replace(f"translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{BASES}')", _copied_sql(40))


def tumors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, target, barcode, cells."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_suppkey").cast("string").alias("sample"), F.col("p_brand").alias("target"), F.col("l_partkey").cast("string").alias("barcode"), F.col("l_extendedprice").alias("cells")
    )


TUMORS = """tumors as (
  select cast(l_suppkey as varchar) as sample, p_brand as target, cast(l_partkey as varchar) as barcode, l_extendedprice as cells
  from lineitem join part on l_partkey = p_partkey)"""


def contaminated(spark: SparkSession, sf_dir: str, every: int = 25, share: int = 100) -> DataFrame:
    """tumors(), and one in share cells of each tumour of one sample in every once more in the next sample."""
    own = tumors(spark, sf_dir)
    number = F.col("sample").cast("long")
    return own.unionByName(own.where(number % every == 0).withColumns({"sample": (number + 1).cast("string"), "cells": F.col("cells") / share}))


CONTAMINATED = f"""{TUMORS}, contaminated as (
  select * from tumors union all select cast(cast(sample as bigint) + 1 as varchar) as sample, target, barcode, cells / 100 as cells from tumors where cast(sample as bigint) % 25 = 0)"""


def clusters(spark: SparkSession, sf_dir: str, molecules: int = 0) -> DataFrame:
    """A cluster for each read without N; with molecules, for each of copies()."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3")
    dna = copied(molecules) if molecules else F.translate(_digest("l_orderkey", "l_linenumber"), HEX, BASES)
    n0, n1 = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return items.select(
        F.col("l_suppkey").cast("string").alias("sample"), dna.alias("sequence"), (n0 + n1 + F.col("l_suppkey") % 3).alias("abundance"), n0.alias("n0"), n1.alias("n1"),
        (n1 % 4 + 1).alias("nunq"), F.col("l_discount").alias("pval"), F.col("l_tax").alias("birth_pval"), F.col("l_linenumber").alias("birth_ham"),
    )


CLUSTERS = f"""clusters as (
  select cast(l_suppkey as varchar) as sample, translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{BASES}') as sequence,
    cast(l_quantity as bigint) + l_linenumber + l_suppkey % 3 as abundance, cast(l_quantity as bigint) as n0, cast(l_linenumber as bigint) as n1,
    cast(l_linenumber % 4 + 1 as bigint) as nunq, l_discount as pval, l_tax as birth_pval, l_linenumber as birth_ham
  from lineitem where l_linenumber <> 3)"""


COPIED_CLUSTERS = CLUSTERS.replace(f"translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{BASES}')", _copied_sql(400))


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, target: a guide for each nation, the first of those with one id."""
    nations = table(spark, sf_dir, "nation").select(F.substring(F.translate(_digest("n_nationkey"), HEX, BASES), 1, ANNOTATE.id_length).alias("id"), F.col("n_name").alias("target"))
    return nations.groupBy("id").agg(F.min("target").alias("target"))


GUIDES = f"""guides as (
  select id, min(n_name) as target from (select substr(translate(md5(cast(n_nationkey as varchar)), '{HEX}', '{BASES}'), 1, {ANNOTATE.id_length}) as id, n_name from nation) group by id)"""


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the brand as target and parts of the sequence as id and barcode; spike-ins have one of SPIKE_BARCODES."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    dna = F.translate(_digest("l_orderkey", "l_linenumber"), HEX, BASES)
    n0, n1 = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    spiked = F.concat(F.lit("S"), (F.col("l_orderkey") % SPIKE_BARCODES).cast("string"))
    barcode = F.when(F.col("p_brand") == SPIKE_BRAND, spiked).otherwise(F.concat(F.col("l_partkey").cast("string"), F.substring(dna, 9, 12)))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("sample"), F.col("p_brand").alias("target"), F.substring(dna, 1, 8).alias("id"), barcode.alias("barcode"),
        (n0 + n1 + F.col("l_suppkey") % 3).alias("abundance"), n0.alias("n0"), n1.alias("n1"),
    )


COMBINED = f"""combined as (
  select cast(l_suppkey as varchar) as sample, p_brand as target, substr(d, 1, 8) as id, case when p_brand = '{SPIKE_BRAND}' then 'S' || (l_orderkey % {SPIKE_BARCODES}) else l_partkey || substr(d, 9, 12) end as barcode,
    cast(l_quantity as bigint) + l_linenumber + l_suppkey % 3 as abundance, cast(l_quantity as bigint) as n0, cast(l_linenumber as bigint) as n1
  from (select *, translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{BASES}') as d from lineitem) join part on l_partkey = p_partkey)"""


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, p: how far each brand's mean quantity lies from all brands'."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    whole = joined.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"))
    own = joined.groupBy(F.col("p_brand").alias("name")).agg(F.avg("l_quantity").alias("a"), F.count("*").alias("n"))
    z = F.abs(F.col("a") - whole.select("m").scalar()) * F.sqrt("n") / whole.select("d").scalar()
    return own.select("name", F.round(F.exp(-3 * z), 9).alias("p"))


TESTS = """joined as (select p_brand, l_quantity from lineitem join part on l_partkey = p_partkey),
tests as (
  select p_brand as name, round(exp(-3 * abs(avg(l_quantity) - (select avg(l_quantity) from joined)) * sqrt(count(*)) / (select stddev_pop(l_quantity) from joined)), 9) as p
  from joined group by p_brand)"""
