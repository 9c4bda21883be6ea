"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree of domains, languages and sources.  A token budget goes down the tree in proportion to
the nodes' weights.  A node that has fewer tokens than its share takes all it has; its shortage goes to its
siblings in proportion to their weights, and only what a whole family can't take is left to the families
above.  Each leaf then takes a prefix of its documents in a seeded random order, epoch after epoch.

DataFrame expressions only.  Orders are cut into buckets of the random key, so that a leaf with any share of
the corpus is summed by many tasks; what each leaf takes is at last one key to compare with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written


@dataclass(frozen=True)
class Targets:
    """Weights are whole numbers by name, 1 where a name is missing.  budget_percent: of the corpus's tokens; epochs: how often a document may be used."""

    domains: dict = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    sources: dict = field(default_factory=dict)
    budget_percent: int = 80
    epochs: int = 2
    seed: int = 11
    #: A source's domain: d and the number at its end modulo this; sources without one are of domain "other".
    domain_count: int = 4


def weight(name: str, weights: dict) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, value).otherwise(out)
    return out.cast("long")


def leaf_of(how: Targets) -> dict[str, Column]:
    """domain, lang and source; null languages and sources are the empty name."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.when(number == "", "0").otherwise(number).cast("long") % how.domain_count).cast("string")))
    return {"domain": domain, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": F.coalesce(F.col("source").cast("string"), F.lit(""))}


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with budget: each parent's budget (column parent_budget), by weight, within capacity, shortages going to the siblings."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy("fill", name)
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    double = lambda c: F.col(c).cast("double")
    out = children.withColumn("fill", double("capacity") / double("weight"))
    out = out.withColumns({"left": F.col("parent_budget") - F.coalesce(F.sum("capacity").over(so_far), F.lit(0)), "weights": F.sum("weight").over(rest), "nth": F.row_number().over(order)})
    out = out.withColumn("full", double("capacity") * double("weights") <= double("weight") * double("left"))
    out = out.withColumn("first", F.min(F.when(~F.col("full"), F.col("nth"))).over(family))
    at = lambda c: F.max(F.when(F.col("nth") == F.col("first"), F.col(c))).over(family).cast("double")
    part = F.floor(double("weight") * at("left") / at("weights")).cast("long")
    return out.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", part))).drop("fill", "left", "weights", "nth", "full", "first", "parent_budget")


def budgets(leaves: DataFrame, how: Targets) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * how.epochs)
    languages = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * how.budget_percent / 100).cast("long").alias("parent_budget"))
    top = shared_out(domains.withColumn("weight", weight("domain", how.domains)).withColumn("parent_budget", total.scalar()), [], "domain")
    middle = languages.withColumn("weight", weight("lang", how.languages)).join(top.select("domain", F.col("budget").alias("parent_budget")), "domain")
    middle = shared_out(middle, ["domain"], "lang")
    low = leaves.withColumn("weight", weight("source", how.sources)).join(middle.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"])
    return shared_out(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def order_key(how: Targets, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(how.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


LEAF = ["domain", "lang", "source"]


def counted(docs: DataFrame, how: Targets) -> DataFrame:
    """doc_id, its leaf, and n_tokens, the words of its text, of each row."""
    leaf = leaf_of(how)
    return docs.select("doc_id", *[c.alias(k) for k, c in leaf.items()], F.size(words(F.col("text"))).cast("long").alias("n_tokens"))


def used(counts: DataFrame, how: Targets) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, take_tokens, order_key of each use of a document.

    counts: from counted(), read several times.  Whole epochs first; of the last one the documents in the
    order of their keys that begin before the budget ends, the last of which gives only the tokens that fit.
    Rows that repeat a doc_id share its key and are told apart by their tokens.
    """
    leaves = written(budgets(counts.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), how), "budgets")
    wanted = leaves.where("budget > 0").selectExpr(*LEAF, "budget div tokens as whole", "budget % tokens as rest")
    # epochs that are used whole, then the one that is cut
    each = counts.join(wanted, LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.least("whole", F.lit(how.epochs - 1)))))
    keyed = each.withColumn("order_key", order_key(how, F.col("epoch")))
    uncut = keyed.where("epoch < whole").withColumn("take_tokens", F.col("n_tokens"))
    last = keyed.where("epoch = whole").withColumn("bucket", F.substring("order_key", 1, 3))
    sums = last.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).drop("sum")
    # buckets that begin after the budget's end need no look at their documents
    inside = last.join(sums, [*LEAF, "bucket"]).where(F.col("before") < F.col("rest"))
    within = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("order_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    cut = inside.withColumn("start", F.col("before") + F.coalesce(within, F.lit(0))).where(F.col("start") < F.col("rest"))
    cut = cut.withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start")))
    columns = ["doc_id", *LEAF, "epoch", "n_tokens", "take_tokens", "order_key"]
    return uncut.select(*columns).unionByName(cut.select(*columns))


def mixed(docs: DataFrame, how: Targets = Targets()) -> DataFrame:
    """Each use of a document: doc_id, domain, lang, source, epoch, n_tokens, take_tokens.

    docs: doc_id, text, lang, source; other columns are ignored.  Texts without words take no tokens and come
    with the prefix they lie in; a leaf without tokens takes nothing.  An empty table gives no rows.
    """
    return used(written(counted(docs, how), "counts"), how).drop("order_key")


def selected(docs: DataFrame, how: Targets = Targets(epochs=1)) -> DataFrame:
    """The rows of docs that a mix of one epoch uses, whole and with all their columns; texts aren't shuffled."""
    last = F.struct("order_key", "n_tokens")
    takes = used(written(counted(docs, how), "counts"), how)
    ends = written(takes.groupBy(*LEAF).agg(F.max(last).alias("__end")), "ends")
    leaf = {f"__{k}": c for k, c in leaf_of(how).items()}
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in LEAF], "__end")
    keyed = docs.withColumns(leaf | {"__at": F.struct(order_key(how, F.lit(0)), F.size(words(F.col("text"))).cast("long"))})
    return keyed.join(ends, [f"__{k}" for k in LEAF]).where(F.col("__at") <= F.col("__end")).select(*[docs[c] for c in docs.columns])


def sql(how: Targets = Targets()) -> str:
    """DuckDB SQL for mixed() over the table documents."""

    def cases(column: str, weights: dict) -> str:
        return f"cast(case {' '.join(f"when {column} = '{k}' then {v}" for k, v in weights.items())} else 1 end as bigint)" if weights else "cast(1 as bigint)"

    def level(source: str, parent: str, name: str, out: str) -> str:
        family = f"partition by {parent}"
        return f"""
{out}_1 as (select *, cast(capacity as double) / weight as fill from {source}),
{out}_2 as (select *, parent_budget - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as rem,
  sum(weight) over (w rows between current row and unbounded following) as weights, row_number() over w as nth
  from {out}_1 window w as ({family} order by fill, {name})),
{out}_3 as (select *, cast(capacity as double) * cast(weights as double) <= cast(weight as double) * cast(rem as double) as filled from {out}_2),
{out}_4 as (select *, min(case when not filled then nth end) over ({family}) as first from {out}_3),
{out}_5 as (select *, max(case when nth = first then rem end) over ({family}) as rem_first, max(case when nth = first then weights end) over ({family}) as weights_first from {out}_4),
{out} as (select * exclude (parent_budget), case when filled then capacity else least(capacity, cast(floor(cast(weight as double) * cast(rem_first as double) / cast(weights_first as double)) as bigint)) end as budget from {out}_5)"""

    return f"""
with counts as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
      else 'd' || (cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % {how.domain_count}) end as domain,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as n_tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) as bigint) * {how.epochs} as capacity from counts group by all),
languages as (select domain, lang, cast(sum(capacity) as bigint) as capacity from leaves group by all),
domains as (select domain, cast(sum(capacity) as bigint) as capacity from leaves group by all),
top_in as (select *, {cases("domain", how.domains)} as weight, (select cast(floor(sum(tokens) * {how.budget_percent} / 100) as bigint) from leaves) as parent_budget from domains),
{level("top_in", "1", "domain", "top")},
middle_in as (select l.*, {cases("lang", how.languages)} as weight, t.budget as parent_budget from languages l join top t using (domain)),
{level("middle_in", "domain", "lang", "middle")},
low_in as (select l.*, {cases("source", how.sources)} as weight, m.budget as parent_budget from leaves l join middle m using (domain, lang)),
{level("low_in", "domain, lang", "source", "low")},
wanted as (select domain, lang, source, budget // tokens as whole, budget % tokens as rest from low where budget > 0),
keyed as (
  select c.*, w.whole, w.rest, e.epoch, md5('{how.seed}:' || e.epoch || ':' || coalesce(cast(doc_id as varchar), '')) as order_key
  from counts c join wanted w using (domain, lang, source) join (select unnest(range({how.epochs})) as epoch) e on e.epoch <= w.whole),
placed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by order_key, n_tokens rows between unbounded preceding and 1 preceding), 0) as start from keyed)
select doc_id, domain, lang, source, epoch, n_tokens, cast(case when epoch < whole then n_tokens else least(n_tokens, rest - start) end as bigint) as take_tokens
from placed where epoch < whole or start < rest"""
