"""URL filter: explicit rules, then a tree of path templates per host.

Segments that look like identifiers become wildcards by their form. Templates are
then aggregated per host, and a tree is built level by level, down to the deepest
path. Of a node's branches those with enough labelled pages stay apart if their
share of bad pages differs significantly from that of their siblings (a chi-squared
test), else they are similar and merge into one wildcard branch. Branches with too
few labelled pages to tell back off to the node: they end there. A node's purity is
its share of bad pages smoothed by its parent's, from the host's down; a template
is rejected if its bad share is high.

DataFrame operations only. What the levels work on are templates, not pages;
pages are read once to aggregate and once to be judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

#: Rules host/path with their verdicts; a rule also fits all subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Chi-squared statistic (one degree of freedom, 1%) from which a branch stays apart, and labelled pages that it, and its siblings, need.
CHI2 = 6.635
SUPPORT = 5
#: A template is rejected from this smoothed bad share on; the share above a node counts as so many labelled pages.
REJECT = 0.6
PRIOR = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Forms of variable segments and their wildcards, the first that fits.
FORMS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+\.[A-Za-z]{1,5}$", "{n.x}"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^[0-9a-fA-F]{8,}$", "{hex}"),
    (r"[0-9]", "{id}"),
    (r"^.{41,}$", "{long}"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""

    def form(s: Column) -> Column:
        out = s
        for pattern, name in reversed(FORMS):
            out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(parts, form))


def smoothed(bad: Column, labelled: Column, above: Column, prior: int) -> Column:
    return (bad.cast("double") + F.lit(float(prior)) * above) / (labelled.cast("double") + F.lit(float(prior)))


def template_tree(leaves: DataFrame, chi2: float = CHI2, support: int = SUPPORT, prior: int = PRIOR) -> DataFrame:
    """leaves (host, t array<string>, labelled, bad) -> with template, the leaf's path in the merged tree, and bad_share, that of the template.

    A template that ends in /** has the share of the node before.
    """
    lab, bads, levels = leaves.agg(F.sum("labelled"), F.sum("bad"), F.max(F.size("t"))).first()
    rate = F.lit(float(bads / lab) if lab else 0.0)
    hosts = leaves.groupBy(F.col("host").alias("of")).agg(smoothed(F.sum("bad"), F.sum("labelled"), rate, prior).alias("bad_share"))
    now = written(leaves.join(hosts, F.col("host") == F.col("of")).select("host", "t", "labelled", "bad", F.lit("").alias("template"), "bad_share", (F.size("t") > 0).alias("open")), "tree")
    for level in range(levels or 0):
        if not now.where("open").limit(1).count():
            break
        now = now.withColumn("seg", F.when(F.col("open"), F.get("t", F.lit(level))))
        children = now.where("open").groupBy("host", "template", "seg").agg(F.sum("labelled").alias("lab"), F.sum("bad").alias("bad_"), F.first("bad_share").alias("above"))
        parents = children.groupBy("host", "template").agg(F.sum("lab").alias("all"), F.sum("bad_").alias("all_bad"), F.count("*").alias("branches"))
        a, b = F.col("bad_").cast("double"), (F.col("lab") - F.col("bad_")).cast("double")
        c, d = (F.col("all_bad") - F.col("bad_")).cast("double"), (F.col("all") - F.col("lab") - F.col("all_bad") + F.col("bad_")).cast("double")
        cross = a * d - b * c
        differs = (c + d >= support) & ((a + b + c + d) * cross * cross > F.lit(chi2) * (a + b) * (c + d) * (a + c) * (b + d))
        branch = F.when(F.col("lab") < support, "**").when((F.col("branches") == 1) | differs, F.col("seg")).otherwise("*")
        # written: read for the shares and for the leaves
        decided = written(children.join(parents, ["host", "template"]).select("host", "template", "seg", "lab", "bad_", "above", branch.alias("branch")), "branches")
        share = F.when(F.col("branch") == "**", F.first("above")).otherwise(smoothed(F.sum("bad_"), F.sum("lab"), F.first("above"), prior))
        shares = decided.groupBy("host", "template", "branch").agg(share.alias("share"))
        joined = now.join(decided.select("host", "template", "seg", "branch").join(shares, ["host", "template", "branch"]), ["host", "template", "seg"], "left")
        grown = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch"))
        still = F.col("open") & (F.col("branch") != "**") & (F.size("t") > level + 1)
        now = written(joined.select("host", "t", "labelled", "bad", grown.alias("template"), F.coalesce("share", "bad_share").alias("bad_share"), still.alias("open")), f"tree-{level}")
    return now.drop("open")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = "bad", rules: Sequence[tuple[str, str]] = RULES, reject: float = REJECT, prior: int = PRIOR) -> DataFrame:
    """One row for each row of pages: (id, host, path, rule, verdict, template, bad_share).

    bad_col: true or false for labelled pages, null for others. Without labels, and
    for null urls or such without a host, the method allows, with a null template
    for the latter. A share on the limit is rejected, of two rules that fit the
    longer counts (no two of a length do). Rows are judged by their url alone, so ids
    may be null or repeat; repeated rows count as often as they stand. A long url
    grows its host's tree only as far as there are labels. An empty table gives an
    empty result; other columns aren't read, whatever their names.
    """
    url = F.col(url_col)
    bad = F.col(bad_col).cast("boolean") if bad_col else F.lit(None).cast("boolean")
    source = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), bad.alias("bad"))
    shaped = source.withColumn("t", segments(F.col("path")))
    leaves = written(shaped.where("host <> ''").groupBy("host", "t").agg(F.count("bad").alias("labelled"), F.count_if("bad").alias("bad")), "leaves")
    tree = template_tree(leaves, prior=prior)
    judged = tree.select(F.col("host").alias("of"), F.col("t").alias("t_"), "template", "bad_share")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    joined = shaped.join(judged, (F.col("host") == F.col("of")) & (F.col("t") == F.col("t_")), "left").withColumn("rule", rule)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules:
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    method = F.when(F.col("bad_share") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, method).alias("verdict"), "template", "bad_share")


def oracle(levels: int = 6) -> str:
    """DuckDB SQL for judge_urls over pages labelled by the number in their path, for paths of so many segments."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    form = "case " + " ".join(f"when regexp_matches(x, {text(p)}) then {text(n)}" for p, n in FORMS) + " else x end"
    rules = sorted(RULES, key=lambda r: -len(r[0]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    share = lambda bad, lab, above: f"(({bad})::double + {PRIOR}.0::double * {above}) / (({lab})::double + {PRIOR}.0::double)"
    ctes = [
        "p as (select page_id, url, translate(coalesce(regexp_extract(url, %s, 1), ''), '%s', '%s') as host, coalesce(regexp_extract(url, %s, 1), '') as path from pages)" % (text(HOST), UPPER, LOWER, text(PATH)),
        "l as (select p.*, quality = 0 or toxic = 1 as bad from p left join labels on labels.doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint))",
        "s as (select *, string_split(regexp_replace(path, '^/', ''), '/') as parts from l)",
        f"t as (select *, case when path = '' then []::varchar[] else list_transform(parts, lambda x: {form}) end as t from s)",
        "m as (select host, t, count(bad) as labelled, count(*) filter (bad) as bad from t where host <> '' group by host, t)",
        "r as (select coalesce(sum(bad)::double / sum(labelled)::double, 0)::double as rate from m)",
        f"h as (select host, {share('sum(bad)', 'sum(labelled)', 'any_value(rate)')} as host_share from m, r group by host)",
        "n0 as (select m.*, '' as template, host_share as share, len(t) > 0 as open from m join h using (host))",
    ]
    for k in range(levels):
        ctes += [
            f"c{k} as (select host, template, t[{k + 1}] as seg, sum(labelled) as lab, sum(bad) as bad_, any_value(share) as above from n{k} where open group by host, template, seg)",
            f"q{k} as (select *, sum(lab) over w as lab_all, sum(bad_) over w as all_bad, count(*) over w as branches from c{k} window w as (partition by host, template))",
            f"v{k} as (select *, bad_::double as a, (lab - bad_)::double as b, (all_bad - bad_)::double as c, (lab_all - lab - all_bad + bad_)::double as d from q{k})",
            f"b{k} as (select *, case when lab < {SUPPORT} then '**' when branches = 1 or (c + d >= {SUPPORT} and (a + b + c + d) * (a * d - b * c) * (a * d - b * c) > {CHI2}::double * (a + b) * (c + d) * (a + c) * (b + d)) then seg else '*' end as branch from v{k})",
            f"g{k} as (select host, template, branch, case when branch = '**' then any_value(above) else {share('sum(bad_)', 'sum(lab)', 'any_value(above)')} end as branch_share from b{k} group by host, template, branch)",
            f"j{k} as (select b.host, b.template, b.seg, b.branch, branch_share from b{k} b join g{k} g on b.host = g.host and b.template = g.template and b.branch = g.branch)",
            f"n{k + 1} as (select n.host, n.t, labelled, bad, case when branch is null then n.template else n.template || '/' || branch end as template, coalesce(branch_share, share) as share, open and branch <> '**' and len(n.t) > {k + 1} as open from n{k} n left join j{k} j on open and n.host = j.host and n.template = j.template and n.t[{k + 1}] = j.seg)",
        ]
    ctes += [
        f"z as (select page_id, t.host as host, path, template, share as bad_share from t left join n{levels} n on t.host = n.host and t.t = n.t)",
        "f as (select *, case " + " ".join(f"when {fits(r)} then '{r}'" for r, _ in rules) + " end as rule from z)",
    ]
    verdict = "case rule " + " ".join(f"when '{r}' then '{v}'" for r, v in RULES) + f" else case when bad_share >= {REJECT} then 'block' else 'allow' end end"
    return "with " + ",\n".join(ctes) + f"\nselect page_id, host, path, rule, {verdict} as verdict, template from f"
