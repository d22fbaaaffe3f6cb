"""URL filters: hand-made rules first, then a tree of path templates for each host, grown level by level.

At every node of a host's tree the next path segments are counted.  Segments too rare to
be names are variable and become one wildcard; the others are branches, and branches whose
labelled share does not differ from that of their node, or differs to the same side, are one.
A template's purity is the share of its labelled pages that are bad, shrunk towards its
parent's, up to the host's and the corpus's; pages of a template of too high a purity go.

The tree grows over distinct host and path pairs with their counts.  A level is a sum for
each (host, node, segment) and joins with the named branches and the wildcards, so a host of
any size is spread over tasks; as many levels are grown as well-filled nodes have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.llm.common import LOWER, UPPER
from erario.sources.writers import written

#: Rules as host and path, with their verdicts.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: A segment is a name from so many pages on and from this share of its node's pages on; a node with fewer pages is not split.
LEAST, SHARE = 8, 0.01
#: A branch differs from its node by so many standard errors.
APART = 1.96
#: A parent's purity weighs as much as so many labelled pages.
WEIGHT = 4.0
#: Templates of a higher purity are rejected.
IMPURE = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; a null one or one without ``://`` has empty ones."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, n`` with the longest fitting ``rule`` and its ``verdict``, or nulls: each URL meets the rules of its host and of the domains above it, by key."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.filter("rule IS NOT NULL").select(F.substring_index("rule", "/", 1).alias("domain"), F.regexp_extract("rule", "/.*", 0).alias("start"), "rule", F.col("verdict").alias("said"))
    met = urls.select("host", "path", F.explode(domains).alias("domain")).join(own, "domain").filter(F.col("path").startswith(F.col("start")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "said")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", "n", F.col("best.rule").alias("rule"), F.col("best.said").alias("verdict"))


def _purity(parent: Column) -> Column:
    return (F.col("bad") + WEIGHT * parent) / (F.col("good") + F.col("bad") + WEIGHT)


def _counted(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def branches(children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next level of the tree from ``host, node, purity, segment, n, good, bad``.

    Gives ``host, node, segment, below, below_purity, below_n`` for segments that are names
    and ``host, node, rare, rare_purity, rare_n`` for the wildcards of all others.
    """
    children = written(children, "segments")  # stored, like the sums, so that a hot host's joins can be split
    whole = written(children.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")), "whole")
    judged = written(children.join(whole, ["host", "node"]).withColumn("named", (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all_n"))), "children")
    usual = (F.col("all_bad") + 0.5) / (F.col("all_good") + F.col("all_bad") + 1.0)
    labelled = F.col("good") + F.col("bad")
    off = F.col("bad") / labelled - usual
    side = F.when(labelled == 0, 0).when(off * off * labelled <= APART * APART * usual * (1.0 - usual), 0).otherwise(F.signum(off).cast("int"))
    named = judged.filter("named").withColumn("side", side)
    merged = named.groupBy("host", "node", "side").agg(
        F.sum("n").alias("below_n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("purity").alias("purity"), F.count("*").alias("members"), F.max(F.struct("n", "segment")).alias("most")
    )
    token = F.concat(F.when(F.col("members") == 1, "=").otherwise("~"), F.col("most.segment"))
    merged = merged.select("host", "node", "side", F.concat("node", F.lit("/"), token).alias("below"), _purity(F.col("purity")).alias("below_purity"), "below_n")
    rare = judged.filter("NOT named").groupBy("host", "node").agg(F.sum("n").alias("rare_n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("purity").alias("purity"))
    rare = rare.select("host", "node", F.concat("node", F.lit("/*")).alias("rare"), _purity(F.col("purity")).alias("rare_purity"), "rare_n")
    return named.select("host", "node", "side", "segment").join(written(merged, "merged"), ["host", "node", "side"]).drop("side"), written(rare, "rare")


def templates(urls: DataFrame) -> DataFrame:
    """``host, path, template, purity`` of all ``host, path, n, good, bad``: the node of the host's tree that a path ends in.

    Tokens of a template: ``=name`` one branch, ``~name`` merged branches under their most
    frequent name, ``*`` variable segments, ``**`` the rest below a node with few pages.
    """
    total = urls.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    good, bad = total.good or 0, total.bad or 0
    hosts = _counted(urls, "host").select("host", F.col("n").alias("node_n"), _purity(F.lit((bad + 1) / (good + bad + 2))).alias("purity"))
    rest = F.filter(F.split("path", "/"), lambda segment: segment != "")
    state = written(urls.join(hosts, "host").select("host", "path", "n", "good", "bad", F.lit("").alias("node"), "node_n", "purity", rest.alias("rest")), "state")
    ended = None
    while True:
        split = (F.size("rest") > 0) & (F.col("node_n") >= LEAST)
        done = state.filter(~split).select("host", "path", F.concat("node", F.when(F.size("rest") > 0, "/**").otherwise("")).alias("template"), "purity")
        ended = done if ended is None else ended.unionByName(done)
        live = state.filter(split).withColumn("segment", F.element_at("rest", 1))
        if live.isEmpty():
            return ended
        names, rare = branches(live.groupBy("host", "node", "segment").agg(F.first("purity").alias("purity"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        met = live.drop("purity", "node_n").join(names, ["host", "node", "segment"], "left").join(rare, ["host", "node"], "left")
        state = written(
            met.select(
                "host", "path", "n", "good", "bad", F.coalesce("below", "rare").alias("node"), F.when(F.col("below").isNull(), F.col("rare_n")).otherwise(F.col("below_n")).alias("node_n"),
                F.when(F.col("below").isNull(), F.col("rare_purity")).otherwise(F.col("below_purity")).alias("purity"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
            ),
            "state",
        )


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page.

    A rule ``domain/start`` fits the domain and all below it if the path starts with
    ``/start``; the longest wins.  The verdicts of rules label the pages they fit; ``labels``
    (``page_id, bad``) labels pages by id instead, with 0 or 1.  Pages without a rule are
    blocked if their template's purity is above ``IMPURE``.

    Null URLs and those without ``://`` have an empty host and path, and one template.
    Repeated rows are judged each and count each; a null id has no label of its own.  Without
    any label every purity is one half, and all pages without a rule are allowed.  Other
    columns are not read; no rows give none.
    """
    host, path = url_parts(F.col("url"))
    parted = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    urls = written(with_rules(parted.groupBy("host", "path").agg(F.count("*").alias("n")), fixed_rules(pages.sparkSession) if rules is None else rules), "urls")
    if labels is None:
        counts = urls.select("host", "path", "n", *[F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0).alias(name) for name, verdict in (("good", "allow"), ("bad", "block"))])
    else:
        known = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("label"))
        met = parted.join(known, "page_id").groupBy("host", "path").agg(F.sum((F.col("label") == 0).cast("long")).alias("good"), F.sum((F.col("label") == 1).cast("long")).alias("bad"))
        counts = urls.select("host", "path", "n").join(met, ["host", "path"], "left").fillna(0, ["good", "bad"])
    judged = templates(counts).join(urls.select("host", "path", "rule", "verdict"), ["host", "path"])
    verdict = F.coalesce("verdict", F.when(F.col("purity") > IMPURE, "block").otherwise("allow"))
    judged = written(judged.select("host", "path", "rule", verdict.alias("verdict"), "template", "purity"), "judged")
    return parted.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def _level_sql(i: int) -> str:
    """One level of the tree: what ``branches`` and one turn of ``templates`` do."""
    return f"""
live{i} AS (SELECT *, rest[1] AS segment FROM state{i} WHERE len(rest) > 0 AND node_n >= {LEAST}),
child{i} AS (SELECT host, node, segment, any_value(purity) AS purity, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM live{i} GROUP BY host, node, segment),
judged{i} AS (
  SELECT *, n >= {LEAST} AND n >= {SHARE}::DOUBLE * all_n AS named, (all_bad + 0.5::DOUBLE) / (all_good + all_bad + 1.0::DOUBLE) AS usual, good + bad AS labelled
  FROM (SELECT *, sum(n) OVER node AS all_n, sum(good) OVER node AS all_good, sum(bad) OVER node AS all_bad FROM child{i} WINDOW node AS (PARTITION BY host, node))),
sided{i} AS (
  SELECT *, CASE WHEN labelled = 0 THEN 0 WHEN off * off * labelled <= {APART}::DOUBLE * {APART}::DOUBLE * usual * (1.0::DOUBLE - usual) THEN 0 ELSE sign(off)::INT END AS side
  FROM (SELECT *, CASE WHEN labelled > 0 THEN bad::DOUBLE / labelled - usual END AS off FROM judged{i} WHERE named)),
merged{i} AS (
  SELECT host, node, side, node || '/' || CASE WHEN count(*) = 1 THEN '=' ELSE '~' END || max(struct_pack(n := n, segment := segment)).segment AS below,
    (sum(bad) + {WEIGHT}::DOUBLE * any_value(purity)) / (sum(good) + sum(bad) + {WEIGHT}::DOUBLE) AS below_purity, sum(n) AS below_n
  FROM sided{i} GROUP BY host, node, side),
rare{i} AS (SELECT host, node, node || '/*' AS rare, (sum(bad) + {WEIGHT}::DOUBLE * any_value(purity)) / (sum(good) + sum(bad) + {WEIGHT}::DOUBLE) AS rare_purity, sum(n) AS rare_n FROM judged{i} WHERE NOT named GROUP BY host, node),
state{i + 1} AS (
  SELECT l.host, l.path, l.n, l.good, l.bad, coalesce(below, rare) AS node, CASE WHEN below IS NULL THEN rare_n ELSE below_n END AS node_n, CASE WHEN below IS NULL THEN rare_purity ELSE below_purity END AS purity, l.rest[2:] AS rest
  FROM live{i} l LEFT JOIN (SELECT host, node, segment, below, below_purity, below_n FROM sided{i} JOIN merged{i} USING (host, node, side)) b USING (host, node, segment) LEFT JOIN rare{i} r USING (host, node)),"""


def judge_sql(levels: int = 6) -> str:
    """The same in DuckDB, for trees of so many levels."""
    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
    ended = " UNION ALL ".join(f"SELECT host, path, node || CASE WHEN len(rest) > 0 THEN '/**' ELSE '' END AS template, purity FROM state{i} WHERE len(rest) = 0 OR node_n < {LEAST}" for i in range(levels + 1))
    return rf"""
WITH parted AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
urls AS (SELECT host, path, count(*) AS n FROM parted GROUP BY host, path),
rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS domain, rule[strpos(rule, '/'):] AS start FROM (VALUES {rules}) t(rule, verdict)),
fits AS (SELECT host, path, rule, verdict FROM urls JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) = 1),
counted AS (
  SELECT host, path, n, rule, verdict, CASE WHEN verdict = 'allow' THEN n ELSE 0 END AS good, CASE WHEN verdict = 'block' THEN n ELSE 0 END AS bad FROM urls LEFT JOIN fits USING (host, path)),
total AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(good) + sum(bad) + 2) AS usual FROM counted),
hosts AS (SELECT host, sum(n) AS node_n, (sum(bad) + {WEIGHT}::DOUBLE * any_value(usual)) / (sum(good) + sum(bad) + {WEIGHT}::DOUBLE) AS purity FROM counted, total GROUP BY host),
state0 AS (SELECT host, path, n, good, bad, '' AS node, node_n, purity, list_filter(string_split(path, '/'), lambda x: x <> '') AS rest FROM counted JOIN hosts USING (host)),{"".join(map(_level_sql, range(levels)))}
ended AS ({ended})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN purity > {IMPURE} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM parted JOIN counted USING (host, path) JOIN ended USING (host, path)
"""


JUDGE_SQL = judge_sql()
