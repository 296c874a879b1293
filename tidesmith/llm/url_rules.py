"""URL filters: a fixed rule list, and association rules mined from labelled URLs.

A URL's tokens are its scheme, host labels and their hyphenated words, path
segments with numbers collapsed, parameter names and whether it has a fragment.
FP-growth mines the combinations of tokens that are frequent together with a
label; those of enough support and confidence become rules, unless a part of
the combination says the same with no less confidence. An inverted index keeps
each rule under its rarest token: a URL's tokens look up the rules that may
fit, and those whose tokens all occur do. Of these the most confident decides
(then the larger support, the fewer tokens, the text); without any the verdict
is `otherwise`. A fixed rule goes before all mined ones.

Only DataFrame functions and Spark's FP-growth run. The labelled rows are drawn
down to about `most_rows` by a hash of the URL, and of a labelled URL the
`most_tokens` frequent tokens that tell the labels apart best are mined (chi
square, then the text), so a row adds at most 298 combinations of up to three,
and there are at most 298 / min_support rules: small enough to be broadcast.
Judging uses all tokens of all URLs.

Null URLs and those without :// have empty host and path; null ones have no
tokens, others their path segments only if there is a host part. Repeated rows
are judged each, and mined each. Very long tokens count by their digest. An
empty table gives an empty one; without labels, or labels of one kind only,
nothing is mined. Extra columns are kept, but for result names, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of more characters count by their digest.
LONGEST = 64
#: Fixed values of the query's contract: verdict, host and path prefix.
FIXED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ROW, TOKENS, OWN = "__row", "__tokens", "__own"


@dataclass(frozen=True)
class Mining:
    """What the miner asks of a combination, and what bounds it."""

    min_support: float = 0.002
    min_rows: int = 8
    min_confidence: float = 0.5
    rule_tokens: int = 3
    most_tokens: int = 12
    most_rows: int = 1_000_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, none for null."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    scheme = F.regexp_extract(low, r"(?s)^(.*?)://", 1)
    parameters = F.regexp_extract(low, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    solid = lambda words: F.filter(words, lambda x: F.length(x) > 0)
    mark = lambda kind, words: F.transform(solid(words), lambda x: F.concat(F.lit(kind), x))
    labels = solid(F.split(host(url), r"\."))
    words = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    found = F.concat(
        mark("s:", F.array(scheme)), mark("h:", labels), mark("w:", words), mark("p:", F.transform(F.split(path(low), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))),
        mark("q:", F.transform(F.split(parameters, "&"), lambda x: F.substring_index(x, "=", 1))), mark("f:", F.array(F.when(F.rlike(low, F.lit(r"(?s)^.*?://[^#]*#")), F.lit("#")).otherwise(F.lit("")))),
    )
    return F.array_distinct(F.transform(found, lambda x: F.when(F.length(x) > LONGEST, F.concat(F.left(x, F.lit(2)), F.md5(x.cast("binary")))).otherwise(x)))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """value(verdict, host, path) of the longest rule that fits, the first of equal ones; null without any."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), value(verdict, h, p)).otherwise(out)
    return out


def mine_rules(labelled: DataFrame, mining: Mining = Mining(), url: str = "url", label: str = "label") -> DataFrame:
    """(rank, label, tokens, token, confidence, support) from rows of a url and one of two or more labels.

    rank counts from 1, the most confident rule first; token is the rarest of the rule's.
    """
    known = labelled.filter(named(url).isNotNull() & named(label).isNotNull()).select(named(url).alias("url"), named(label).cast("string").alias("label"))
    n = known.count()
    if n > mining.most_rows:
        known = known.filter(F.pmod(F.xxhash64("url", F.lit(41)), F.lit(1 << 30)) < int((1 << 30) * mining.most_rows / n))
    rows = written(known.select(F.monotonically_increasing_id().alias("row"), "label", tokens(F.col("url")).alias("tokens")), "url-labels")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, first = sum(sizes.values()), max(sizes, default="")
    need = max(mining.min_rows, int(-(-mining.min_support * n // 1)))
    exploded = rows.select("row", "label", F.explode("tokens").alias("token"))
    seen = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == first, 1)).alias("b"))
    # how far a token's rows are from the labels' shares; a token of all rows tells nothing
    apart = F.pow(F.col("b").cast("double") * n - F.col("n").cast("double") * sizes.get(first, 0), F.lit(2.0)) / (F.col("n").cast("double") * (n - F.col("n")))
    frequent = written(seen.filter((F.col("n") >= need) & (F.col("n") < n)).withColumn("apart", apart), "url-tokens")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("apart")).alias("by"), "token"))), 1, mining.most_tokens)
    items = exploded.join(frequent, "token").groupBy("row", "label").agg(F.concat(F.transform(best, lambda x: x["token"]), F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / max(n, 1)), minConfidence=mining.min_confidence).fit(written(items.select("items"), "url-items")).associationRules
    rules = found.filter(F.element_at("consequent", 1).startswith("=") & (F.size("antecedent") <= mining.rule_tokens) & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 2)").alias("label"), "confidence", "support"), "url-rules")
    # a rule goes if a part of it has no less confidence
    parts = rules.select("label", F.col("confidence").alias("least"), F.col("tokens").alias("part"))
    subsets = F.filter(F.flatten(F.transform("tokens", lambda x: F.concat(F.array(F.array(x)), F.transform("tokens", lambda y: F.array(x, y))))), lambda s: (F.size(s) < F.size("tokens")) & (F.array_distinct(s) == s) & (F.array_sort(s) == s))
    general = rules.select("label", "tokens", "confidence", F.explode(subsets).alias("part")).join(parts, ["label", "part"]).filter("least >= confidence")
    rules = rules.join(general.select("label", "tokens").distinct(), ["label", "tokens"], "left_anti")
    order = Window.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), F.array_join("tokens", " "), "label")
    ranked = written(rules.withColumn("rank", F.row_number().over(order)), "url-ranked")
    rarest = ranked.select("rank", F.explode("tokens").alias("token")).join(frequent, "token").groupBy("rank").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return written(ranked.join(rarest, "rank"), "url-index")


def url_filter(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]] = (), otherwise: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the fixed rule, else null), verdict and mined_rule (rank of the rule that decided, else null)."""
    stay = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined_rule")]
    at, mine = named(url), pages.select(*map(named, stay))
    mine = mine.withColumns({ROW: F.monotonically_increasing_id(), OWN: F.struct(host(at).alias("host"), path(at).alias("path"))})
    h, p = named(OWN)["host"], named(OWN)["path"]
    mine = mine.withColumns({OWN: F.struct(h.alias("host"), p.alias("path"), fixed_rule(h, p, rules, lambda v, a, b: F.lit(a + b)).alias("rule"), fixed_rule(h, p, rules, lambda v, a, b: F.lit(v)).alias("verdict"))})
    asked = mine.withColumn(TOKENS, F.when(named(OWN)["verdict"].isNull(), tokens(at)).otherwise(F.array().cast("array<string>")))
    index = mined.select(F.col("token").alias("__token"), F.col("rank").alias("__rank"), F.col("tokens").alias("__all"))
    # at most 298 / min_support rules: broadcast, so that a page moves once, to gather its rules
    met = asked.withColumn("__token", F.explode_outer(TOKENS)).join(F.broadcast(index), "__token", "left")
    fits = F.when(F.size(F.array_except("__all", TOKENS)) == 0, F.col("__rank"))
    best = met.groupBy(ROW).agg(F.first(F.struct(*map(named, stay))).alias("__row_of"), F.first(OWN).alias(OWN), F.min(fits).alias("__rank"))
    best = best.join(F.broadcast(mined.select(F.col("rank").alias("__rank"), F.col("label").alias("__label"))), "__rank", "left")
    verdict = F.coalesce(named(OWN)["verdict"], F.col("__label"), F.lit(otherwise))
    return best.select(*(F.col("__row_of").getField(c).alias(c) for c in stay), *(named(OWN)[c].alias(c) for c in ("host", "path", "rule")), verdict.alias("verdict"), F.col("__rank").alias("mined_rule"))


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages whose document is labelled: the last number of a path is the document's id; block if its quality is 0 or it is toxic."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    by_id = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.when(bad == 1, "block").otherwise("allow").alias("label"))
    return pages.select("url", F.regexp_extract(path(F.col("url")), "([0-9]+)[^0-9]*$", 1).alias("id")).join(by_id, "id").select("url", "label")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine_rules(document_labels(pages, table(spark, sf_dir, "labels")))
    return url_filter(pages, mined, FIXED).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


_TOKENS_SQL = r"""list_distinct(list_transform(
    list_transform(list_filter([regexp_extract(low, '(?s)^(.*?)://', 1)], lambda x: x <> ''), lambda x: 's:' || x)
    || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
    || list_transform(list_filter(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w:' || x)
    || list_transform(list_filter(string_split(regexp_extract(low, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(list_transform(string_split(regexp_extract(low, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)
    || CASE WHEN regexp_matches(low, '(?s)^.*?://[^#]*#') THEN ['f:#'] ELSE [] END,
    lambda x: CASE WHEN length(x) > 64 THEN left(x, 2) || md5(x) ELSE x END))"""
OP12_SQL = rf"""
WITH a AS (
  SELECT row_number() OVER () AS row, page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, url
  FROM pages
),
p AS (SELECT *, {_TOKENS_SQL} AS tokens FROM a),
l AS (SELECT doc_id::VARCHAR AS id, CASE WHEN max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) = 1 THEN 'block' ELSE 'allow' END AS label FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
k AS (SELECT row, tokens, label FROM p JOIN l ON l.id = regexp_extract(path, '([0-9]+)[^0-9]*$', 1) WHERE url IS NOT NULL),
z AS (SELECT count(*) AS n, greatest(8, ceil(0.002 * count(*)))::BIGINT AS need, max(label) AS first, count(*) FILTER (label = (SELECT max(label) FROM k)) AS b FROM k),
e AS (SELECT row, label, unnest(tokens) AS token FROM k),
t AS (SELECT token, count(*) AS n, count(*) FILTER (label = z.first) AS b FROM e, z GROUP BY token),
f AS (SELECT token, t.n, (t.b::DOUBLE * z.n - t.n::DOUBLE * z.b) ** 2 / (t.n::DOUBLE * (z.n - t.n)) AS apart FROM t, z WHERE t.n >= z.need AND t.n < z.n),
i AS (SELECT row, label, token FROM e JOIN f USING (token) QUALIFY row_number() OVER (PARTITION BY row ORDER BY apart DESC, token) <= 12),
s AS (
  SELECT row, label, [token] AS tokens FROM i
  UNION ALL SELECT a.row, a.label, [a.token, b.token] FROM i a JOIN i b ON a.row = b.row AND a.token < b.token
  UNION ALL SELECT a.row, a.label, [a.token, b.token, c.token] FROM i a JOIN i b ON a.row = b.row AND a.token < b.token JOIN i c ON b.row = c.row AND b.token < c.token
),
g AS (SELECT tokens, label, count(*) AS n FROM s GROUP BY ALL),
c AS (
  SELECT tokens, label, g.n::DOUBLE / (sum(g.n) OVER (PARTITION BY tokens))::DOUBLE AS confidence, g.n AS support FROM g
  QUALIFY g.n >= (SELECT need FROM z) AND confidence >= 0.5
),
r AS (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, support DESC, len(tokens), array_to_string(tokens, ' '), label) AS rank FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.label = c.label AND len(d.tokens) < len(c.tokens) AND list_has_all(c.tokens, d.tokens) AND d.confidence >= c.confidence)
),
x AS (
  SELECT p.*, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
),
m AS (SELECT x.row, min(r.rank) AS rank FROM x JOIN r ON x.rule IS NULL AND list_has_all(x.tokens, r.tokens) GROUP BY x.row)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(r.label, 'allow') END AS verdict, m.rank::INTEGER AS mined_rule
FROM x LEFT JOIN m USING (row) LEFT JOIN r ON r.rank = m.rank
"""
