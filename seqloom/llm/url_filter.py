"""URL rules by host and path: a blocked Bloom filter in front of an exact hash join. All native.

A listed entry is a host with a path, like ``example.net/en/``; it fits its host, all subdomains and
all paths that start with its path. A url has as many possible entries as there are numbers of labels and
path lengths in the list. Distinct possible entries go to one block of a Bloom filter each (a table of
512-bit blocks, one row each): one join by block number and a test of eight bits. What passes meets the
listed entries in an exact join, which removes false positives. The longest entry of a url wins; of two
as long the one with the longer host, then ``block``. Urls without an entry are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A side is broadcast up to this many rows (a filter block has 72 bytes, an entry some 100).
BROADCAST_ROWS = 200_000
#: Entries for each 512-bit block, about 16 bits an entry.
PER_BLOCK = 32
BITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production list (fixed by the contract).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    plain = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(plain, "/", 1)
    path = F.substr(plain, F.length(host) + 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def listed(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Entries (host, path, action, rule) of rules like ``("block", "example.com/de/")``, canonical and single; of opposite ones ``block`` stays."""
    if rules:
        values = ", ".join(f"(:action{i}, :rule{i})" for i in range(len(rules)))
        names = {f"{name}{i}": x for i, rule in enumerate(rules) for name, x in zip(("action", "rule"), rule, strict=True)}
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t(action, rule)", args=names)
    else:
        df = spark.sql("SELECT '' AS action, '' AS rule WHERE false")
    host = F.substring_index("rule", "/", 1)
    df = df.select(F.translate(host, UPPER, LOWER).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path"), "action", "rule")
    return df.groupBy("rule_host", "rule_path").agg(F.max_by("action", F.col("action")).alias("action"), F.min("rule").alias("rule"))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bit(key: Column, i: int) -> Column:
    """The i-th of a key's bits in its block, 0 to 511."""
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(512))


def bloom(entries: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: block, w0..w7, the 64-bit words of a block that has any entry."""
    key = _key(F.col("rule_host"), F.col("rule_path"))
    bits = F.array(*(_bit(key, i) for i in range(BITS)))
    rows = entries.select(F.pmod(key, F.lit(n_blocks)).alias("block"), F.explode(F.array_distinct(bits)).alias("bit"))
    word = lambda w: F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("block").agg(*(word(w).alias(f"w{w}") for w in range(8)))


def filter_urls(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict. A null url has an empty host and path and is allowed.

    ``entries`` has rule_host, rule_path, action, rule, as of :func:`listed`. Every row stays, repeated
    ones too; hosts may have any number of labels. An empty list allows all, an empty table gives an empty
    one. Existing columns named host, path, rule or verdict are replaced, all others are kept.
    """
    n_labels = F.size(F.split("rule_host", r"\."))
    size = entries.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path")), F.collect_set(n_labels)).first()  # some hundreds at most
    n, lengths, depths = size[0], sorted(size[1]), sorted(size[2])
    host, path = host_path(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("struct<rule:string,action:string>")
    told = lambda df: df.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"))
    if not n:
        return told(rows.withColumn("best", none))
    n_blocks = max(1, -(-n // PER_BLOCK))
    small = (lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df)
    numbers = lambda xs, most: F.filter(F.array(*(F.lit(x) for x in xs)), lambda x: x <= most)
    suffixes = F.transform(numbers(depths, F.size(F.split("host", r"\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    cuts = numbers(lengths, F.length("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda k: F.struct(h.alias("h"), F.substr(F.col("path"), F.lit(1), k).alias("p")))))).alias("e"))
    tried = tried.select("host", "path", F.col("e.h").alias("rule_host"), F.col("e.p").alias("rule_path"))
    probes = tried.select("rule_host", "rule_path").distinct().withColumn("key", _key(F.col("rule_host"), F.col("rule_path"))).withColumn("block", F.pmod("key", F.lit(n_blocks)))
    hits = probes.join(small(bloom(entries, n_blocks), n_blocks), "block")
    for i in range(BITS):
        bit = _bit(F.col("key"), i)
        word = F.element_at(F.array(*(F.col(f"w{w}") for w in range(8))), (F.shiftright(bit, 6) + 1).cast("int"))
        hits = hits.where(F.getbit(word, (bit % 64).cast("int")) == 1)
    exact = hits.select("rule_host", "rule_path").join(small(entries, n), ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("action"))
    best = tried.join(small(exact, n), ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("best"))
    # Rows without a host have no entry; they would all meet in one key
    named = rows.where("host <> ''").join(best, ["host", "path"], "left").select("row", "host", "path", "best")
    return told(named.unionByName(rows.where("host = ''").withColumn("best", none)))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed(spark, RULES)).drop("url")


_RULES_SQL = ", ".join(f"('{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for a, r in RULES)
OP3_SQL = f"""
WITH rules(action, rh, rp, rule) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS plain FROM u),
w AS (SELECT page_id, translate(regexp_extract(plain, '^[^/]*'), '{UPPER}', '{LOWER}') AS host,
             substr(plain, length(regexp_extract(plain, '^[^/]*')) + 1) AS path FROM v),
h AS (SELECT w.page_id, w.host, w.path, rules.*, row_number() OVER (PARTITION BY w.page_id ORDER BY length(rule) DESC, length(rh) DESC, action DESC) AS k
      FROM w JOIN rules ON (w.host = rh OR ends_with(w.host, '.' || rh)) AND starts_with(w.path, rp))
SELECT w.page_id, w.host, w.path, h.rule, coalesce(h.action, 'allow') AS verdict
FROM w LEFT JOIN h ON h.page_id = w.page_id AND h.k = 1
"""
