"""URL filters: rules on host and path, and block decisions that follow redirects and canonical links.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import written
from offergrid.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (len, verdict, rule) of the longest rule that fits, null if none does.

    ``rules`` are (verdict, host, path) triples of a policy that the caller states in code; a policy of so many
    rules that they no longer fit a plan belongs in a table joined on host suffixes.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("len"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in rules]
    # At equal length an allow stands before a block.
    longest = sorted(zip(fits, rules, strict=True), key=lambda x: (-len(x[1][1] + x[1][2]), x[1][0]))
    return F.coalesce(*[f for f, _ in longest]) if longest else F.lit(None).cast("struct<len:int,verdict:string,rule:string>")


def url_key(host: Column, url: Column) -> Column:
    """The same resource under one name: host, path and query, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest == "", "/").otherwise(rest)))


def without_dots(path: Column) -> Column:
    """A path that begins with ``/``, without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.expr("cast(array() as array<string>)"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(path.rlike(r"(?s)/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolved(base: Column, to: Column) -> Column:
    """``to`` as an absolute URL, read on a page at ``base`` (RFC 3986, 5.2); null where ``base`` has no host for it.

    Other schemes without ``//`` (mailto:, javascript:, data:) lead to no page and give null.
    """
    clean = F.regexp_replace(to, "(?s)#.*$", "")
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    query = F.regexp_extract(clean, r"(?s)(\?.*)$", 1)
    path = F.regexp_extract(clean, r"(?s)^([^?]*)", 1)
    own = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(own, "(?s)^(.*/)", 1), path))
    same = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    relative = F.when(path == "", F.concat(root, own, F.when(query == "", same).otherwise(query))).otherwise(F.concat(root, without_dots(merged), query))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(host == "", F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .otherwise(relative)
    )


#: Text that holds no tags: comments, and elements whose content is not markup. An end that is missing is the page's.
RAW = r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|xmp|iframe|noembed|noframes|template)(?=[\s/>]).*?(?:</\1(?=[\s/>])|$)"
#: A tag up to its own ``>``, not one within quotes; of at most 1,000 quoted values, more are no tag of a page.
TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,1000}+>"""
PAIR = r"""(?s)[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?"""


def pairs_of(tag: Column) -> Column:
    """The attributes of a tag as an array of ``name=value`` texts; a name within another one's quotes is none."""
    return F.regexp_extract_all(F.regexp_replace(tag, r"(?s)^<\w+", ""), F.lit(PAIR), F.lit(0))


def value_of(pairs: Column, name: str) -> Column:
    """The value of the first attribute of this name, without quotes and outer space; null if there is none."""
    pair = F.get(F.filter(pairs, lambda p: F.lower(p).rlike(rf"^{name}\s*(?:=|$)")), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(pair, r"(?s)^[^=]*=?\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)^\s+|\s+$", ""), "(?i)&(?:amp|#38|#x26);", "&")


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) keys: each page's canonical links (``rel`` holds that word) and refresh redirects to another URL.

    Tags in comments, scripts and other raw text are none. Targets are resolved against the page's first ``<base href>``,
    itself resolved against the page's url, or that url. Each step works on the columns of the one before, and the ends are
    written before they are filtered, so that no expression is put into another.
    """
    some = pages.where(F.col("html").rlike(r"(?i)<(?:link|meta)[\s/]"))
    tags = some.select("url", F.regexp_extract_all(F.regexp_replace("html", RAW, " "), F.lit(TAG), F.lit(0)).alias("tags"))
    first = F.get(F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: value_of(pairs_of(t), "href")), lambda h: h != ""), F.lit(0))
    tag = tags.select("url", first.alias("given"), F.explode(F.filter("tags", lambda t: t.rlike("(?i)^<(?:link|meta)"))).alias("tag"))
    named = tag.select("url", "given", F.lower(F.substring("tag", 2, 4)).alias("kind"), pairs_of(F.col("tag")).alias("pairs"))
    valued = named.select("url", "given", "kind", *[value_of(F.col("pairs"), n).alias(n) for n in ("rel", "href", "http-equiv", "content")])
    rest = r"""(?is)^[\d.\s]+[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^"'].*))"""
    goes = F.concat(*[F.regexp_extract("content", rest, i) for i in (1, 2, 3)])
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    to = F.when(canonical, F.col("href")).when((F.col("kind") == "meta") & (F.lower("http-equiv") == "refresh"), F.trim(goes))
    based = valued.select("url", F.when(F.col("given").isNull(), F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("given")), F.col("url"))).alias("base"), to.alias("to"))
    ends = based.select("url", F.when(F.col("to") != "", resolved(F.col("base"), F.col("to"))).alias("to"))
    hosts = ends.select("url", "to", host_of(F.col("url")).alias("from_host"), host_of(F.col("to")).alias("to_host"))
    keys = written(hosts.select(url_key(F.col("from_host"), F.col("url")).alias("src"), url_key(F.col("to_host"), F.col("to")).alias("dst")), "ends")
    return keys.where("src is not null and dst is not null and src <> dst").distinct()


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """Judge every row of ``pages`` by its url.

    A url that a rule fits gets that rule's verdict. Others get the verdict of their aliases: the urls connected
    with theirs by canonical links, refresh redirects (both also relative) and rows (src, dst) of ``redirects`` (absolute urls). If a
    rule allows any alias, the alias class is allowed; else if a rule blocks any, it is blocked; else allowed.

    Returns ``id_col``, url, host, path, rule (null: none fits), verdict and alias_class (null without links).
    Null urls and urls without ``://`` have empty host and path and are allowed; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(F.col(id_col), F.col("url"), host.alias("host"), path.alias("path")).withColumn("key", url_key(F.col("host"), F.col("url"))).withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        ends = redirects.select(*[url_key(host_of(F.col(c)), F.col(c)).alias(c) for c in ("src", "dst")])
        links = links.unionByName(ends.where("src is not null and dst is not null and src <> dst").distinct())
    links = written(links, "links")
    out = [F.col(id_col), F.col("url"), F.col("host"), F.col("path"), F.col("own.rule").alias("rule")]
    if links.isEmpty():
        return base.select(*out, F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
    classes = written(connected_components(links), "aliases")
    # Every alias counts, also one that is no page itself.
    own_host = F.regexp_extract("id", r"(?s)^([^/?#]*)", 1)
    alias = classes.withColumn("rule", best_rule(own_host, F.regexp_extract("id", r"(?s)^[^/?#]*([^?#]*)", 1), rules))
    ruled = alias.groupBy("component").agg(F.max(F.col("rule.verdict") == "allow").alias("allowed"), F.max(F.col("rule.verdict") == "block").alias("blocked"))
    decided = classes.join(ruled, "component").select(F.col("id").alias("key"), F.col("component").alias("alias_class"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("inherited"))
    return base.join(decided, "key", "left").select(*out, F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"), "alias_class")
