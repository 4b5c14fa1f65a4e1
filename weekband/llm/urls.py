r"""URL filters by hashed expressions, as browsers look up block lists.

A rule is a host and a path prefix. It fits its host and all subdomains of it, if the path of the URL
starts with its own. Each URL is expanded into expressions, a suffix of its host of whole labels with a
prefix of its path of whole segments; each rule has one expression, its path up to the last slash. Both meet
in an equi-join on a short prefix of the digest, then the full digests and the rest of the path are compared. The
longest rule wins; of equally long ones a blocking rule.

Expressions deeper than any rule cannot match and are not made, so a very long URL stays cheap. The
rules are repeated for a number of salts, which keeps an expression that a third of all URLs share (such as
`com/`) from going to one task when rules are too many to be broadcast.

Defined results: a NULL URL or one without `://` has an empty host and path; no rule fits an empty host
unless its own host is empty. Repeated rows come back as often as they came. An empty table of pages gives an empty
result; without rules every URL gets the default verdict. Other columns of the input are ignored. Rules with a NULL host or path are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to `?`, `#` or the end; optional in the pattern, so that no later `://` is tried."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+(/[^?#]*)?", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def short(full: Column, n_bytes: int) -> Column:
    return F.substring(full, 1, n_bytes)


def expressions(host: Column, path: Column, max_labels: int, max_depth: int) -> Column:
    """Array of (host, path): host suffixes of at most `max_labels` labels, path prefixes of at most `max_depth` slashes."""
    labels = F.split(host, r"\.", -1)
    n = F.least(F.size(labels), F.lit(max_labels))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    depth = F.least(F.regexp_count(path, F.lit("/")), F.lit(max_depth))
    prefixes = F.transform(
        F.sequence(F.lit(0), depth),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))),
    )
    pair = lambda h, p: F.struct(h.alias("host"), p.alias("path"))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: pair(h, p))))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    prefix_bytes: int = 4,
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` for every page; `rules` has `host`, `path`, `verdict`."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    # One small pass over the rules gives their greatest depth.
    sizes = known.agg(
        F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"),
        F.max(F.regexp_count("r_path", F.lit("/"))).alias("depth"),
    ).first()
    found = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    distinct = found.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    if sizes["labels"] is None:
        matched = distinct.withColumn("best", F.lit(None).cast("struct<length:int,block:boolean,rule:string,verdict:string>"))
    else:
        matched = lookup(distinct, known, sizes["labels"], sizes["depth"], prefix_bytes)
    return matched.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"),
    ).drop("_copy")


def lookup(pages: DataFrame, rules: DataFrame, max_labels: int, max_depth: int, prefix_bytes: int) -> DataFrame:
    """`pages` with `best`, the rule that wins or NULL; one row per (page_id, host, path) in and out."""
    stem = F.when(F.instr("r_path", "/") > 0, F.regexp_extract("r_path", "(?s)^.*/", 0)).otherwise(F.lit(""))
    listed = (
        rules.withColumn("r_digest", digest(F.col("r_host"), stem))
        .withColumn("key", short(F.col("r_digest"), prefix_bytes))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    expanded = (
        pages.withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), max_labels, max_depth)))
        .withColumn("e_digest", digest(F.col("e.host"), F.col("e.path")))
        .withColumn("key", short(F.col("e_digest"), prefix_bytes))
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
        .drop("e")
    )
    confirmed = (F.col("e_digest") == F.col("r_digest")) & F.startswith("path", F.col("r_path"))
    winner = F.struct(
        F.length(F.concat("r_host", "r_path")).alias("length"),
        (F.col("r_verdict") == "block").alias("block"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    return (
        expanded.join(listed, ["key", "salt"], "left")
        .groupBy("page_id", "host", "path", "n")
        .agg(F.max(F.when(confirmed, winner)).alias("best"))
    )
