"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a site if more than ``ratio`` of the site's pages, and
at least ``least`` pages, contain it.  Such lines are dropped from every page of
that site and from no other.  Pages of a site are counted whole; a line counts
once a page however often it stands there.

Lines are counted by a 128-bit digest with partial sums before the shuffle, so a
line on every page costs one row per task.  What is left is, per site, at most
1/ratio times the lines of an average page; pages meet it by site and salt.  A
site with more than a quarter of an even share of all pages has as many salts as
it has such quarters; these sites are at most four times the shuffle width, so the
table of their salts is broadcast.

Defined cases: a null site is the site ''; null text has no lines; blank lines
are not judged and stay; repeated rows are pages of their own; an empty table
gives an empty result; other columns pass through, and the names this operator
adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import durable, fresh, shuffle_width

RATIO_PERCENT, LEAST = 10, 5

BLOCK_TAGS = "p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|nav|header|footer|section|title|head|body|html|main|aside"


def digest(line: Column) -> Column:
    return F.md5(line)


def html_lines(html: Column) -> Column:
    """Text lines of a page: block tags end a line, other tags vanish."""
    bare = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    cut = F.regexp_replace(bare, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    lines = F.transform(F.split(F.regexp_replace(cut, "<[^>]*>", ""), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#:]+)", 1)


def drop_boilerplate(pages: DataFrame, site: Column, lines: Column, ratio_percent: int = RATIO_PERCENT, least: int = LEAST, overall: bool = False) -> DataFrame:
    """Add ``site``, ``kept_lines`` (array), ``n_lines`` and ``n_dropped`` (longs).

    With ``overall``, all pages are judged as one more site as well: a line that
    is boilerplate among them is dropped on every site.
    """
    common_, salts_, salt_, hit_, all_ = fresh(pages, "_common", "_salts", "_salt", "_hit", "_all")
    base = pages.withColumns({"site": F.coalesce(site, F.lit("")), "kept_lines": F.coalesce(lines, F.array().cast("array<string>"))})
    totals = durable(base.groupBy("site").agg(F.count("*").alias("pages")))
    all_pages = totals.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    seen = base.select("site", F.explode(F.array_distinct("kept_lines")).alias("line")).where(F.trim("line") != "")
    counted = seen.groupBy("site", F.unhex(digest(F.col("line"))).alias("line")).agg(F.count("*").alias("n"))
    often = (F.col("n") >= least) & (F.col("n") * 100 > F.col("pages") * ratio_percent)
    common = counted.where(F.col("n") >= least).join(totals, "site").where(often).select("site", "line")
    listed = common.groupBy("site").agg(F.collect_list(F.lower(F.hex("line"))).alias(common_))
    quarters = 4 * shuffle_width(pages.sparkSession)
    hot = totals.where(F.col("pages") * quarters > all_pages).select("site", F.ceil(F.col("pages") * quarters / all_pages).cast("int").alias(salts_))
    dealt = listed.join(F.broadcast(hot), "site", "left").select("site", common_, F.explode(F.sequence(F.lit(0), F.coalesce(salts_, F.lit(1)) - 1)).alias(salt_))
    salted = base.join(F.broadcast(hot), "site", "left").withColumn(salt_, F.pmod(F.xxhash64(F.concat_ws("\n", "kept_lines"), F.monotonically_increasing_id()), F.coalesce(salts_, F.lit(1))).cast("int")).drop(salts_)
    joined = salted.join(dealt, ["site", salt_], "left")
    if overall:
        # Lines on that share of all pages are no more than 1/ratio times those of an average page: one row holds them.
        everywhere = counted.groupBy("line").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") * 100 > all_pages * ratio_percent))
        one = everywhere.agg(F.collect_list(F.lower(F.hex("line"))).alias(all_))
        joined = joined.crossJoin(F.broadcast(one)).withColumn(common_, F.concat(F.coalesce(common_, F.array().cast("array<string>")), all_))
    # The page's own lines are put into a set once; the list of its site is then looked up in it.
    joined = joined.withColumn(hit_, F.array_intersect(common_, F.transform("kept_lines", digest)))
    kept = F.when(F.coalesce(F.size(hit_), F.lit(0)) == 0, F.col("kept_lines")).otherwise(
        F.filter("kept_lines", lambda x: (F.trim(x) == "") | ~F.array_contains(hit_, digest(x)))
    )
    return (
        joined.withColumn("n_lines", F.size("kept_lines").cast("long"))
        .withColumn("kept_lines", kept)
        .withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines"))
        .select(*[c for c in pages.columns if c not in ("site", "kept_lines", "n_lines", "n_dropped")], "site", "kept_lines", "n_lines", "n_dropped")
    )
