"""URL filters by a temporal list join (operator 6); DataFrame functions only.

Dated entries (a list adds or removes a key on a date) become validity intervals. A key is a host, a parent domain, or
a host with the first path segment. The distinct moments of captures (host, first segment, fetch time) ask every list
that has one of their keys. Questions and interval starts of a key and list are put in order of time, and each question
takes the last start before it (a sorted as-of join); it counts if the interval has not ended. The most specific active
entry decides: a path before a host, a host before its parent domains, then the later start, then the list's name.

The questions of a key and list with very many of them are dealt to pieces, each with a copy of its intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Questions about one key and list that are put in order in one task, about.
PIECE = 2_000
#: At most so many keys and lists are parted, which bounds the table of them that is broadcast; with very many questions pieces are larger.
MOST_PARTED = 100_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """The first path segment with its slash, or an empty string."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1), F.lit(""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, verdict, valid_from, valid_to) from (list, key, verdict, action, at).

    ``action`` is ``add`` or ``remove``. An addition holds from its time until the next removal of the key from the list;
    without one, ``valid_to`` is null. Adding what is there, or removing what isn't, changes nothing. At one time an
    addition comes after a removal. Entries with a null list, key, action or time are left out; repeated ones count once.
    """
    given = entries.select("list", F.lower("key").alias("key"), "verdict", "action", "at").filter("list is not null and key is not null and at is not null and action in ('add', 'remove')").distinct()
    w = Window.partitionBy("list", "key").orderBy("at", F.col("action").desc(), "verdict")
    # one state for each time: the last action of it
    last = given.withColumn("next_at", F.lead("at").over(w)).filter(F.col("next_at").isNull() | (F.col("next_at") != F.col("at"))).drop("next_at")
    v = Window.partitionBy("list", "key").orderBy("at")
    turn = last.withColumn("before", F.lag("action").over(v)).filter(F.when(F.col("before").isNull(), F.col("action") == "add").otherwise(F.col("before") != F.col("action")))
    closed = turn.withColumn("valid_to", F.lead("at").over(v))
    return closed.filter("action = 'add'").select("list", "key", "verdict", F.col("at").alias("valid_from"), "valid_to")


def _keys(host: Column, segment: Column) -> Column:
    """All keys of a site with their specificity: the host and its parent domains down to two labels, and host with segment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("spec")))
    path = F.when(segment != "", F.array(F.struct(F.concat(host, segment).alias("key"), (n + 1000).alias("spec")))).otherwise(F.array())
    return F.concat(domains, path.cast("array<struct<key:string,spec:int>>"))


def active_at(asked: DataFrame, valid: DataFrame, piece: int = PIECE) -> DataFrame:
    """``asked`` (list, key, at and more) with valid_from and verdict of the interval that holds then; others are dropped.

    ``valid``: list, key, verdict, valid_from, valid_to, where intervals of a list and key don't overlap.
    """
    more = [c for c in asked.columns if c not in ("list", "key", "at")]
    counts = common.materialise(asked.groupBy(F.col("list").alias("l"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")), "url-counts")
    piece = max(piece, (counts.agg(F.sum("n")).head()[0] or 0) // MOST_PARTED)
    many = counts.select("l", "k", F.ceil(F.col("n") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    dealt = lambda df: df.join(F.broadcast(many), (F.col("list") == F.col("l")) & (F.col("key") == F.col("k")), "left").drop("l", "k").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    span = F.struct("valid_from", "valid_to", "verdict")
    no_span = F.lit(None).cast("struct<" + ",".join(f"{c}:{valid.schema[c].dataType.simpleString()}" for c in ("valid_from", "valid_to", "verdict")) + ">")
    starts = dealt(valid).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    starts = starts.select("list", "key", "piece", F.col("valid_from").alias("at"), F.lit(0).alias("side"), span.alias("span"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in more])
    questions = dealt(asked).select("list", "key", F.pmod(F.xxhash64("at", *more), F.col("pieces")).cast("int").alias("piece"), "at", F.lit(1).alias("side"), no_span.alias("span"), *more)
    upto = Window.partitionBy("list", "key", "piece").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(questions).repartition("list", "key", "piece").withColumn("span", F.last("span", ignorenulls=True).over(upto)).filter("side = 1 and span is not null")
    return met.filter(F.col("span.valid_to").isNull() | (F.col("at") < F.col("span.valid_to"))).select(*asked.columns, "span.valid_from", "span.verdict")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetch_time", piece: int = PIECE) -> DataFrame:
    """``captures`` with n_active, verdict and entry.

    ``n_active`` counts the active intervals of all keys of the URL, ``verdict`` is that of the deciding entry (``none``
    where no entry is active, the URL is null or has no host, or the fetch time is null) and ``entry`` its ``list:key``
    (null where none). Rows are neither added nor lost, repeated ones judged alike; columns of captures with the new names
    are replaced. Fetch times and the entries' times are of one type.
    """
    names = [c for c in captures.columns if c not in ("n_active", "verdict", "entry")]
    h, s, t = common.fresh(captures, "_host", "_segment", "_at")
    seen = captures.select(*names, host_of(F.col(url)).alias(h), segment_of(F.col(url)).alias(s), F.col(at).alias(t))
    moments = seen.select(F.col(h).alias("host"), F.col(s).alias("segment"), F.col(t).alias("at")).filter("host is not null and at is not null").distinct()
    keys = moments.withColumn("k", F.explode(_keys(F.col("host"), F.col("segment")))).select("host", "segment", "at", "k.key", "k.spec")
    valid = common.materialise(validity_intervals(entries), "url-intervals")
    lists = valid.select("list", F.col("key").alias("k")).distinct()
    asked = common.materialise(keys.join(lists, F.col("key") == F.col("k")).drop("k"), "url-asked")
    best = F.max(F.struct("spec", "valid_from", "list", "key", "verdict"))
    h2, s2, t2, n2, b2 = common.fresh(seen, "_host2", "_segment2", "_at2", "_n", "_best")
    told = active_at(asked, valid, piece).groupBy(F.col("host").alias(h2), F.col("segment").alias(s2), F.col("at").alias(t2)).agg(F.count(F.lit(1)).alias(n2), best.alias(b2))
    joined = seen.join(told, (F.col(h) == F.col(h2)) & (F.col(s) == F.col(s2)) & (F.col(t) == F.col(t2)), "left")
    return joined.select(
        *names,
        F.coalesce(F.col(n2), F.lit(0)).cast("long").alias("n_active"),
        F.coalesce(F.col(b2)["verdict"], F.lit("none")).alias("verdict"),
        F.when(F.col(b2).isNotNull(), F.concat_ws(":", F.col(b2)["list"], F.col(b2)["key"])).alias("entry"),
    )
