"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate strings and their spans.  The hash of every candidate is
then counted over the whole corpus by distinct repositories and owners: a value
that many owners hold is a copied example, a value of one owner that also looks
random is a live credential.  Besides the spans of the base patterns the scan
adds spans of bare tokens that this count finds live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import let

from .common import stage, text_or_empty

# The base patterns by kind, in the order of the report.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Runs of 20 and of 24 characters at least.  A match of ACCESS or HEX is the whole
# rest of a run, so no valid match starts inside one that is too short and the
# bound can be part of the pattern.
_ACCESS_LONG = r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4)
_HEX_LONG = r"[0-9a-f]{%d,}" % MIN_HEX
#: Bare tokens: long unbroken strings that mix letters and digits.
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Distinct characters from which on a value looks random: this share of its
#: length, or of the characters its kind is made of, whichever is less.
MIN_VARIETY = 0.3
_HEX_SYMBOLS, _CAPITALS, _SYMBOLS = 16, 36, 66
#: Matches of a text whose places are summed together.
_RUN = 256


def _running(values: Column, start: Column) -> Column:
    """Where each of ``values`` (lengths) begins, one after the other from ``start``."""
    zero = F.struct(start.alias("pos"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        values,
        zero,
        lambda acc, x: F.struct((acc["pos"] + x).alias("pos"), F.concat(acc["starts"], F.array(acc["pos"])).alias("starts")),
        lambda acc: acc["starts"],
    )


def _starts(pieces: Column) -> Column:
    """Start of each match ``m`` behind its gap ``g``.

    An array that grows in a fold is copied each time, so sums run within blocks of
    bounded size, and over the lengths of the blocks.
    """
    sizes = F.transform(pieces, lambda x: F.length(x["g"]) + F.length(x["m"]))

    def placed(sizes: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_RUN))
        return let(F.transform(firsts, lambda i: F.slice(sizes, i, _RUN)), blocked)

    def blocked(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda total, n: total + n))
        pairs = F.arrays_zip(blocks.alias("b"), _running(whole, F.lit(0)).alias("s"))
        return F.flatten(F.transform(pairs, lambda x: _running(x["b"], x["s"])))

    places = F.arrays_zip(let(sizes, placed).alias("p"), pieces.alias("x"))
    return F.transform(places, lambda y: y["p"] + F.length(y["x"]["g"]))


def spans_of(text: Column, pattern: str, kind: str, min_length: int = 0, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<kind, start, end, value>>``.

    Positions are code points, end exclusive.  Matches whose value (the given
    group) is shorter than ``min_length`` are dropped after matching.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1 + value_group)) if value_group else found
    # The text before each match; the piece after the last one is not needed.
    gaps = F.split(text, pattern, -1)

    def spans(m: Column) -> Column:
        pieces = F.arrays_zip(m["m"].alias("m"), F.slice(m["g"], 1, F.size(m["m"])).alias("g"))
        starts = let(pieces, _starts)
        return F.transform(
            F.arrays_zip(starts.alias("s"), m["m"].alias("m"), m["v"].alias("v")),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                x["s"].alias("start"),
                (x["s"] + F.length(x["m"])).alias("end"),
                x["v"].alias("value"),
            ),
        )

    matched = F.struct(found.alias("m"), values.alias("v"), gaps.alias("g"))
    kept = F.filter(let(matched, spans), lambda x: F.length(x["value"]) >= min_length)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start, then kind as listed."""
    spans = F.concat(
        spans_of(text, ASSIGN, "assign", MIN_ASSIGN, 2),
        spans_of(text, _ACCESS_LONG, "access"),
        spans_of(text, _HEX_LONG, "hex"),
    )
    return in_order(spans)


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed (kinds of the method last), then end."""
    rank = F.create_map(*[v for i, k in enumerate((*KINDS, "live")) for v in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        spans, lambda x: F.struct(x["start"].alias("a"), rank[x["kind"]].alias("b"), x["end"].alias("c"), x.alias("x"))
    )
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def looks_random(kind: Column, value: Column) -> Column:
    """Whether a value has as many distinct characters as chance would give it.

    A share of the length is asked for up to where it passes the same share of the
    characters of the kind, so that no value is too long.  Values of hexadecimal
    digits only are measured with these, whatever their kind.
    """
    symbols = (
        F.when(value.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), _HEX_SYMBOLS).when(kind == "access", _CAPITALS).otherwise(_SYMBOLS)
    )
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return distinct >= MIN_VARIETY * F.least(F.length(value), symbols)


def ownership(candidates: DataFrame, repo: list[str], owner: list[str]) -> DataFrame:
    """``hash, n_repositories, n_owners, n_rows`` of each candidate value.

    Rows are first merged per value and repository in the map tasks, so a value
    held by a third of all rows reaches its reducer once per repository and task.
    """
    per_repo = candidates.groupBy("hash", *repo).agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repo.groupBy("hash", *owner).agg(
        F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n")
    )
    return per_owner.groupBy("hash").agg(
        F.sum("repos").alias("n_repositories"),
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("n").alias("n_rows"),
    )


def scan_secrets(
    docs: DataFrame,
    repo: list[str],
    owner: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: its secrets, classed by ownership.

    ``repo`` are the columns that name a repository, among them those of
    ``owner`` (null is a name like any other).  Returns ``doc_id``, ``n_assign``,
    ``n_access``, ``n_hex``, ``base`` and ``added`` (arrays of spans with value
    hash; ``added`` are bare tokens found live that overlap no base span), and
    ``n_example``, ``n_live``, ``n_shared`` over all its candidates.  A null text
    counts as empty.  Columns that are not named are not read; an empty table
    gives no rows.
    """
    text = text_or_empty(text_col)
    names = [f"_repo{i}" for i in range(len(repo))]
    owners = [names[repo.index(c)] for c in owner]
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).alias(n) for c, n in zip(repo, names, strict=True)],
        base_spans(text).alias("base"),
        spans_of(text, BARE, "live", 20).alias("bare"),
    )
    clear = F.filter(
        F.col("bare"),
        lambda b: ~F.exists(F.col("base"), lambda x: (x["start"] < b["end"]) & (b["start"] < x["end"])),
    )

    def hashed(spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                F.sha2(x["value"], 256).alias("hash"),
                looks_random(x["kind"], x["value"]).alias("varied"),
            ),
        )

    rows = stage(
        found.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", *names,
            hashed(F.col("base")).alias("base"), hashed(clear).alias("bare"),
        ),
        "secrets",
    )
    candidates = rows.where((F.size("base") > 0) | (F.size("bare") > 0)).select(
        "_row", *names, F.explode(F.concat("base", "bare")).alias("c")
    ).select("_row", *names, "c.*")
    counts = ownership(candidates, names, owners).withColumnRenamed("hash", "_hash")
    classed = candidates.join(counts, F.col("hash") == F.col("_hash")).withColumn(
        "class",
        F.when(F.col("n_owners") >= example_owners, "example")
        .when((F.col("n_owners") == 1) & F.col("varied"), "live")
        .otherwise("shared"),
    )
    n_of = lambda c: F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}")
    live = (F.col("kind") == "live") & (F.col("class") == "live")
    per_row = classed.groupBy(F.col("_row").alias("_r")).agg(
        F.collect_list(F.when(live, F.struct("kind", "start", "end", "hash", "varied"))).alias("added"),
        n_of("example"), n_of("live"), n_of("shared"),
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,hash:string,varied:boolean>>")
    return rows.join(per_row, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", *[count(k) for k in KINDS], "base",
        F.coalesce("added", none).alias("added"),
        zero("n_example"), zero("n_live"), zero("n_shared"),
    )
