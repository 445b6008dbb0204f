"""Secret scan with corpus-wide ownership frequency, in DataFrame functions.

``scan`` finds credential-like spans in every whole text. Each candidate value
is hashed, and the hashes are aggregated over the corpus by distinct
repositories and owners: a value that many owners or many repositories have is
a copied example, a value of few is a live-looking credential. The same
frequencies decide over the weaker candidates that only the method adds: long
mixed tokens without a telling keyword, which become ``owned`` spans unless they
are copied.

A text's matches and the gaps between them become rows, and running sums over
them give the places, so a text of millions of matches costs no more a match
than a short one. A null text counts as empty. Rows are kept one for one,
repeated rows too. A null repository or owner counts as one value of its own.
Spans are code points, end exclusive. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, stash, whole_text

#: Kinds in the order in which equal starts are listed; the last one is added.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run of key characters, 24 or more (shorter ones are ordinary words).
RUN = r"[A-Za-z0-9+/_-]{24,}"
#: Values that more owners or more repositories than these have are widely copied examples.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4


_HITS = "array<struct<kind:int,i:int,gap:int,n:int,good:boolean,hash:bigint>>"


def _hits(kind: int, text: Column, pattern: str, group: int = 0, good=lambda whole, value: F.lit(True), where: str | None = None) -> Column:
    """The leftmost non-overlapping matches, with the gap before each; none where the text has no match for ``where``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("whole")))

    def hit(p: Column, i: Column) -> Column:
        value = F.regexp_extract(p["whole"], pattern, group) if group else p["whole"]
        parts = {"kind": F.lit(kind), "i": i, "gap": p["gap"], "n": F.length(p["whole"]), "good": good(p["whole"], value), "hash": F.xxhash64(value, F.length(value))}
        return F.struct(*[x.alias(name) for name, x in parts.items()])

    return F.when(text.rlike(where or pattern), F.transform(pairs, hit)).otherwise(F.array().cast(_HITS))


def candidates(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, repository, owner and all matches of each text, values hashed."""
    text = whole_text()
    mixed = lambda whole, value: whole.rlike("[0-9]") & whole.rlike("[A-Z]") & whole.rlike("[a-z]")
    parts = [
        _hits(0, text, ASSIGN, 1, lambda whole, value: F.length(value) >= 12, ASSIGN.replace("]+)", "]{12,})")),
        _hits(1, text, r"AKIA[A-Z0-9]{14,}"),
        _hits(2, text, r"[0-9a-f]{16,}"),
        _hits(3, text, RUN, good=mixed),
    ]
    return docs.select("doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.concat(*parts).alias("hits"))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """hash, repositories, owners, uses, copied: one row per candidate value.

    Distinct owners are made before they are counted, so a value that a third
    of all rows share reaches the last step as one row per owner and map task.
    """
    each = found.select("repository", "owner", F.explode(F.filter("hits", lambda h: h["good"])["hash"]).alias("hash"))
    pairs = stash(each.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n")), "owners")
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("uses"))
    repos = pairs.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repos, "hash").withColumn("copied", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))


def scan(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id and ``spans``, an array of (start, kind, end, owners, repositories, copied) by start, then kind.

    Base kinds stay whatever their frequency; an ``owned`` candidate stays
    unless it is copied or a base span of its document overlaps it.
    """
    found = stash(candidates(docs, repository, owner).select(F.monotonically_increasing_id().alias("row"), "*"), "secrets")
    known = stash(ownership(found, max_owners, max_repositories), "known")
    each = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").repartition("row")
    reach = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = each.select("row", "kind", "good", "hash", (reach - F.col("n")).cast("int").alias("start"), reach.cast("int").alias("end")).where("good")
    judged = join_hot(placed, known, ["hash"], "uses")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")))
    apart = (F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    stay = judged.withColumns({"before": before, "after": after}).where(base | ~F.col("copied") & apart)
    span = F.struct("start", "kind", "end", "owners", "repositories", "copied")
    out = stay.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("kept"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,copied:boolean>>")
    return found.select("row", "doc_id").join(out, "row", "left").select("doc_id", F.coalesce("kept", none).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
