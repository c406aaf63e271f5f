"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Spans come from regular expressions. ``split`` gives the text between the matches and ``regexp_extract_all`` the
matches, so running sums of their lengths (in code points) are the places. Three kinds are always reported: ``assign``
(a name such as password with its value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).

The method adds ``owned`` spans: long mixed runs of letters and digits that no base span covers. All candidate values
of the corpus are hashed and counted by distinct repositories and owners. A value that few owners use is specific to
them and looks live; one that many owners share is an example that was copied around. Only specific ``owned`` candidates
become spans; base spans stay and are told apart by ``n_live`` and ``n_shared``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import store

# Fixed patterns of the base kinds, with the group that holds the value and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
# Same matches as the pattern above once short ones are dropped: a run of hexadecimal digits is matched as a whole.
QUICK = {"hex": r"([0-9a-f]{24,})", "access": r"(AKIA[A-Z0-9]{16,})"}
OWNED = r"([A-Za-z0-9_-]{32,})"   # kept where it has a letter and a digit
SPAN = "kind string, place int, start long, end long, value string"


def spans(text: Column, kind: str) -> Column:
    """Array of ``(kind, place, start, end, value)`` of one kind, in order; ``end`` is exclusive."""
    pattern, group, least = (OWNED, 1, 32) if kind == "owned" else KINDS[kind]
    pattern = QUICK.get(kind, pattern)
    place = [*KINDS, "owned"].index(kind)
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group != 1 else whole
    gaps = F.split(text, pattern, -1)
    # One pass: the state carries the place behind the last match and the spans so far.
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<struct<{_fields()}>>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        start = acc["at"] + F.char_length(item["gap"])
        end = start + F.char_length(item["whole"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), start.alias("start"), end.alias("end"), item["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(item["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    items = F.zip_with(F.zip_with(whole, values, lambda a, b: F.struct(a.alias("whole"), b.alias("value"))), F.slice(gaps, 1, F.size(whole)),
                       lambda m, gap: F.struct(gap.alias("gap"), m["whole"].alias("whole"), m["value"].alias("value")))
    found = F.aggregate(items, state, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast(f"array<struct<{_fields()}>>"))


def _fields() -> str:
    return ", ".join("{}: {}".format(*f.split()) for f in SPAN.split(", "))


def _joined(items: Column) -> Column:
    ordered = F.array_sort(F.transform(items, lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"])))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def candidates(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """``doc_id, repository, owner, row, base, owned`` per row; ``row`` tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
                       F.col(owner).cast("string").alias("owner"), text.alias("text"))
    rows = rows.select("doc_id", "repository", "owner", F.sha2("text", 256).alias("row"),
                       F.concat(*(spans(F.col("text"), kind) for kind in KINDS)).alias("base"), spans(F.col("text"), "owned").alias("owned"))
    hidden = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["place"].alias("place"), s["start"].alias("start"),
                                                         s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    mixed = lambda c: F.regexp_like(c["value"], F.lit("[0-9]")) & F.regexp_like(c["value"], F.lit("[A-Za-z]"))
    return rows.withColumn("owned", F.filter("owned", lambda c: mixed(c) & ~hidden(c))).withColumn("base", hashed(F.col("base"))).withColumn("owned", hashed(F.col("owned")))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, repositories, owners, texts, uses`` over all candidates; a null repository or owner counts as one of its own.

    ``texts`` are the different texts that hold the value. What is counted is made distinct first, so a value that a third of all rows
    hold is summed in every task before it moves.
    """
    each = found.select("repository", "owner", "row", F.explode(F.concat("base", "owned")).alias("c")).select(
        F.col("c.hash").alias("hash"), F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), "row")
    one = each.groupBy("hash", "repository", "owner", "row").agg(F.count("*").alias("uses"))
    return one.groupBy("hash").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"),
                                   F.countDistinct("row").alias("texts"), F.sum("uses").alias("uses"))


def scan_secrets(docs: DataFrame, repository: str = "source", owner: str = "source", most_owners: int = 2, most_repositories: int = 2,
                 most_texts: int = 8) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, ``base_sha256``, ``spans``, ``n_owned``, ``n_live``, ``n_shared``.

    A value counts as live when at most ``most_owners`` owners, ``most_repositories`` repositories and ``most_texts`` different texts hold it, so
    an example that is copied around inside one source is seen too. Null text is empty: no spans, the hash of an empty
    string. Texts are scanned whole, whatever their length. Repeated rows are repeated in the result and are one text; an empty table gives none.
    """
    found = store(candidates(docs, repository, owner), "candidates")
    known = ownership(found)
    some = found.where((F.size("base") > 0) | (F.size("owned") > 0)).select("doc_id", "row", F.explode(F.concat("base", "owned")).alias("c")).distinct()
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories) & (F.col("texts") <= most_texts)
    judged = (some.select("doc_id", "row", "c", F.col("c.hash").alias("hash")).join(known, "hash").withColumn("live", live)
              .groupBy("doc_id", "row").agg(
                  F.collect_set(F.when(F.col("live") & (F.col("c.kind") == "owned"), F.struct("c.kind", "c.place", "c.start", "c.end"))).alias("kept"),
                  F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_shared")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    keys = F.col("f.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("f.row") == F.col("j.row"))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end")))
    kept = F.coalesce("kept", F.array().cast("array<struct<kind: string, place: int, start: bigint, end: bigint>>"))
    return found.alias("f").join(judged.alias("j"), keys, "left").select(
        "f.doc_id", *(n(kind) for kind in KINDS), F.sha2(_joined(slim(F.col("base"))), 256).alias("base_sha256"),
        _joined(F.concat(slim(F.col("base")), kept)).alias("spans"), F.size(kept).cast("long").alias("n_owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
