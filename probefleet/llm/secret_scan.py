"""Secret scans that tell copied examples from live credentials by corpus-wide ownership.

Native: DataFrame functions only. Fixed patterns find spans in each text; what they hold travels as a hash only. Hashes are
aggregated over all documents by distinct repositories and owners. A value that several owners have is an example that went
around; one that looks random and stays with an owner is taken for live. Long random-looking tokens that no fixed pattern
covers become spans of their own if they are live in this sense.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probefleet.llm.workspace import settled

#: A value of more owners than this is an example.
MOST_OWNERS = 2
#: Bits a character of a live value at least.
LEAST_ENTROPY = 3.0


@dataclass(frozen=True)
class Pattern:
    """A kind of span: leftmost matches that do not overlap; the value is a group of the pattern, of least characters."""

    kind: str
    regex: str
    group: int
    least: int


#: The kinds of the base rule, in their order. Runs of `AKIA..` and hex digits shorter than asked for are left out
#: by the pattern itself, as runs are matched whole.
BASE = (
    Pattern(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Pattern("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Pattern("hex", r"[0-9a-f]{24,}", 0, 24),
)
_RUN = r"[A-Za-z0-9+/_=-]"
#: Runs of 20 characters or more with a digit and a letter.
TOKEN = Pattern("owned", rf"(?<!{_RUN})(?={_RUN}*[0-9])(?={_RUN}*[A-Za-z]){_RUN}{{20,}}+", 0, 20)
PATTERNS = (*BASE, TOKEN)

#: Values with one of these are made up, whoever holds them.
_MADE_UP = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|abcdefg"


def entropy(value: Column) -> Column:
    """Entropy in bits of a text's characters."""
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    shares = F.transform(
        F.array_distinct(characters), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    )
    return -F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def _found(text: Column, number: int, pattern: Pattern) -> Column:
    """The matches in order as gap (characters since the match before), size and value; a last entry has no size."""

    def every(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(group))

    gaps, sizes = F.transform(F.split(text, pattern.regex, -1), F.length), F.transform(every(0), F.length)
    zipped = F.arrays_zip(gaps, sizes, every(pattern.group)).cast("array<struct<gap: int, size: int, value: string>>")
    details = F.transform(
        zipped,
        lambda m: F.struct(
            F.lit(number).alias("kind"),
            m["gap"].alias("gap"),
            m["size"].alias("size"),
            F.md5(m["value"]).alias("hash"),
            (F.length(m["value"]) >= pattern.least).alias("counts"),
            ((entropy(m["value"]) >= LEAST_ENTROPY) & ~m["value"].rlike(_MADE_UP)).alias("random"),
        ),
    )
    return F.when(text.rlike(pattern.regex), details).otherwise(F.slice(details, 1, 0))


def candidates(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """_row, doc_id, owner, repository and found (the matches of all patterns, kind by kind) of every row, written once.

    A null text has no matches. A null repository is the row itself, a null owner the repository.
    """
    rows = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("_owner"),
        F.col(repository).cast("string").alias("_repository"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    place = F.coalesce("_repository", F.concat(F.lit("row "), F.col("_row").cast("string")))
    holder = F.coalesce("_owner", F.concat(F.lit("of "), place))
    found = F.concat(*(_found(F.col("text"), i, p) for i, p in enumerate(PATTERNS)))
    return settled(
        rows.select("_row", "doc_id", holder.alias("owner"), place.alias("repository"), found.alias("found")),
        "secret-candidates",
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories and n_owners of every value that the candidates hold."""
    values = found.select("owner", "repository", F.explode("found").alias("m")).where("m.size is not null and m.counts")
    # Level by level, so that a value which all documents hold is added up where it lies.
    places = values.groupBy(F.col("m.hash").alias("hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("_n"))
    owners = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_repositories"))
    return owners.groupBy("hash").agg(F.sum("_repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def located(found: DataFrame, verdicts: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """The spans of each row: _row, kind (a number), start, end, n_repositories, n_owners and live; partitioned by _row.

    start and end count code points, end is exclusive. live: the value looks random and has at most most_owners owners. Spans of
    `owned` are live and no part of another span.
    """
    matches = found.select("_row", F.posexplode("found").alias("_at", "m")).where("m.size is not null")
    matches = matches.select("_row", "_at", "m.*").join(verdicts, "hash", "left").repartition("_row")
    upto = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("_row", "kind").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    live = F.col("random") & (F.col("n_owners") <= most_owners)
    spans = matches.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")).withColumn("live", live).where("counts")
    owned = F.col("kind") == len(BASE)
    # Base spans that start where a token starts come before it.
    covered = F.max(F.when(~owned, F.col("end"))).over(
        Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = spans.withColumn("_covered", F.coalesce(covered, F.lit(-1)))
    return spans.where(~owned | (F.col("live") & (F.col("_covered") < F.col("end")))).select(
        "_row", "kind", "start", "end", "n_repositories", "n_owners", "live"
    )


def scan_secrets(
    documents: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS
) -> DataFrame:
    """Every span: doc_id, kind, start, end, n_repositories, n_owners, live. Rows without spans give none."""
    found = candidates(documents, owner, repository)
    spans = located(found, ownership(found), most_owners)
    kinds = F.array(*(F.lit(p.kind) for p in PATTERNS))
    return spans.withColumn("kind", F.get(kinds, F.col("kind"))).join(found.select("_row", "doc_id"), "_row").drop("_row")


def secret_digest(
    documents: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS
) -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, all spans, n_live and n_copied of every row of documents.

    Spans are listed by start, then kind. n_live counts the spans with a live value, n_copied those whose value has more than
    most_owners owners. Rows with equal doc_ids stay apart. Other columns are not read.
    """
    found = candidates(documents, owner, repository)
    spans = located(found, ownership(found), most_owners)
    kinds = F.array(*(F.lit(p.kind) for p in PATTERNS))
    name = F.concat_ws(":", F.get(kinds, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string"))
    base = F.col("kind") < len(BASE)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: s["name"]), ",")

    entry = F.struct("start", "kind", name.alias("name"))
    digests = spans.groupBy("_row").agg(
        *(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{p.kind}") for i, p in enumerate(BASE)),
        listed(F.collect_list(F.when(base, entry))).alias("_base"),
        listed(F.collect_list(entry)).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("n_owners") > most_owners, 1)).alias("n_copied"),
    )
    numbers = [*(f"n_{p.kind}" for p in BASE), "n_live", "n_copied"]
    out = found.select("_row", "doc_id").join(digests, "_row", "left")
    return out.select(
        "doc_id",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers[:3]),
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers[3:]),
    )
