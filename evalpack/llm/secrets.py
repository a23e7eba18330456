"""Secrets in texts, with multipart credential linking. DataFrame operations only.

Certain kinds (assignments, access key ids, long hex) are reported wherever they
occur. Weak candidates are reported only next to their complement: parts have a
role (identifier, secret or endpoint), and an interval join links each weak part
with parts of another role that lie within ``SCOPE`` characters of it in the
same document. A weak identifier or endpoint needs a secret, a weak secret
needs an identifier or endpoint. Places are joined by buckets of the scope's
length, so a long document is many small groups.

Spans are in code points, end exclusive. A place is the sum of the lengths of
the pieces and matches before it, as a running sum over a text's matches.

Defined results: a null or empty text has no spans (the digest is that of the
empty string); repeated rows are reported each; equal starts are ordered by
kind as listed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, read, stored

SCOPE = 400

#: Kinds as listed: pattern, the test a match must pass, its role, whether it stands alone.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None, "secret", True),
    "access": (r"AKIA[A-Z0-9]+", r"^.{16,}$", "identifier", True),
    "hex": (r"[0-9a-f]{32,}", None, "secret", True),
    "opaque": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?!AKIA)", "secret", False),
    "identifier": (r"""(?i:client_?id|account_?id|access_?key_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""",
                   None, "identifier", False),
    "endpoint": (r"""(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", None, "endpoint", False),
}
#: What an assignment must hold behind its sign.
_ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""


def _found(kind: str, body: str) -> Column:
    """The matches of a kind: array of (kind, nth, piece before, match), lengths in code points."""
    pattern = F.lit(KINDS[kind][0])
    matches, pieces = F.regexp_extract_all(body, pattern, F.lit(0)), F.split(F.col(body), KINDS[kind][0], -1)
    rows = F.transform(F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p")), lambda x, i: F.struct(
        F.lit(list(KINDS).index(kind)).alias("kind"), i.alias("nth"), F.length(x["p"]).cast("long").alias("before"),
        F.length(x["m"]).cast("long").alias("size"), x["m"].alias("match")))
    return F.when(F.col(body).rlike(KINDS[kind][0]), rows)


def parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind (number), start, end, role, alone of every match that passes its test;
    a text without any has one row with a null kind."""
    rows = columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("body"), F.monotonically_increasing_id().alias("row"))
    found = F.concat(*[F.coalesce(_found(k, "body"), F.array()) for k in KINDS])
    each = rows.select("row", "doc_id", F.explode_outer(found).alias("x")).select("row", "doc_id", "x.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("before") + F.col("size")).over(upto))
    kept, role, alone = F.lit(True), F.lit(None).cast("string"), F.lit(False)
    for i, (name, (_, test, what, sure)) in enumerate(KINDS.items()):
        test = _ASSIGNED if name == "assign" else test
        here = F.col("kind") == i
        if test:
            kept = F.when(here, F.col("match").rlike(test)).otherwise(kept)
        role, alone = F.when(here, what).otherwise(role), F.when(here, sure).otherwise(alone)
    # A match that fails counts for the places of those behind it and is dropped only then.
    return each.select("row", "doc_id", F.when(kept, F.col("kind")).alias("kind"),
                       (F.col("end") - F.col("size")).alias("start"), "end", role.alias("role"), alone.alias("alone"))


def linked(weak: DataFrame, every: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with a complementary part within ``scope`` characters (interval join).

    A part is entered under the buckets that it touches and the weak part under
    those it can reach, so a part of any length meets all within its scope."""
    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("bucket")

    left = weak.select("*", buckets(F.col("start") - scope, F.col("end") + scope))
    right = every.select(F.col("row").alias("r_row"), F.col("start").alias("r_start"), F.col("end").alias("r_end"),
                         F.col("role").alias("r_role"), buckets(F.col("start"), F.col("end")).alias("r_bucket"))
    near = ((F.col("row") == F.col("r_row")) & (F.col("bucket") == F.col("r_bucket"))
            & (F.col("r_start") <= F.col("end") + scope) & (F.col("r_end") >= F.col("start") - scope)
            & (F.col("role") != F.col("r_role")) & ((F.col("role") == "secret") | (F.col("r_role") == "secret")))
    return left.join(right, near, "left_semi").drop("bucket").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, doc_id, kind (number), start, end of all reported spans; a text without any has one row of nulls."""
    every = stored(parts(docs), "parts")
    real = every.where("kind IS NOT NULL")
    weak = linked(real.where("NOT alone"), real, scope)
    names = ("row", "doc_id", "kind", "start", "end")
    sure = every.withColumn("kind", F.when(F.col("alone"), F.col("kind")))
    return sure.select(*names).union(weak.select(*names))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    spans = scan(read(spark, sf_dir, "documents"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    text = F.concat_ws(":", name, F.col("start"), F.col("end"))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", text.alias("text")))
    rows = spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("spans", keep), lambda x: x["text"]), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(joined(lambda x: x["kind"] < 3), 256).alias("base_sha256"),
                       joined(lambda x: F.lit(True)).alias("spans"))
