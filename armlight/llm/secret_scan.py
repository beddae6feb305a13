"""Secret scans that link the parts of a credential.

Base kinds (assign, access, hex) are reported wherever they match. Weak kinds are only candidates: a key is a run of
mixed characters without a name, a user is a login name, an endpoint is a URL or host with a port. A candidate is
reported if complementary parts lie within ``SCOPE`` code points of it in the same text: for a key an identifier
(access, user) or an endpoint, for a user a secret (assign, hex, key), for an endpoint an identifier and a secret.
Candidates are joined with parts by text and interval: each part is in one bin of ``SCOPE`` code points, each candidate
asks the bins that its scope touches. A bin holds at most ``SCOPE`` parts, so a text full of secrets is no hot key.

Equal texts share their spans. Everything is built from DataFrame functions: the text between two matches is what a
split by the pattern leaves, so positions are sums of lengths.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from armlight.llm.columns import whole_text
from armlight.sources.files import stage

SCOPE = 400
# fixed: the base kinds of the contract, in the order in which spans of one start are listed
BASE = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "key": r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}",
    "user": r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""",
    # runs are taken whole and start nowhere else, so no match is tried twice and nothing recurses
    "endpoint": (
        r"(?:(?<![A-Za-z0-9+])[a-z][a-z0-9+]*+://[A-Za-z0-9_.:@-]+"
        r"|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*+:[0-9]+)"
    ),
}
KINDS = [*BASE, *WEAK]
# for each weak kind the sets of kinds of which one part each must be near
COMPLEMENTS = {
    "key": [["access", "user", "endpoint"]],
    "user": [["assign", "hex", "key"]],
    "endpoint": [["access", "user"], ["assign", "hex", "key"]],
}
LEAST_VALUE = 6


def _matches(kind: str):
    """Array of (between, length, value): code points since the last match, of the match, and of an assigned value."""
    pattern = F.lit((BASE | WEAK)[kind])
    text = F.col("text")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
    zipped = F.arrays_zip(
        F.split(text, (BASE | WEAK)[kind], -1).alias("between"), whole.alias("found"), value.alias("value")
    )
    found = F.transform(
        F.filter(zipped, lambda m: m["found"].isNotNull()),
        lambda m: F.struct(
            F.length(m["between"]).alias("between"), F.length(m["found"]).alias("length"), F.length(m["value"]).alias("value")
        ),
    )
    return F.when(text.rlike((BASE | WEAK)[kind]), found)


def text_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, kind, start, end of every match in the distinct texts of ``docs``, weak candidates included."""
    texts = docs.select(F.unhex(F.sha2(whole_text(text), 256)).alias("text_key"), whole_text(text).alias("text"))
    per_kind = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), _matches(k).alias("m")) for i, k in enumerate(KINDS)]
    found = texts.select(
        "text_key", F.filter(F.array(*per_kind), lambda x: F.size(x["m"]) > 0).alias("kinds")
    ).where(F.size("kinds") > 0)
    found = found.dropDuplicates(["text_key"])
    rows = (
        found.select("text_key", F.explode("kinds").alias("k"))
        .select("text_key", "k.kind", "k.rank", F.posexplode("k.m").alias("nth", "m"))
    )
    so_far = W.partitionBy("text_key", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("m.between") + F.col("m.length")).over(so_far))
    least = F.when(F.col("kind") == "assign", F.col("m.value") >= LEAST_VALUE).otherwise(True)
    return ends.where(least).select("text_key", "kind", "rank", (F.col("end") - F.col("m.length")).alias("start"), "end")


def linked(parts: DataFrame) -> DataFrame:
    """The base parts, and the weak ones that complementary parts lie near."""
    bins = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))
    out = parts.where(F.col("kind").isin(list(BASE)))
    placed = parts.select(
        F.col("text_key").alias("p_key"), F.col("kind").alias("p_kind"), F.col("start").alias("p_start"),
        F.col("end").alias("p_end"), F.floor(F.col("start") / SCOPE).alias("p_bin"),
    )
    # a part is in the bin of its start; a candidate whose scope only meets its end would miss it, so long parts are in all their bins
    placed = placed.withColumn("p_bin", F.explode(F.sequence(F.col("p_bin"), F.floor(F.col("p_end") / SCOPE))))
    asked = parts.where(F.col("kind").isin(list(WEAK))).withColumn("bin", F.explode(bins))
    near = (
        (F.col("text_key") == F.col("p_key")) & (F.col("bin") == F.col("p_bin"))
        & (F.col("p_start") <= F.col("end") + SCOPE) & (F.col("p_end") >= F.col("start") - SCOPE)
        & ((F.col("p_start") >= F.col("end")) | (F.col("p_end") <= F.col("start")))
    )
    for kind, needed in COMPLEMENTS.items():
        found = asked.where(F.col("kind") == kind)
        columns = ["text_key", "kind", "rank", "start", "end"]
        for one_of in needed:
            met = found.join(placed.where(F.col("p_kind").isin(one_of)), near, "left_semi").select(columns).distinct()
            found = met.withColumn("bin", F.explode(bins))
        out = out.unionByName(met)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``spans`` (kind, start, end), ``base_spans``, n_assign, n_access and n_hex.

    Positions are code points, ends exclusive; spans are ordered by start, then kind. Null and empty texts have none.
    Equal texts have equal spans, whatever their ids; rows that repeat an id are scanned each. Existing columns of
    these names are replaced.
    """
    parts = stage(text_parts(docs, text), "credential-parts")
    spans = (
        linked(parts).groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("_spans"))
    )
    spans = stage(spans, "credential-spans")
    new = ["spans", "base_spans", *(f"n_{k}" for k in BASE)]
    kept = docs.select(*[c for c in docs.columns if c not in new])
    # columns are named through the two sides, so those of ``docs`` may have any names
    here = F.unhex(F.sha2(whole_text(f"row.`{text}`"), 256)) == F.col("found.text_key")
    joined = kept.alias("row").join(spans.alias("found"), here, "left")
    found = F.coalesce("found._spans", F.array().cast(spans.schema["_spans"].dataType))
    plain = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.filter(plain, lambda s: s["kind"].isin(list(BASE)))

    def count(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return joined.select("row.*", plain.alias("spans"), base.alias("base_spans"), *map(count, BASE))


def span_text(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; spans that overlap are replaced as one."""
    found = scan(docs, text=text)
    # the code points before a span that no earlier span covers, then the mark; spans inside earlier ones add nothing
    steps = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(F.col(text), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark)))
            .alias("out"),
        ),
    )
    rest = F.concat(steps["out"], F.substring(F.col(text), steps["at"].cast("int") + 1, F.length(text)))
    return found.withColumn(text, F.when(F.size("spans") > 0, rest).otherwise(F.col(text))).select(*docs.columns)
