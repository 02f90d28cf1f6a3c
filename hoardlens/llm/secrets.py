"""Secret scanning over a ledger of content-addressed blobs, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize


@dataclass(frozen=True)
class Rule:
    """A pattern; of its matches those count whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The kinds, in the order in which spans that start together are listed.
RULES = (
    Rule(
        "assign",
        1,
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
SPANS = "array<struct<start:bigint,end:bigint>>"


def find_spans(text: Column, rule: Rule) -> Column:
    """Matches of a rule, leftmost first and without overlap, as code-point ranges.

    The text between matches and the matches themselves take turns, so their lengths give the
    places. Runs too short for a rule of one class are left out in the pattern already; that
    cannot uncover another match, since a run is taken whole or not at all.
    """
    pattern = rule.pattern
    if rule.group == 0:
        head = pattern[: pattern.rindex("[")]
        pattern = f"{pattern.removesuffix('+')}{{{rule.least - len(head)},}}"
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(hits)),
        hits,
        lambda gap, hit: F.struct(
            F.char_length(gap).cast("bigint").alias("gap"),
            F.char_length(hit).cast("bigint").alias("hit"),
            (
                F.lit(True)
                if rule.group == 0
                else F.char_length(F.regexp_extract(hit, pattern, rule.group)) >= rule.least
            ).alias("long"),
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def add(state, step):
        begin = state["at"] + step["gap"]
        end = begin + step["hit"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(step["long"], F.concat(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    found = F.aggregate(steps, start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(
    docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules=RULES
) -> DataFrame:
    """New ledger rows ``blob, kind, version, spans`` for pairs of blob and rule not yet in ``ledger``.

    A blob is a text known by its SHA-256; copies, however many, are combined before the
    shuffle and scanned once. ``spans`` is empty for a clean blob, so that it is not scanned
    again. Null texts are the empty blob.
    """
    blobs = docs.select(
        blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content")
    ).distinct()
    if ledger is not None:
        done = ledger.groupBy("blob").agg(
            F.collect_set(F.concat_ws("@", "kind", F.col("version").cast("string"))).alias("done")
        )
        blobs = blobs.join(done, "blob", "left")
    else:
        blobs = blobs.withColumn("done", F.expr("cast(array() as array<string>)"))
    done = F.coalesce("done", F.expr("cast(array() as array<string>)"))
    rows = [
        F.when(
            ~F.array_contains(done, f"{rule.kind}@{rule.version}"),
            F.struct(
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.version).alias("version"),
                find_spans(F.col("content"), rule).alias("spans"),
            ),
        )
        for rule in rules
    ]
    scanned = blobs.select("blob", F.explode(F.array(*rows)).alias("row")).where("row IS NOT NULL")
    return scanned.select("blob", "row.kind", "row.version", "row.spans")


def find_secrets(
    docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules=RULES
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``secrets`` and the new ledger rows.

    ``secrets`` lists ``start, end, kind`` by start, then in the order of the rules. Findings of
    earlier and new scans at the rules' versions are joined back to every row that holds the
    blob, the most frequent blobs by broadcast, so copies do not meet in one task. Rows without
    findings, and null or empty texts, get an empty list; repeated rows stay; an empty table
    gives an empty result. Other columns pass through untouched.
    """
    fresh = materialize(scan_unseen(docs, ledger, text, rules), "ledger")
    known = fresh
    if ledger is not None:
        known = known.unionByName(ledger.select("blob", "kind", "version", "spans"))
    place = {rule.kind: i for i, rule in enumerate(rules)}
    wanted = F.array(*[F.lit(f"{rule.kind}@{rule.version}") for rule in rules])
    order = F.element_at(
        F.create_map(*[x for kind, i in place.items() for x in (F.lit(kind), F.lit(i))]), F.col("kind")
    )
    hits = (
        known.where(F.size("spans") > 0)
        .where(F.array_contains(wanted, F.concat_ws("@", "kind", F.col("version").cast("string"))))
        .withColumn("order", order)
        .select(
            "blob",
            F.transform(
                "spans",
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.col("order").alias("order"),
                    s["end"].alias("end"),
                    F.col("kind").alias("kind"),
                ),
            ).alias("spans"),
        )
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    held = plain.withColumn("blob", blob_id(F.col(f"c{names.index(text)}")))
    counts = held.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    keyed = hits.join(counts, "blob")
    spread = held.withColumn("salt", F.monotonically_increasing_id())
    joined = join_keyed(spread, keyed, "blob", "copies", "salt").drop("blob", "salt")
    simple = F.transform(
        F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint,kind:string>>)")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    out = joined.withColumn("secrets", simple).drop("found")
    return out.toDF(*names, "secrets"), fresh


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts per kind, and all spans as text, of every document."""
    # Only the id and the blob's name travel to the join, not the text.
    found = _named_secrets(docs)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    listed = F.array_join(
        F.transform(
            "secrets",
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in RULES],
        F.sha2(listed, 256).alias("base_sha256"),
        listed.alias("spans"),
    )


def _named_secrets(docs: DataFrame) -> DataFrame:
    found, _ = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "secrets")


def _places(kind: str, pattern: str, least: int) -> str:
    """SQL for the spans of one kind of one document, as a list of structs."""
    hits = f"regexp_extract_all(body, '{pattern}')"
    gaps = f"regexp_split_to_array(body, '{pattern}')"
    value = (
        "len(regexp_extract(h[i], '^.*?[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)$', 1))" if kind == "assign" else "len(h[i])"
    )
    return f"""
    SELECT doc_id, '{kind}' AS kind, s AS start, s + len(h[i]) AS stop
    FROM (SELECT doc_id, h, i, {value} AS size,
                 list_sum(list_transform(g[1:i], lambda x: len(x)))
                 + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0) AS s
          FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i
                FROM (SELECT doc_id, {hits} AS h, {gaps} AS g FROM bodies)))
    WHERE size >= {least}"""


_KEYS = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
ORACLE = f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({_places("assign", _KEYS + '["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+', 6)}
    UNION ALL {_places("access", "AKIA[A-Z0-9]+", 20)}
    UNION ALL {_places("hex", "[0-9a-f]+", 24)}),
listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ','
                      ORDER BY start, list_position(['assign', 'access', 'hex'], kind)) AS spans
    FROM found GROUP BY doc_id)
SELECT b.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM bodies b LEFT JOIN listed USING (doc_id)
"""
