"""Secret scans with an incremental blob ledger, in DataFrame expressions only.

Every text version is addressed by its SHA-256.  The ledger has one row for
each blob, rule and rule version that was scanned, with the spans found; a
scan reads only the pairs that the ledger lacks, each blob once however many
paths hold it, and findings are joined back to every path by the address.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmend.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` of a match must have ``least`` characters; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the scan finds beside the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("login", r"://[^\s/:@]+:([^\s/:@]+)@", 1, 3),
    Rule("prefixed", r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|pk)[_-][A-Za-z0-9_-]+", 0, 20, version=2),
)
RULES = BASE_RULES + MORE_RULES
#: The rules before the last change: fewer prefixes.
EARLIER_RULES = RULES[:-1] + (Rule("prefixed", r"\b(?:ghp|gho|ghs)_[A-Za-z0-9]+", 0, 20),)

LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def _quick(rule: Rule) -> str:
    """A pattern without which the rule finds nothing; fails faster on most texts."""
    if rule.kind == "hex":
        return r"[0-9a-f]{%d}" % rule.least
    if rule.kind == "access":
        return r"AKIA[A-Z0-9]{%d}" % (rule.least - 4)
    return rule.pattern


def _parts(rule: Rule, text: Column) -> Column:
    """Array of ``(before, size, good)``: characters before each match, its length, whether it counts."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    group = whole if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    zipped = F.arrays_zip(between.alias("before"), whole.alias("size"), group.alias("group"))
    return F.transform(zipped, lambda x: F.struct(
        x["before"].alias("before"), F.coalesce(x["size"], F.lit(0)).alias("size"),
        F.coalesce(x["group"] >= rule.least, F.lit(False)).alias("good")))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Ledger rows (``LEDGER``) of the blobs of ``texts`` not scanned yet.

    A pair of blob and rule counts as scanned if ``ledger`` has it with the
    rule's version or a later one.  Matches of a rule are leftmost and do not
    overlap; those whose group is too short are dropped after matching.
    Positions are code points, ends exclusive.  Pairs without a finding get a
    row with no spans.  Null texts are empty texts.  Only texts in which a
    rule may find something are moved; of the others the address goes alone.
    """
    text = text_of(text_col)
    likely = reduce(lambda a, b: a | b, [text.rlike(_quick(r)) for r in rules], F.lit(False))
    blobs = texts.select(F.sha2(text, 256).alias("blob"), F.when(likely, text).alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        due = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", F.transform(wanted, lambda x: x["rule"]))
    else:
        known = ledger.select("blob", "rule", F.col("version").alias("have"))
        pairs = blobs.select("blob").distinct().select("blob", F.inline(wanted))
        left = pairs.join(known, (pairs["blob"] == known["blob"]) & (pairs["rule"] == known["rule"])
                          & (known["have"] >= pairs["version"]), "left_anti")
        todo = left.groupBy("blob").agg(F.collect_set("rule").alias("due"))
        due = blobs.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    # The blob's rules that find anything, as rows; texts go no further than here.
    nothing = F.array().cast("array<struct<before:int,size:int,good:boolean>>")
    per_rule = F.array(*[F.struct(
        F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.array_contains("due", r.kind).alias("due"),
        F.when(F.array_contains("due", r.kind) & F.coalesce(F.col("text").rlike(_quick(r)), F.lit(False)), _parts(r, F.col("text"))).otherwise(nothing).alias("parts"))
        for r in rules])
    rows = due.select("blob", F.explode(per_rule).alias("r")).where("r.due").select("blob", "r.rule", "r.version", "r.parts")
    each = rows.select("blob", "rule", "version", F.posexplode_outer("parts").alias("pos", "p"))
    # A running sum gives positions in one pass, however many matches a text has.
    upto = F.sum(F.col("p.before") + F.col("p.size")).over(
        Window.partitionBy("blob", "rule", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.select("blob", "rule", "version", F.col("p.good").alias("good"), (upto - F.col("p.size")).alias("start"), upto.alias("end"))
    found = F.when(F.col("good"), F.struct("start", "end"))
    return spans.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(found)).alias("spans"))


def _by_blob(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, spans)`` of the blobs with findings; spans ``(start, kind_no, kind, end)`` in ascending order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    # The highest version counts that scan() takes as done, also one later than the rule's.
    latest = ledger.where(F.col("version") >= current[F.col("rule")]).groupBy("blob", "rule").agg(
        F.max_by("spans", "version").alias("spans"))
    hits = latest.where(F.size("spans") > 0)
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("kind_no"),
                                                  F.col("rule").alias("kind"), s["end"].alias("end")))
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("spans"))


def findings(texts: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(<id_col>, blob, spans)`` for every row of ``texts``: what the ledger holds of its blob.

    ``spans`` are structs ``(start, kind_no, kind, end)`` in ascending order.
    Repeated rows and null ids stay; null texts are empty.  Other columns are
    not read.
    """
    paths = texts.select(F.col(id_col), F.sha2(text_of(text_col), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return paths.join(_by_blob(ledger, rules), "blob", "left").select(id_col, "blob", F.coalesce("spans", none).alias("spans"))


_PIECE = 4096  # code points of a piece


def masked(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]",
           text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, each span (overlapping ones as one) replaced by ``mask``.

    Texts without findings, null texts among them, stay as they are.
    """
    each = _by_blob(ledger, rules).select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    in_order = Window.partitionBy("blob").orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("start") < reached, 0).otherwise(1)
    runs = each.withColumn("apart", apart).withColumn("run", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")).withColumnRenamed("blob", "_blob")
    joined = docs.withColumn("_blob", F.sha2(text_of(text_col), 256)).join(merged, "_blob", "left")
    # A position is found within a piece of bounded size, so a long text with many spans is not walked through for each.
    joined = joined.withColumn("_pieces", F.when(F.col("_spans").isNotNull(), F.regexp_extract_all(
        F.col(text_col), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def piece(i):
        return F.coalesce(F.get("_pieces", i), F.lit(""))

    def between(begin, end):
        a, z = (F.floor(x / _PIECE).cast("int") for x in (begin, end))
        inside = F.substring(piece(a), (begin % _PIECE + 1).cast("int"), (end - begin).cast("int"))
        across = F.concat(F.substring(piece(a), (begin % _PIECE + 1).cast("int"), F.lit(_PIECE)),
                          F.array_join(F.slice("_pieces", a + 2, z - a - 1), ""), F.substring(piece(z), F.lit(1), (end % _PIECE).cast("int")))
        return F.when(a == z, inside).otherwise(across)

    cuts = F.concat(F.col("_spans"), F.array(F.struct(F.length(text_col).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))))
    parts = F.transform(cuts, lambda s, i: between(F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0).cast("long")), s["start"]))
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.array_join(parts, mask))
    return joined.withColumn(text_col, text).select(*docs.columns)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans and all spans as text."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    is_base = F.filter("spans", lambda s: s["kind_no"] < len(base))
    return found.select(id_col, *[count(r.kind).alias(f"n_{r.kind}") for r in base],
                        F.sha2(span_text(is_base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
