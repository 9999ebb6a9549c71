"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is named by the sha256 of its content, its blob. The ledger holds which rule versions each blob
was scanned with, and what they found. A run scans the blobs and rule versions that the ledger lacks, once a blob
however many paths hold it, adds them, and joins the findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.arrays import let, running
from sextant.llm.common import work_dir

SPAN = "struct<start:int,ord:int,kind:string,end:int>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are secrets if `keep` is null or matches them; needs: a literal that each holds."""

    kind: str
    pattern: str
    keep: str | None = None
    needs: str | None = None
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules' patterns, and the public formats of some issuers' tokens.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs="eyJ"),
)
BASE = ("assign", "access", "hex")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text, by start; places are code points, the end exclusive.

    A regular expression's matches and the stretches between them alternate, so their lengths, added up, give places.
    The sums are only folded for texts with a match.
    """
    wanted = F.rlike(text, F.lit(rule.pattern))
    if rule.needs:
        wanted = F.contains(text, F.lit(rule.needs)) & wanted
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("hit"))
    end = lambda at, pair: at + F.length(pair["gap"]) + F.coalesce(F.length(pair["hit"]), F.lit(0))

    def span(at: Column, pair: Column) -> Column:
        good = pair["hit"].isNotNull() if rule.keep is None else F.coalesce(F.rlike(pair["hit"], F.lit(rule.keep)), F.lit(False))
        return F.when(good, F.struct((at + F.length(pair["gap"])).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end(at, pair).alias("end")))

    found = F.filter(running(pairs, F.lit(0), end, span, SPAN), lambda s: s.isNotNull())
    return F.when(wanted, found).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", todo_col: str | None = None) -> DataFrame:
    """Adds `spans`, those of all rules (or of those whose tag is in todo_col) by start, then rule."""
    text = F.col(text_col)
    found = [spans_of(text, r, i) if todo_col is None else F.when(F.array_contains(todo_col, r.tag), spans_of(text, r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    return blobs.withColumn("spans", F.array_sort(F.concat(*found)))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> None:
    """Scan what the ledger (a folder) lacks and append it: rows (blob, rules, spans), one a blob and run.

    A folder without a finished file, as a run that broke off leaves it, is an empty ledger.
    """
    spark = versions.sparkSession
    tags = [r.tag for r in rules]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    todo = F.array(*map(F.lit, tags))
    if _exists(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(tags)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", todo)
    scan(blobs.dropDuplicates(["blob"]), rules, todo_col="todo").select("blob", F.col("todo").alias("rules"), "spans").write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The versions' rows and columns with `spans`, all findings of the given rule versions in each whole text.

    A null or empty text has none. Every path of a blob gets the blob's findings; repeated rows are answered each; an
    empty table gives an empty one. Columns are kept whatever their names, but one named as spans_col is replaced.
    ledger names a folder that later runs go on with; without one, a new one is made in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or work_dir(spark, "blob-ledger")
    update_ledger(versions, ledger, rules, text_col=text_col)
    kinds = [r.kind for r in rules]
    # Appended rows of one blob hold other rule versions each; those with a finding are few.
    hits = spark.read.schema(LEDGER).parquet(ledger).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"), "rules")
    current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.tag)))
    hits = hits.where(F.col("s.kind").isin(kinds) & F.array_contains(F.col("rules"), current[F.col("s.kind")]))
    by_blob = work_dir(spark, "blob-findings")
    hits.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("__spans")).write.parquet(by_blob)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blob, own = f"blob_{uuid.uuid4().hex}", f"spans_{uuid.uuid4().hex}"  # no column of the input has these names
    named = versions.drop(spans_col).withColumn(blob, F.unhex(F.sha2(text, 256)))
    joined = named.join(spark.read.parquet(by_blob).toDF(blob, own), blob, "left")
    return joined.withColumn(spans_col, F.coalesce(own, F.array().cast(SPANS))).drop(blob, own)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 1024) -> Column:
    """The text with every stretch that spans cover replaced by the mark; overlapping spans count as one.

    What stands between stretches is cut from blocks of the text, as a cut from the whole would walk to its place anew.
    """
    def between(blocks: Column, begin: Column, end: Column) -> Column:
        """Characters begin to end, or none."""
        first, last = F.floor(begin / block).cast("int"), F.floor((end - 1) / block).cast("int")

        def part(i: Column) -> Column:
            low = F.greatest(begin - i * block, F.lit(0))
            return F.substring(F.get(blocks, i), low + 1, F.least(end - i * block, F.lit(block)) - low)

        return F.when(end > begin, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))

    def cover(at: Column, s: Column) -> Column:
        return F.greatest(at, s["end"])

    def gap(at: Column, s: Column) -> Column:
        return F.struct(at.alias("begin"), s["start"].alias("end"))

    def whole(gaps: Column) -> Column:
        def put(blocks: Column) -> Column:
            # A span that begins inside the one before has no gap before it and adds no mark.
            parts = F.transform(F.filter(gaps, lambda g: g["end"] >= g["begin"]), lambda g: F.concat(between(blocks, g["begin"], g["end"]), F.lit(mark)))
            end = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(parts, ""), let(end, lambda e: between(blocks, e, F.length(text))))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), put)

    return F.when(F.size(spans) > 0, let(running(spans, F.lit(0), cover, gap, "struct<begin:int,end:int>"), whole)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of the base kinds' spans, and all spans as text."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
