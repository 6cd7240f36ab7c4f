"""Secret scans with an incremental ledger.

Every historical version of a file is addressed by the hash of its content. The ledger holds which blob was scanned by
which version of which rule, and what was found; a run scans only pairs that it lacks, appends them, and findings are
joined back to every path that ever held the blob. The ledger is a folder of its own that outlives a run: a run that
fails appends nothing or pairs that are right, and a pair that stands there twice counts once.

Defined cases: a null text is read as empty; null paths and repeated rows each keep their row; an empty table gives an
empty table; other columns are ignored. Copies of a text are scanned once, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import spans
from tenderglow.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; ``least`` is the shortest value of group ``group`` (0: the whole match) that counts.

    ``needs`` are texts one of which stands in every text with a match. ``base`` rules are listed first.
    """

    name: str
    pattern: str
    version: int = 1
    least: int = 0
    group: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The rules. A minimal length inside a pattern equals dropping shorter matches where one run is one match.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
         least=12, group=1, needs=("=", ":"), base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}+", needs=("AKIA",), base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs=("-----BEGIN",)),
    Rule("hub_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}", needs=("gh",)),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,255}", needs=("xox",)),
    Rule("map_key", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}", needs=("AIza",)),
    Rule("pay_key", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[0-9A-Za-z]{16,255}", needs=("_live_", "_test_")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs=("eyJ",)),
    Rule("url_login", r"(?<![a-z])[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", needs=("://",)),
)

LEDGER = "blob_id string, rule string, found array<struct<start:int,end:int,value:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scan(text: Column, rule: Rule) -> Column:
    guard = None
    for need in rule.needs:
        test = F.contains(text, F.lit(need))
        guard = test if guard is None else guard | test
    found = spans.find(text, rule.pattern, guard)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], f"^{rule.pattern}", rule.group)) >= rule.least)
    return found


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with a pair that the ledger lacks: ``blob_id``, its text, the rules to run.

    Which row of a blob brings the text is settled on hashes and ids; only then is a text moved, once.
    """
    keyed = versions.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce("path", F.lit("")).alias("path"),
                            F.coalesce("text", F.lit("")).alias("text"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    blobs = keyed.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob_id", "left").select(
            "blob_id", "path", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        todo = todo.where(F.size("todo") > 0)
    return keyed.join(todo, ["blob_id", "path"])


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the unseen (blob, rule version) pairs of ``versions`` (path, text).

    A pair without findings is recorded too, so that it is not scanned again.
    """
    new = unseen(versions, ledger, rules)
    runs = F.array(*(F.struct(F.lit(r.key).alias("rule"),
                              F.when(F.array_contains("todo", r.key), _scan(F.col("text"), r)).alias("found")) for r in rules))
    rows = new.select("blob_id", F.explode(F.filter(runs, lambda x: x["found"].isNotNull())).alias("run"))
    return rows.select("blob_id", "run.rule", "run.found").dropDuplicates(["blob_id", "rule"])


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (any columns with ``blob_id``) with the array ``secrets`` of all spans of the current rule versions, by start."""
    order = {r.key: i for i, r in enumerate(rules)}
    ranked = F.create_map(*(F.lit(x) for k, i in order.items() for x in (k, i)))
    base = F.array(*(F.lit(r.key) for r in rules if r.base))
    hits = ledger.where(F.col("rule").isin(*order) & (F.size("found") > 0)).select("blob_id", "rule", F.explode("found").alias("s"))
    by_blob = hits.groupBy("blob_id").agg(F.sort_array(F.collect_set(F.struct(
        F.col("s.start").alias("start"), ranked[F.col("rule")].alias("rank"), F.col("s.end").alias("end"),
        F.substring_index("rule", "@", 1).alias("kind"), F.array_contains(base, F.col("rule")).alias("base"),
        F.col("s.value").alias("value")))).alias("secrets"))
    empty = F.array().cast(by_blob.schema["secrets"].dataType)
    return paths.join(by_blob, "blob_id", "left").withColumn("secrets", F.coalesce("secrets", empty))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans ``docs`` (doc_id, text) against the ledger: per document its secrets, and the ledger to keep for the next run."""
    versions = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    fresh = cut_lineage(scan(versions, ledger, rules))
    kept = fresh if ledger is None else ledger.select("blob_id", "rule", "found").unionByName(fresh)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob_id"))
    return findings(paths, kept, rules), kept


def load(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger stored at ``path`` lacks of ``docs`` (doc_id, text) and appends it; per document its secrets.

    A folder that does not exist yet is an empty ledger.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    versions = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    scan(versions, spark.read.schema(LEDGER).parquet(path), rules).write.mode("append").parquet(path)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob_id"))
    return findings(paths, spark.read.schema(LEDGER).parquet(path), rules)


def load_in_turn(loads: list[DataFrame], path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Loads that arrive one after the other, each scanned for what those before it did not hold; secrets of the last."""
    found = None
    for docs in loads:
        found = load(docs, path, rules)
    if found is None:
        raise ValueError("no loads")
    return found


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the base spans, and the list of all spans."""
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.name) for r in RULES if r.base),
                        F.sha2(spans.listed(base), 256).alias("base_sha256"), spans.listed(F.col("secrets")).alias("spans"))
