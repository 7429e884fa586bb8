"""Packs as JSON files: found in a folder, chosen by key or file name, and given to the same operators.

A folder is read with Spark, so it may lie in any store.  Packs are a handful of small files; their rows come to the
driver, where operators turn them into column expressions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.packs.patterns import usable
from procurelake.packs.rules import FairRule, Rule, Template

RULE = "struct<id:string,category:string,severity:string,detect:string,expect:string,auto_fixable:boolean,needs_review:boolean>"
KINDS = {
    "industry": "key string, name string, keywords array<string>, ord int",
    "fairness": "key string, rules array<struct<id:string,type:string,category:string,keywords:array<string>,patterns:array<string>>>",
    "template": f"key string, region string, city array<string>, industry array<string>, tender_type array<string>, level string, effective_from string, effective_to string, status string, supersedes array<string>, dialect string, rules array<{RULE}>",
}
#: The pack that is taken where nothing is chosen and one is needed.
DEFAULT_KEY = "water"


def read_packs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, and the fields of ``kind``) of all ``*.json`` files under a folder, one pack a file; a pack without a key has
    its file's name for one."""
    rows = spark.read.schema(KINDS[kind]).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    named = rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return named.withColumn("key", F.coalesce("key", "file"))


def choose(packs: DataFrame, wanted: str | None = None) -> DataFrame:
    """All packs for ``all``, those of a key or file name, or the default one; an error if there is none."""
    if wanted == "all":
        return packs
    name = (wanted or DEFAULT_KEY).removesuffix(".json")
    found = packs.where((F.col("key") == name) | (F.col("file") == name))
    if found.isEmpty():
        raise ValueError(f"no pack {name}")
    return found


def industries(packs: DataFrame) -> tuple:
    """Industry packs for ``detect_industry``, by ``ord``, then key."""
    rows = packs.select("name", "key", "keywords", "ord").orderBy(F.col("ord").asc_nulls_last(), "key").collect()
    return tuple((r.name, r.key, tuple(r.keywords or ())) for r in rows)


def fairness(packs: DataFrame) -> tuple[FairRule, ...]:
    """The rules of fairness packs for ``fairness_hits``, by pack and place."""
    return tuple(FairRule(x.id, x.type, x.category, tuple(x.keywords or ()), tuple(x.patterns or ())) for r in packs.orderBy("key").collect() for x in r.rules or ())


def templates(packs: DataFrame) -> tuple[Template, ...]:
    """Rule templates for ``choose_template``, ``match_template`` and ``validate``; ``expect`` is a JSON object.

    Patterns of text rules are Java's or, in a pack whose ``dialect`` is ``javascript``, translated.  An invalid one is left
    out; a rule with one that can't be decided is kept and gives a WARN finding, as does one whose ``expect`` is no object.
    """
    import json

    java = packs.sparkSession._jvm.java.util.regex.Pattern

    def compiles(pattern: str) -> bool | None:
        try:
            return not java.compile(pattern).matcher("").find()
        except Exception:  # noqa: BLE001 - what the JVM raises arrives as one kind of error
            return None

    def expected(detect: str, text: str | None, dialect: str | None) -> dict:
        try:
            found = json.loads(text or "{}")
        except ValueError:
            found = None
        if not isinstance(found, dict):
            return {"failed": "expect is no object"}
        if detect == "text.pattern":
            found["patterns"], failed = usable(list(found.get("patterns") or []), compiles, (dialect or "").lower() == "javascript")
            if failed:
                found["failed"] = failed
        return found

    day = lambda d: date.fromisoformat(d) if d else None
    scope = lambda s: tuple(s) if s else ("*",)
    rule = lambda x, dialect: Rule(x.id, x.category, x.severity, x.detect, expected(x.detect, x.expect, dialect), bool(x.auto_fixable), bool(x.needs_review))
    rows = packs.orderBy("key").collect()
    return tuple(Template(r.key, r.region or "*", scope(r.city), scope(r.industry), scope(r.tender_type), r.level or "", day(r.effective_from), day(r.effective_to), tuple(rule(x, r.dialect) for x in r.rules or ()), tuple(r.supersedes or ()), r.status or "ACTIVE") for r in rows)


def write_packs(spark: SparkSession, path: str, packs: dict[str, dict]) -> None:
    """Write packs, by file name, as JSON files that ``read_packs`` finds."""
    import json

    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, pack in packs.items():
        out = store.create(hadoop.Path(f"{path}/{name}.json"), True)
        out.write(bytearray(json.dumps(pack, ensure_ascii=False).encode()))
        out.close()


def as_json(template: Template) -> dict:
    """A template as the object that its file holds."""
    import json

    rules = [{"id": r.id, "category": r.category, "severity": r.severity, "detect": r.detect, "expect": json.dumps(r.expect, ensure_ascii=False), "auto_fixable": r.auto_fixable, "needs_review": r.needs_review} for r in template.rules]
    day = lambda d: d.isoformat() if d else None
    return {"key": template.id, "region": template.region, "city": template.city, "industry": template.industry, "tender_type": template.tender_type, "level": template.level, "effective_from": day(template.effective_from), "effective_to": day(template.effective_to), "status": template.status, "supersedes": template.supersedes, "rules": rules}
