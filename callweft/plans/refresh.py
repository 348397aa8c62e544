"""Edges of a workspace that changes: facts and edges are kept by file, and only what a change can reach is resolved again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweft.operators.hierarchy import closure
from callweft.plans.lineage import cut
from callweft.plans.resolve import Resolver
from callweft.sources import incremental
from callweft.sources.facts import DECLARATIONS, USES, Facts, StoredFacts

BUCKETS = 64
#: What a declaration is to other files; its place isn't.
SIGNATURES = {
    "types": ("class_lc", "name_lc", "kind", "extends", "implements", "annotations"),
    "methods": ("class_lc", "method_lc", "method", "is_ctor", "modifiers", "return_type", "param_names", "param_types"),
    "triggers": ("class_lc", "object_lc", "events"),
    "vars": ("class_lc", "name_lc", "type", "literal"),
}
WORD = r"[a-z_]\w*"


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


@dataclass(frozen=True)
class Refreshed:
    """The edges of the whole workspace, and how many files were parsed, cached, vanished and resolved again."""

    edges: DataFrame
    counts: DataFrame


class Snapshot:
    """A folder with the facts of every file, one row a fact, and the edges of every file, both in buckets of paths."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}").filter("path <> ''")

    def facts(self) -> DataFrame:
        return self._read("facts", "path string, kind string, row string, bucket int")

    def edges(self) -> DataFrame:
        return self._read("edges", "path string, row string, bucket int")

    def _write(self, name: str, kept: DataFrame, fresh: DataFrame, touched: DataFrame) -> None:
        """Rewrite the touched buckets: their kept rows and the fresh ones; an empty bucket keeps a row without a path."""
        rows = union(kept.join(F.broadcast(touched), "bucket", "left_semi").select(*kept.columns), bucketed(fresh).select(*kept.columns))
        empty = touched.select(*[F.col("bucket") if c == "bucket" else F.lit("").alias(c) for c in kept.columns])
        cut(union(rows, empty)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.base}/{name}")

    def refresh(self, files: DataFrame, prefixes: DataFrame | None = None, own_namespace: str | None = None) -> Refreshed:
        """Bring the snapshot up to ``files`` (path, text, mtime, size) and give the edges of all of them.

        A file is parsed where its time or size differs. Names of declarations that a parsed or vanished file has now
        and hadn't, or had and hasn't, are what other files can notice; files that hold such a name are resolved again
        (``noticed``), with all declarations but their own calls only. All others keep their edges.
        """
        listing = cut(files.select("path", "mtime", "size"))
        stored = self.facts()
        known = stored.filter("kind = 'file'").select("path", F.from_json("row", "mtime timestamp, size long").alias("r")).select("path", "r.mtime", "r.size")
        cached, parse = (cut(df.select("path")) for df in incremental.split_fresh(listing, known, ["path", "mtime", "size"]))
        gone = cut(incremental.vanished(listing, known, "path").select("path"))
        facts = Facts(files.join(parse, "path", "left_semi"))
        fresh = {name: getattr(facts, name) for name in (*DECLARATIONS, *USES)}
        words = facts.tokens.select("path", F.explode(F.regexp_extract_all("lw", F.lit(WORD), F.lit(0))).alias("w")).groupBy("path").agg(F.collect_set("w").alias("words"))
        long = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "path"])).alias("row"))
        rows = cut(union(*[long(df, name) for name, df in fresh.items()], long(words, "words"), long(listing.join(parse, "path", "left_semi"), "file")))
        stale = union(parse, gone).distinct()
        kept = stored.join(stale, "path", "left_anti")
        now = union(kept.select("path", "kind", "row"), rows)
        schemas = {name: df.drop("path").schema for name, df in fresh.items()} | {"words": words.drop("path").schema}
        table = lambda source, name: source.filter(F.col("kind") == name).select("path", F.from_json("row", schemas[name]).alias("r")).select("path", "r.*")
        tables = {name: cut(table(now, name)) for name in (*DECLARATIONS, *USES)}
        before = {name: table(stored.join(stale, "path", "left_semi"), name) for name in DECLARATIONS}
        after = {name: table(rows, name) for name in DECLARATIONS}
        changed = self._changed_names(before, after, tables)
        spoken = table(now, "words").select("path", F.explode("words").alias("w"))
        affected = cut(union(spoken.join(changed, "w", "left_semi").select("path"), parse).distinct())
        resolver = Resolver(StoredFacts(tables, listing.select("path"), affected), prefixes, own_namespace)
        edges = resolver.edges
        old = self.edges()
        still = old.join(union(affected, gone).distinct(), "path", "left_anti")
        new = edges.select("path", F.to_json(F.struct(*[c for c in edges.columns if c != "path"])).alias("row"))
        touched = lambda *paths: cut(bucketed(union(*paths)).select("bucket").distinct())
        self._write("facts", kept, rows, touched(parse, gone))
        self._write("edges", still, new, touched(affected, gone))
        schema = edges.drop("path").schema
        every = self.edges().select("path", F.from_json("row", schema).alias("r")).select("path", "r.*").select(*edges.columns)
        count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        return Refreshed(every, cut(union(count(parse, "parsed"), count(cached, "cached"), count(gone, "vanished"), count(affected, "resolved"))))

    def _changed_names(self, before: dict[str, DataFrame], after: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
        """(w): names that a file holds if a change of declarations can change its edges.

        Methods and fields by their names. A type also by the members of all types above and below it, and by the methods
        and fields that have it as their type; a trigger by its object and the variables that have it as their type.
        """
        fields = lambda t: t.filter("scope = 'field'")
        before, after, tables = ({**t, "vars": fields(t["vars"])} for t in (before, after, tables))

        def changed(name: str) -> DataFrame:
            sign = lambda t: t.select(F.to_json(F.struct(*SIGNATURES[name])).alias("s"), *SIGNATURES[name])
            old, new = sign(before[name]), sign(after[name])
            return union(old.join(new, "s", "left_anti"), new.join(old, "s", "left_anti"))

        simple = lambda c: F.lower(F.regexp_extract(c, r"(\w+)[^.\w]*$", 1))
        plain = F.regexp_replace(F.regexp_replace("method_lc", r"^\((?:get|set) |\)$", ""), "^<init>$", "")
        name_of = F.when(plain == "", F.element_at(F.split("class_lc", r"\."), -1)).otherwise(plain)
        types = cut(changed("types").select("name_lc", "extends", "implements"))
        ups = lambda t: t.select(F.col("name_lc").alias("child"), F.explode(F.concat("extends", "implements")).alias("p")).select("child", simple(F.regexp_replace("p", "<.*", "")).alias("parent"))
        closed = closure(union(ups(tables["types"]), ups(types)).filter("child <> parent"))
        own = types.select(F.col("name_lc").alias("n")).distinct()
        related = cut(union(own, closed.join(own, closed["child"] == own["n"]).select(F.col("ancestor").alias("n")), closed.join(own, closed["ancestor"] == own["n"]).select(F.col("child").alias("n"))).distinct())
        of_class = lambda t, w: t.select(F.element_at(F.split("class_lc", r"\."), -1).alias("n"), w.alias("w"))
        members = union(*[of_class(t["methods"], name_of) for t in (before, tables)], *[of_class(t["vars"], F.col("name_lc")) for t in (before, tables)])
        words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))).alias("n")
        having = union(
            tables["methods"].select(name_of.alias("w"), words(F.concat_ws(" ", "return_type", F.array_join("param_types", " ")))), tables["vars"].select(F.col("name_lc").alias("w"), words(F.col("type"))),
        )
        fired = changed("triggers").select(F.col("object_lc").alias("n")).distinct()
        return cut(union(
            related.select(F.col("n").alias("w")), fired.select(F.col("n").alias("w")), members.join(related, "n", "left_semi").select("w"), having.join(union(related, fired), "n", "left_semi").select("w"),
            changed("methods").select(name_of.alias("w")), changed("vars").select(F.col("name_lc").alias("w")), changed("triggers").select(F.col("class_lc").alias("w")),
        ).distinct())
