"""Resolution of symbols in layers: what the project defines, stubs, a source index, then *unknown*.

An answer is one of found, not_found, local_not_found and unknown.  Absence is
told only where it can be proved; an outer join's null never becomes
``not_found`` by itself, it goes through ``CASE``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables

# Fields of every model, owners of common models, modules that are always there.
MAGIC_FIELDS = ["id", "display_name", "create_uid", "create_date", "write_uid", "write_date", "__last_update"]
OWNERS = {
    "sale.order": "sale",
    "sale.order.line": "sale",
    "purchase.order": "purchase",
    "stock.picking": "stock",
    "account.move": "account",
    "product.template": "product",
    "product.product": "product",
    "mail.thread": "mail",
}
ALWAYS = ["base", "ir", "res"]

FOUND, NOT_FOUND, LOCAL_NOT_FOUND, UNKNOWN = "found", "not_found", "local_not_found", "unknown"


def prioritised(asked: DataFrame, layers: list[DataFrame], keys: list[str], source: str = "source") -> DataFrame:
    """``asked`` with the value of the first layer that has its keys (null if none does).

    The layers are one union with a priority, reduced by ``min_by``, and met by
    a single left join.  Each layer has the keys and ``source``.
    """
    union = None
    for k, layer in enumerate(layers):
        part = layer.select(*keys, F.col("source").alias("_s"), F.lit(k).alias("_p"))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(*keys).agg(F.min_by("_s", "_p").alias(source))
    return asked.join(best, keys, "left")


#: Rows from which a key is joined by itself.
MANY = 100_000


def met_evenly(rows: DataFrame, told: DataFrame, key: str, tables: Tables) -> DataFrame:
    """``rows`` left-joined with ``told``, which has a key once.

    All that hang on one model share its key, and a shuffle would bring them to one task.  Keys of more than ``MANY``
    rows, of which there are at most rows / ``MANY``, stay where they are and meet what is told of them by broadcast.
    """
    hot = tables.put(rows.groupBy(key).count().filter(F.col("count") > MANY).select(key))
    if not hot.take(1):
        return rows.join(told, key, "left")
    of_hot = tables.put(told.join(F.broadcast(hot), key, "left_semi"))
    # null keys meet nothing
    apart = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_semi").join(F.broadcast(of_hot), key, "left")
    rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(told, key, "left")
    none = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in told.schema if f.name != key])
    return apart.unionByName(rest).unionByName(none)


def chain_heads(steps: DataFrame, tables: Tables) -> DataFrame:
    """node, head of every node with one parent: the first node above it that has none or several; null on a cycle.

    ``steps``: node, parent.  Pointer jumping: a round doubles how far each node sees, so a chain of n takes log2(n)
    rounds of n rows, and no pair of a node and an ancestor is made but the last.  A round in which no node comes to
    its head leaves cycles only.
    """
    single = steps.groupBy("node").agg(F.min("parent").alias("head"), F.count("*").alias("n")).filter("n = 1")
    heads, before = tables.put(single.select("node", "head", F.lit(True).alias("open"))), None
    while True:
        onward = heads.select(F.col("node").alias("head"), F.col("head").alias("further"))
        # who has come to the head stays there
        moved = met_evenly(heads.filter("open").drop("open"), onward, "head", tables)
        moved = moved.select("node", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("open"))
        heads = tables.put(heads.filter("NOT open").unionByName(moved))
        count = heads.filter("open").count()
        if count in (0, before):
            return heads.select("node", F.when(~F.col("open"), F.col("head")).alias("head"))
        before = count


def forked_in_vain(forks: DataFrame, fine: DataFrame, tables: Tables) -> DataFrame:
    """root: nodes of ``forks`` that reach some node twice, or one that is not fine.

    ``forks``: root, node, with a row per parent, chains contracted; null is a cycle.  ``fine``: node, fine of nodes
    without parents; of others nothing is known.  Semi-naive: only what the last round found is followed, and what
    is judged already is followed no more, nor is what has met it.
    """
    roots = tables.put(forks.select("root").distinct())
    about = roots.select(F.col("root").alias("node"), F.lit(True).alias("forks")).join(fine, "node", "full")
    known = met_evenly(forks, about, "node", tables)
    forks = tables.put(known.select("root", "node", F.coalesce("forks", F.lit(False)).alias("forks"), F.coalesce("fine", F.lit(False)).alias("fine")))
    seen, front = roots.select("root", F.col("root").alias("node")), roots.select("root", F.col("root").alias("node"))
    bad = roots.filter("false")
    while True:
        onward = forks.select(F.col("root").alias("node"), F.col("node").alias("further"), "forks", "fine")
        found = tables.put(front.join(onward, "node").groupBy("root", F.col("further").alias("node"), "forks", "fine").agg(F.count("*").alias("n")))
        again = found.join(seen, ["root", "node"], "left_semi")
        fault = found.filter("node IS NULL OR n > 1 OR NOT forks AND NOT fine").select("root").unionByName(again.select("root"))
        seen = tables.put(seen.unionByName(found.select("root", "node")))
        bad = tables.put(bad.unionByName(fault).distinct())
        while True:  # what has met a bad one is bad
            met = seen.join(bad.select(F.col("root").alias("node")), "node", "left_semi").select("root").distinct()
            more = tables.put(met.join(bad, "root", "left_anti"))
            if not more.take(1):
                break
            bad = tables.put(bad.unionByName(more))
        seen = seen.join(bad, "root", "left_anti")
        front = found.filter("forks").select("root", "node").join(bad, "root", "left_anti")
        if not front.take(1):
            return bad


def complete_models(edges: DataFrame, leaves: DataFrame, tables: Tables | None = None) -> DataFrame:
    """model, complete: whether everything that a model has is known.

    ``edges``: model, parent of every model that the project defines (parent
    null if it has none; a model's own name as a parent is passed over).
    ``leaves``: model, complete of models that are only known from outside.
    A model is complete if the walk to all of its ancestors meets none twice
    and every one is defined here or complete outside.

    Chains are contracted first: a model with one parent is as complete as the
    head of its chain, and two walks that meet on a chain meet at its head.  So
    only models with several parents are followed, from head to head.
    ``tables``: where the steps are written; the result is read from there.
    """
    tables = tables or Tables(edges.sparkSession, "models")
    edges = tables.put(edges.select("model", "parent"))
    own = tables.put(edges.select(F.col("model").alias("node")).distinct())
    steps = tables.put(edges.filter("parent IS NOT NULL AND parent != model").select(F.col("model").alias("node"), "parent"))
    outside = leaves.select("model", "complete").join(own, F.col("model") == F.col("node"), "left_anti")
    bare = own.join(steps, "node", "left_anti").select("node", F.lit(True).alias("fine"))
    fine = tables.put(bare.unionByName(outside.select(F.col("model").alias("node"), F.col("complete").alias("fine"))))
    if not steps.take(1):  # nothing is inherited
        return fine.select(F.col("node").alias("model"), F.col("fine").alias("complete"))
    heads = chain_heads(steps, tables)
    ends = heads.select(F.col("node").alias("parent"), "head", F.lit(True).alias("chained"))
    several = steps.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    forks = met_evenly(tables.put(steps.join(several, "node", "left_semi")), ends, "parent", tables)
    forks = tables.put(forks.select(F.col("node").alias("root"), F.when(F.col("chained"), F.col("head")).otherwise(F.col("parent")).alias("node")))
    bad = forked_in_vain(forks, fine, tables) if forks.take(1) else forks.select("root")
    sound = forks.select("root").distinct().join(bad, "root", "left_anti").select(F.col("root").alias("node"), F.lit(True).alias("fine"))
    status = tables.put(fine.unionByName(sound).select(F.col("node").alias("end"), "fine"))
    ended = own.join(heads.withColumn("chained", F.lit(True)), "node", "left")
    ended = ended.select("node", F.when(F.col("chained"), F.col("head")).otherwise(F.col("node")).alias("end"))
    here = met_evenly(tables.put(ended), status, "end", tables).select(F.col("node").alias("model"), F.coalesce("fine", F.lit(False)).alias("complete"))
    return tables.put(here.unionByName(outside.select("model", "complete")))


@dataclass
class Stubs:
    """What is known of the framework: models (model, complete), members (model, kind, name), xml_ids (xml_id).

    ``lost``: model, last, now of models that earlier versions had (see ``symbols``), if that is known.
    """

    models: DataFrame
    members: DataFrame
    xml_ids: DataFrame
    lost: DataFrame | None = None


def no_stubs(spark: SparkSession) -> Stubs:
    return Stubs(
        spark.createDataFrame([], "model string, complete boolean"),
        spark.createDataFrame([], "model string, kind string, name string"),
        spark.createDataFrame([], "xml_id string"),
    )


STUB_JSON = "version string, complete boolean, models map<string,struct<fields:array<string>,methods:array<string>>>, xml_ids map<string,string>"


def read_stubs(spark: SparkSession, path: str) -> Stubs:
    """One stub file: {version, complete, models: {name: {fields, methods}}, xml_ids: {id: model}}."""
    raw = spark.read.schema(STUB_JSON).option("multiLine", True).json(path)
    models = raw.select(F.explode("models").alias("model", "m"), F.coalesce("complete", F.lit(False)).alias("complete"))
    names = lambda kind: models.select("model", F.lit(kind[:-1]).alias("kind"), F.explode(f"m.{kind}").alias("name"))
    return Stubs(
        models.select("model", "complete"),
        names("fields").unionByName(names("methods")),
        raw.select(F.explode("xml_ids").alias("xml_id", "of")).select("xml_id"),
    )


def stubs_for(spark: SparkSession, folder: str | None, version: str) -> Stubs:
    """The stub file of a version, else of its major version; a store of versions, if the folder is one; else nothing."""
    import os

    from . import symbols

    if folder and symbols.versions(spark, folder):
        return symbols.load(spark, folder, version)
    for name in (version, version.split(".")[0] + ".0") if folder else ():
        path = os.path.join(folder, f"{name}.json")
        if os.path.exists(path):
            return read_stubs(spark, path)
    return no_stubs(spark)


def build_stubs(facts, version: str, complete: bool = True) -> DataFrame:
    """One row of stub JSON (as in ``read_stubs``) from a parsed source tree."""
    members = lambda kind: facts.classes.filter("key IS NOT NULL").select("key", F.explode(kind).alias("x")).groupBy("key").agg(
        F.array_sort(F.collect_set("x.name")).alias(kind)
    )
    every = facts.classes.filter("key IS NOT NULL").select("key").distinct()
    rows = every.join(members("fields"), "key", "left").join(members("methods"), "key", "left")
    none = F.array().cast("array<string>")
    entry = F.struct(F.coalesce("fields", none).alias("fields"), F.coalesce("methods", none).alias("methods"))
    models = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry.alias("v"))))).alias("models"))
    ids = facts.of("record").select(
        F.when(F.col("id").contains("."), F.col("id")).otherwise(F.concat_ws(".", "module", "id")).alias("id"), F.coalesce("model", F.lit("")).alias("m")
    )
    ids = ids.groupBy("id").agg(F.min("m").alias("m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "m")))).alias("xml_ids"))
    whole = models.crossJoin(ids)  # one row each
    return whole.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(complete).alias("complete"), "models", "xml_ids")).alias("value"))


class Resolver:
    """Layers of one project.  ``facts``: its fact tables; ``index``: model, module of another source tree."""

    def __init__(self, facts, stubs: Stubs, index: DataFrame | None = None):
        spark = facts.spark
        self.facts, self.stubs = facts, stubs
        self.index = index if index is not None else spark.createDataFrame([], "model string, module string")
        named = facts.models.filter("name IS NOT NULL")
        # of a model that several modules define, the last one counts
        last = F.max_by(F.struct("module", "inherit", "inherits"), "module_ord")
        self.repo = named.groupBy(F.col("key").alias("model")).agg(last.alias("m")).select("model", "m.*")
        self.repo = facts.keep(self.repo)
        winners = self.repo.select("model", "module")
        extensions = facts.models.filter("name IS NULL").select("module", "key")

        def members(rows: DataFrame, kind: str) -> DataFrame:
            own = rows.join(winners, (rows.key == winners.model) & (rows.module == winners.module)).select("model", "name")
            more = rows.join(extensions, ["module", "key"], "left_semi").select(F.col("key").alias("model"), "name")
            return own.unionByName(more).distinct().select("model", F.lit(kind).alias("kind"), "name")

        repo = members(facts.fields, "field").unionByName(members(facts.methods, "method"))
        self.members = facts.keep(repo.withColumn("source", F.lit("repo")))
        self.xml_ids = facts.keep(facts.records.select("xml_id").distinct())

    def models(self, asked: DataFrame, column: str) -> DataFrame:
        """``status`` and ``source`` of the model named in ``column``."""
        layer = lambda df, name: df.select(F.col("model").alias(column), F.lit(name).alias("source")).distinct()
        layers = [layer(self.repo, "repo"), layer(self.stubs.models, "stub"), layer(self.index, "source_path")]
        out = prioritised(asked, layers, [column])
        return out.withColumn("status", F.when(F.col("source").isNotNull(), FOUND).otherwise(UNKNOWN))

    def owners(self, asked: DataFrame, column: str) -> DataFrame:
        """``owner``: the module that a model belongs to, or null."""
        fixed = asked.sparkSession.createDataFrame(list(OWNERS.items()), f"{column} string, source string")
        layer = lambda df: df.select(F.col("model").alias(column), F.col("module").alias("source"))
        return prioritised(asked, [layer(self.repo), layer(self.index), fixed], [column], "owner")

    @cached_property
    def completeness(self) -> DataFrame:
        parents = F.concat("inherit", "inherits")
        edges = self.repo.select("model", F.explode_outer(parents).alias("parent"))
        tables = Tables(self.facts.spark, "models")
        self.facts.places.append(tables.folder)
        return complete_models(edges, self.stubs.models.groupBy("model").agg(F.max("complete").alias("complete")), tables)

    def member(self, asked: DataFrame, kind: str) -> DataFrame:
        """``status`` of (model, name) pairs: project, injected fields, stubs, then provable absence."""
        stub = self.stubs.members.withColumn("source", F.lit("stub"))
        layers = [x.filter(F.col("kind") == kind).select("model", "name", "source") for x in (self.members, stub)]
        out = prioritised(asked, layers, ["model", "name"])
        magic = F.col("name").isin(MAGIC_FIELDS) if kind == "field" else F.lit(False)
        done = self.completeness
        return out.join(done, "model", "left").withColumn(
            "status",
            F.when(F.col("source").isNotNull() | magic, FOUND).when(F.coalesce("complete", F.lit(False)), NOT_FOUND).otherwise(UNKNOWN),
        )

    def xml(self, asked: DataFrame, column: str, module: str = "module") -> DataFrame:
        """``status`` of qualified ids, seen from a module: what it owns and lacks is provably absent."""
        known = self.xml_ids.unionByName(self.stubs.xml_ids).distinct().select(F.col("xml_id").alias(column), F.lit("known").alias("source"))
        own = ~F.col(column).contains(".") | (F.substring_index(column, ".", 1) == F.col(module))
        status = F.when(F.col("source").isNotNull(), FOUND).when(own, LOCAL_NOT_FOUND).otherwise(UNKNOWN)
        return asked.join(known, column, "left").withColumn("status", status)

    def known_modules(self) -> DataFrame:
        """Modules that anything is known of."""
        spark = self.repo.sparkSession
        fixed = spark.createDataFrame([(m,) for m in sorted({*ALWAYS, *OWNERS.values()})], "module string")
        prefix = lambda df: df.filter(F.col("xml_id").contains(".")).select(F.substring_index("xml_id", ".", 1).alias("module"))
        return fixed.unionByName(self.repo.select("module")).unionByName(prefix(self.xml_ids)).unionByName(prefix(self.stubs.xml_ids)).distinct()
