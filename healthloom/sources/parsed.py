"""Fact tables: each file is parsed once, into rows of one table that typed views read.

``facts``: module, module_dir, module_ord, path, rel, n (order inside the file),
line, col, a struct for each kind of fact (``d_call`` and so on, null in rows of
other kinds), fact.  ``Facts.settle`` writes it by kind of fact, so a rule that
asks for calls reads the calls' files and their columns and nothing else.

Parsing is the one Python step; it runs in Arrow batches next to the scan, and
its JSON becomes structs once; everything after it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import by_value
from ..operators.checks import last_of
from ..session import gone, new_place
from . import other_facts, python_facts

by_value(__name__, other_facts.__name__, python_facts.__name__)

HEAD = "module string, module_dir string, module_ord int, path string, rel string"
#: Rows after which a batch of facts is passed on; those of one file stay together.
ROWS = 1000
PARSED = "fact string, n int, line int, col int, data string"

FIELD = "struct<name:string,type:string,comodel:string,compute:string,store:boolean,required:boolean,string:string,ondelete:string,line:int>"
METHOD = "struct<name:string,decorators:array<string>,depends:array<string>,supers:boolean,reads:array<string>,line:int>"
NAMED = "array<struct<name:string,line:int>>"
#: What each fact's JSON holds.
LAYOUTS = {
    "manifest": "version string, depends array<string>, data array<string>, installable boolean, assets array<struct<bundle:string,files:array<string>>>, filled array<string>, raw string",
    "model": f"name string, inherit array<string>, inherits array<string>, transient boolean, abstract boolean, fields array<{FIELD}>, methods array<{METHOD}>",
    "call": "name string, bare boolean, first_constant boolean, first_text boolean, orm_here boolean, orm boolean, in_loop boolean, risky boolean, everything boolean, limited boolean, excused boolean, tainted_sql boolean",
    "chain": "loop int",
    "controller": "name string, route string, auth string, sudo boolean",
    "suppression": "rule string",
    "record": "id string, tag string, model string, noupdate boolean, refs array<struct<ref:string,line:int>>",
    "access_domain": "id string, domain string",
    "view": f"id string, model string, parent string, fields {NAMED}, buttons {NAMED}",
    "unreadable": "reason string",
    "access": "id string, name string, model string, group string, read boolean, write boolean, create boolean, unlink boolean",
}


def parse_files(files: DataFrame, head: str = HEAD, mark: str | None = None) -> DataFrame:
    """``files`` (the columns of ``head``, kind, content) -> ``head`` and a row per fact, its data as JSON.

    ``mark``: a fact of that kind for each file besides, whatever is in it.
    """
    kept = [part.split()[0] for part in head.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        parsers = {
            "manifest": other_facts.manifest, "python": python_facts.facts, "xml": other_facts.xml, "access": other_facts.access,
        }
        kinds = [*(pa.int32() if part.endswith(" int") else pa.string() for part in head.split(", ")), pa.string(), *[pa.int32()] * 3, pa.string()]
        made = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*kept, "fact", "n", "line", "col", "data"])
        for batch in source:
            rows = []
            for k in range(batch.num_rows):
                f = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                own = [f[c] for c in kept]
                rows += [(*own, x["fact"], n, x["line"], x["col"], json.dumps(x["data"])) for n, x in enumerate(parsers[f["kind"]](f["content"]))]
                if mark:
                    rows.append((*own, mark, 0, 0, 0, None))
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    wanted = files.filter("kind != 'other' AND content IS NOT NULL").select(*kept, *({"kind"} - {*kept}), "content")
    return wanted.mapInArrow(run, f"{head}, {PARSED}")


def typed(rows: DataFrame) -> DataFrame:
    """Facts with a struct for each kind in place of JSON; ``fact`` comes last, as tables by kind have it."""
    data = [F.when(F.col("fact") == f, F.from_json("data", layout)).alias(f"d_{f}") for f, layout in LAYOUTS.items()]
    return rows.select(*[c for c in rows.columns if c not in ("data", "fact")], *data, "fact")


def write_by_fact(rows: DataFrame, path: str) -> None:
    """A folder for each kind of fact, in files of a good size."""
    rows.hint("rebalance", "fact").write.partitionBy("fact").parquet(path)


class Facts:
    """The fact tables of one project.

    ``files`` are read many times: persist or write them first.  ``facts`` are
    too: ``settle`` writes them by kind.  Tables that several rules share are
    kept as well (facts are a small part of the sources they come from, and kept
    blocks spill to disk).
    """

    def __init__(self, files: DataFrame, facts: DataFrame | None = None):
        self.kept: list[DataFrame] = []
        self.places: list[str] = []
        self.files = files
        self.facts = typed(parse_files(files)) if facts is None else facts

    def settle(self) -> Facts:
        """Facts are written to the shared folder by kind, until ``release``."""
        self.places.append(new_place(self.spark, "facts"))
        write_by_fact(self.facts, self.places[-1])
        self.facts = self.spark.read.schema(self.facts.schema).parquet(self.places[-1])
        return self

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` kept for several readers, until ``release``."""
        self.kept.append(df.persist())
        return df

    def release(self) -> None:
        """Gives up what is kept, in memory and in the shared folder; facts that were settled can't be read any more."""
        while self.kept:
            self.kept.pop().unpersist()
        while self.places:
            gone(self.spark, self.places.pop())

    @cached_property
    def unreadable(self) -> DataFrame:
        """path, reason of files whose contents or rows could not be read in full."""
        lost = self.files.filter("kind != 'other' AND content IS NULL").select("module", "path", F.lit("the file could not be opened").alias("reason"))
        return lost.unionByName(self.of("unreadable").select("module", "path", "reason"))

    def of(self, fact: str) -> DataFrame:
        return self.facts.filter(F.col("fact") == fact).select("module", "module_dir", "module_ord", "path", "rel", "n", "line", "col", f"d_{fact}.*")

    @cached_property
    def manifests(self) -> DataFrame:
        return self.of("manifest").filter("installable")

    @cached_property
    def data_files(self) -> DataFrame:
        """module, pos, file: the manifest's data list in order."""
        return self.manifests.select("module", "module_dir", F.posexplode("data").alias("pos", "file"))

    @cached_property
    def calls(self) -> DataFrame:
        return self.keep(self.of("call"))

    @cached_property
    def classes(self) -> DataFrame:
        """Model classes; ``key`` is the name, or for extensions the first inherited name."""
        key = F.coalesce("name", F.get("inherit", F.lit(0)))
        return self.of("model").withColumn("key", key)

    @cached_property
    def models(self) -> DataFrame:
        """One row per module and key: the first class tells name, kind and place; inherited names are joined."""
        first = F.struct("path", "n")
        named = F.min_by(F.struct("name", "transient", "abstract", "inherits", "path", "line"), first)
        every = F.array_sort(F.collect_list(F.struct("path", "n", "inherit")))
        rows = self.classes.filter("key IS NOT NULL").groupBy("module", "module_ord", "key").agg(named.alias("m"), every.alias("all"))
        inherit = F.array_distinct(F.flatten(F.transform("all", lambda c: c["inherit"])))
        return self.keep(rows.select("module", "module_ord", "key", "m.*", inherit.alias("inherit")))

    def _members(self, column: str) -> DataFrame:
        """Members by module, key and name; the last definition wins."""
        rows = self.classes.filter("key IS NOT NULL").select("module", "key", "path", "n", F.posexplode(column).alias("pos", "x"))
        rows = rows.withColumn("name", F.col("x.name"))
        return last_of(rows, ["module", "key", "name"], ["path", "x"], ["path", "n", "pos"])

    @cached_property
    def fields(self) -> DataFrame:
        return self.keep(self._members("fields").select("module", "key", "path", "x.*"))

    @cached_property
    def methods(self) -> DataFrame:
        return self.keep(self._members("methods").select("module", "key", "path", "x.*"))

    @cached_property
    def _loaded(self) -> DataFrame:
        """XML files that a manifest lists, with their place in it."""
        path = F.concat_ws("/", "module_dir", "file")
        return self.data_files.select(F.col("module").alias("l_module"), path.alias("l_path"), "pos")

    def _in_manifest(self, fact: str) -> DataFrame:
        rows = self.of(fact).join(self._loaded, (F.col("module") == F.col("l_module")) & (F.col("path") == F.col("l_path")))
        return rows.drop("l_module", "l_path")

    @cached_property
    def records(self) -> DataFrame:
        return self.keep(self._in_manifest("record").withColumn("xml_id", qualified(F.col("id"), F.col("module"))))

    @cached_property
    def views(self) -> DataFrame:
        return self.keep(self._in_manifest("view").withColumn("xml_id", qualified(F.col("id"), F.col("module"))))

    @cached_property
    def access_domains(self) -> DataFrame:
        return self._in_manifest("access_domain")

    @cached_property
    def access(self) -> DataFrame:
        rows = self.of("access").withColumn("dotted", F.col("model").contains("."))
        owner = F.when(F.col("dotted"), F.substring_index("model", ".", 1)).otherwise(F.col("module"))
        external = F.when(F.col("dotted"), F.expr("substring(model, instr(model, '.') + 1)")).otherwise(F.col("model"))
        return self.keep(rows.withColumns({"owner": owner, "external": external}))

    @cached_property
    def suppressions(self) -> DataFrame:
        return self.of("suppression").select("path", "line", "rule").distinct()

    @cached_property
    def lines(self) -> DataFrame:
        """path, line, text of Python files: split as Python's splitlines does, without the empty end."""
        text = F.expr("make_valid_utf8(cast(content AS string))")
        held = self.files.filter("kind = 'python'").select("module", "path", text.alias("t"))
        held = held.withColumn("parts", F.split("t", "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1))
        last = F.element_at("parts", -1) == ""
        parts = F.when(last, F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))
        return held.select("module", "path", F.posexplode(parts).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")


def qualified(name, module):
    return F.when(name.contains("."), name).otherwise(F.concat_ws(".", module, name))
