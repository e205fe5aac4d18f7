"""Imports, module graphs and class relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import table
from .hierarchy import plain_name


def imports(files: DataFrame) -> DataFrame:
    """(file_id, project_id, file_path, pos, source, line): one row per import of a file."""
    return files.select(F.col("id").alias("file_id"), "project_id", "file_path", F.posexplode("dependencies.imports").alias("pos", "x")).select(
        "file_id", "project_id", "file_path", "pos", F.col("x.source").alias("source"), F.col("x.line").alias("line")
    )


def _grams(text: str, sizes: Column) -> Column:
    """The distinct substrings of ``text`` of each of ``sizes``."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substr(F.col(text), i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, one)))


def file_dependencies(files: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Every import with the file of its project whose path contains the module's: the smallest path, or null.

    The module's dots count as slashes. A substring has no key of its own, so each distinct module meets the project's
    paths by the rarest of its three-character substrings (a shorter module by itself), which every path that contains
    it must hold, and only those are compared: no project is multiplied out.
    """
    got = imports(files).where("source is not null and source <> ''").withColumn("module", F.translate("source", ".", "/"))
    paths = files.where("file_path is not null and project_id is not null").select("project_id", F.col("id").alias("target_id"), F.col("file_path").alias("target_path"))
    held = paths.select("*", F.explode(_grams("target_path", F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("gram"))
    often = held.groupBy("project_id", "gram").agg(F.count(F.lit(1)).alias("often"))
    modules = got.select("project_id", "module").distinct()
    asked = modules.select("project_id", "module", F.explode(_grams("module", F.array(F.least(F.lit(3), F.length("module"))))).alias("gram"))
    rarest = asked.join(often, ["project_id", "gram"], "left").groupBy("project_id", "module").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(held, ["project_id", "gram"]).where(F.col("target_path").contains(F.col("module")))
    keys = ["project_id", "module"]
    if exclude_self:
        met = met.join(got.select("project_id", "module", "file_id").distinct(), keys).where("file_id <> target_id")
        keys.append("file_id")
    best = met.groupBy(*keys).agg(F.min(F.struct("target_path", "target_id")).alias("x"))
    out = got.join(best, keys, "left")
    return out.select("file_id", "project_id", "file_path", "pos", "source", "line", F.col("x.target_id").alias("target_id"), F.col("x.target_path").alias("target_path"))


def file_importers(files: DataFrame) -> DataFrame:
    """(file_id, importer_id, pos, source): imports that name a file, by its dotted path or its base name or below them.

    Each import's source is cut at its dots into all leading parts, each file gives its two names, and both meet by
    equality within the project. An import counts once for a file.
    """
    stem = F.regexp_replace("file_path", r"\.[^./]+$", "")
    named = files.select(F.col("id").alias("file_id"), "project_id", F.explode(F.array_distinct(F.array(F.translate(stem, "/", "."), F.substring_index(stem, "/", -1)))).alias("name")).where("name <> ''")
    got = imports(files).where("source is not null and source <> ''")
    parts = F.split("source", r"\.")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    used = got.select(F.col("file_id").alias("importer_id"), "project_id", "pos", "source", F.explode(F.array_distinct(leading)).alias("name"))
    return used.join(named, ["project_id", "name"]).where("file_id <> importer_id").select("file_id", "importer_id", "pos", "source").distinct()


def module_of(path: str) -> Column:
    """The first folder of a path, ``.`` for a file at the root."""
    return F.when(F.col(path).contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def module_graph(files: DataFrame) -> DataFrame:
    """(project_id, source, target, imports): imports between different modules of a project."""
    got = file_dependencies(files, exclude_self=True).where("target_path is not null")
    edge = got.select("project_id", module_of("file_path").alias("source"), module_of("target_path").alias("target")).where("source <> target")
    return edge.groupBy("project_id", "source", "target").agg(F.count(F.lit(1)).alias("imports"))


def modules(files: DataFrame) -> DataFrame:
    """(project_id, module, files)."""
    return files.groupBy("project_id", module_of("file_path").alias("module")).agg(F.count(F.lit(1)).alias("files"))


def class_relationships(classes: DataFrame) -> DataFrame:
    """(source_class_id, target_class_name, relationship_type, context_line) from the listed bases (EXTENDS) and interfaces (IMPLEMENTS).

    Names lose blanks, type arguments and qualifiers; blank ones drop out; an edge listed twice counts once, with its least line.
    """
    parts = []
    for column, kind in (("base_classes", "EXTENDS"), ("interfaces", "IMPLEMENTS")):
        parts.append(classes.select(F.col("id").alias("source_class_id"), F.explode(column).alias("x"), F.lit(kind).alias("relationship_type")))
    both = parts[0].union(parts[1]).select("source_class_id", plain_name(F.col("x.name")).alias("target_class_name"), "relationship_type", F.col("x.line").alias("line"))
    return both.where("target_class_name is not null and target_class_name <> ''").groupBy("source_class_id", "target_class_name", "relationship_type").agg(F.min("line").alias("context_line"))


def class_hierarchy(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(class_id, relation, name, other_id): one level around every class.

    parent: a listed base, with the class of that name in the project (smallest id) or null; interface: a listed
    interface, not resolved; child: a class anywhere that lists the class's name as a base.
    """
    edge = class_relationships(classes)
    placed = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "file_id").join(files.select(F.col("id").alias("file_id"), "project_id"), "file_id", "left")
    known = placed.groupBy("project_id", F.col("class_name").alias("name")).agg(F.min("class_id").alias("other_id"))
    own = edge.select(F.col("source_class_id").alias("class_id"), F.col("target_class_name").alias("name"), "relationship_type").join(placed.select("class_id", "project_id"), "class_id")
    up = own.where("relationship_type = 'EXTENDS'").join(known, ["project_id", "name"], "left").select("class_id", F.lit("parent").alias("relation"), "name", "other_id")
    faces = own.where("relationship_type = 'IMPLEMENTS'").select("class_id", F.lit("interface"), "name", F.lit(None).cast("long"))
    kids = edge.where("relationship_type = 'EXTENDS'").select(F.col("source_class_id").alias("other_id"), F.col("target_class_name").alias("class_name"))
    kids = kids.join(placed.select("class_id", "class_name"), "class_name").join(classes.select(F.col("id").alias("other_id"), "name"), "other_id").select("class_id", F.lit("child"), "name", "other_id")
    return up.union(faces).union(kids)


def subclasses(classes: DataFrame, files: DataFrame, project_id: int | None = None) -> DataFrame:
    """(parent_name, class_id, class_name, file_path, relationship_type): who lists a name, for every name."""
    fl = files.select(F.col("id").alias("file_id"), "file_path", "project_id")
    fl = fl if project_id is None else fl.where(F.col("project_id") == project_id)
    cl = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "file_id").join(fl, "file_id")
    edge = class_relationships(classes).select(F.col("source_class_id").alias("class_id"), F.col("target_class_name").alias("parent_name"), "relationship_type")
    return edge.join(cl, "class_id").select("parent_name", "class_id", "class_name", "file_path", "relationship_type")


BIN = 64


def _bins(start: str, end: str) -> Column:
    """The bins of ``BIN`` lines that a range of lines touches; none for an empty or unknown one."""
    lo, hi = F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN)
    return F.when(F.col(start) <= F.col(end), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def class_methods(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(class_id, function_id): functions named ``Class.`` something, else, for a class without such, those within its lines.

    Names meet by equality of the part before the first dot, lines by bins, each within the file.
    """
    cl = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "file_id", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    fn = functions.select(F.col("id").alias("function_id"), "name", "file_id", "start_line", "end_line")
    lead = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\.")) - 1), lambda n: F.array_join(F.slice(F.split("name", r"\."), F.lit(1), n), "."))).alias("class_name")
    named = cl.select("class_id", "class_name", "file_id").join(fn.where(F.col("name").contains(".")).select("function_id", "file_id", lead), ["file_id", "class_name"]).select("class_id", "function_id").distinct()
    spans = cl.select("class_id", "file_id", "cs", "ce", F.explode(_bins("cs", "ce")).alias("bin"))
    inside = fn.withColumn("bin", F.floor(F.col("start_line") / BIN)).join(spans, ["file_id", "bin"]).where("start_line >= cs and end_line <= ce").select("class_id", "function_id")
    return named.union(inside.join(named.select("class_id").distinct(), "class_id", "left_anti"))


def enclosing_classes(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(function_id, class_id): the innermost class of the file whose lines hold the function; of equal spans the smallest id.

    Functions and classes meet by file and bin of lines, so that a file with very many of both is not multiplied out.
    """
    fn = functions.where("start_line <= end_line").select(F.col("id").alias("function_id"), "file_id", F.col("start_line").alias("at"), F.col("end_line").alias("to"), F.floor(F.col("start_line") / BIN).alias("bin"))
    spans = classes.select(F.col("id").alias("class_id"), "file_id", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"), F.explode(_bins("start_line", "end_line")).alias("bin"))
    inside = fn.join(spans, ["file_id", "bin"]).where("at >= cs and to <= ce")
    return inside.groupBy("function_id").agg(F.min_by("class_id", F.struct(F.col("ce") - F.col("cs"), "class_id")).alias("class_id"))


def enclosing_functions(functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """(rel_id, line, function_id): for each call with a line, the innermost function of the caller's file around that line.

    Lines and functions meet by file and bin of lines.
    """
    at = relationships.where("context_line is not null").select(F.col("id").alias("rel_id"), "source_function_id", F.col("context_line").alias("line")).distinct()
    place = at.join(functions.select(F.col("id").alias("source_function_id"), "file_id"), "source_function_id").withColumn("bin", F.floor(F.col("line") / BIN))
    spans = functions.select("file_id", F.col("id").alias("function_id"), "start_line", "end_line", F.explode(_bins("start_line", "end_line")).alias("bin"))
    met = place.join(spans, ["file_id", "bin"]).where("line >= start_line and line <= end_line")
    return met.groupBy("rel_id", "line").agg(F.max_by("function_id", F.struct("start_line", "function_id")).alias("function_id"))


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


QUERIES = {
    "file_dependencies": lambda s, d: file_dependencies(*_t(s, d, "files")),
    "file_importers": lambda s, d: file_importers(*_t(s, d, "files")),
    "module_graph": lambda s, d: module_graph(*_t(s, d, "files")),
    "module_of_path": lambda s, d: modules(*_t(s, d, "files")),
    "class_relationships": lambda s, d: class_relationships(*_t(s, d, "classes")),
    "class_hierarchy": lambda s, d: class_hierarchy(*_t(s, d, "classes", "files")),
    "subclasses": lambda s, d: subclasses(*_t(s, d, "classes", "files")),
    "class_methods_range": lambda s, d: class_methods(*_t(s, d, "classes", "functions")),
    "enclosing_function": lambda s, d: enclosing_functions(*_t(s, d, "functions", "function_relationships")),
}
_I = "i AS (SELECT id AS file_id, project_id, file_path, unnest(dependencies.imports) AS x, generate_subscripts(dependencies.imports, 1) - 1 AS pos FROM files), im AS (SELECT file_id, project_id, file_path, CAST(pos AS INTEGER) AS pos, x.source AS source, x.line AS line, translate(x.source, '.', '/') AS module FROM i WHERE x.source <> '')"
_DEP = "dep AS (SELECT im.file_id, im.project_id, im.file_path, im.pos, im.source, im.line, arg_min(f.id, (f.file_path, f.id)) AS target_id, min(f.file_path) AS target_path FROM im LEFT JOIN files f ON f.project_id = im.project_id AND contains(f.file_path, im.module) {} GROUP BY ALL)"
_MOD = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '.' END"
_PLAIN = r"trim(regexp_replace(regexp_replace(x.name, '(?s)[<\[].*', ''), '(?s)^.*(\.|::)', ''))"
_CR = f"""l AS (SELECT id, unnest(base_classes) AS x, 'EXTENDS' AS kind FROM classes UNION ALL SELECT id, unnest(interfaces), 'IMPLEMENTS' FROM classes),
cr AS (SELECT id AS source_class_id, {_PLAIN} AS target_class_name, kind AS relationship_type, min(x.line) AS context_line FROM l WHERE {_PLAIN} <> '' GROUP BY 1, 2, 3)"""
ORACLE_SQL = {
    "file_dependencies": f"WITH {_I}, {_DEP.format('')} SELECT * FROM dep",
    "file_importers": rf"""WITH {_I}, n AS (SELECT id AS file_id, project_id, unnest(list_distinct([translate(regexp_replace(file_path, '\.[^./]+$', ''), '/', '.'), split_part(regexp_replace(file_path, '\.[^./]+$', ''), '/', -1)])) AS name FROM files)
SELECT DISTINCT n.file_id, im.file_id AS importer_id, im.pos, im.source FROM im JOIN n ON n.project_id = im.project_id AND n.name <> '' AND (im.source = n.name OR starts_with(im.source, n.name || '.')) WHERE n.file_id <> im.file_id""",
    "module_graph": f"WITH {_I}, {_DEP.format('AND f.id <> im.file_id')}, m AS (SELECT project_id, {_MOD.format('file_path')} AS source, {_MOD.format('target_path')} AS target FROM dep WHERE target_path IS NOT NULL) SELECT project_id, source, target, count(*) AS imports FROM m WHERE source <> target GROUP BY 1, 2, 3",
    "module_of_path": f"SELECT project_id, {_MOD.format('file_path')} AS module, count(*) AS files FROM files GROUP BY 1, 2",
    "class_relationships": f"WITH {_CR} SELECT * FROM cr",
    "class_hierarchy": f"""WITH {_CR}, p AS (SELECT c.id AS class_id, c.name, f.project_id FROM classes c LEFT JOIN files f ON f.id = c.file_id), k AS (SELECT project_id, name, min(class_id) AS other_id FROM p GROUP BY 1, 2)
SELECT p.class_id, 'parent' AS relation, cr.target_class_name AS name, k.other_id FROM cr JOIN p ON p.class_id = cr.source_class_id LEFT JOIN k ON k.project_id = p.project_id AND k.name = cr.target_class_name WHERE relationship_type = 'EXTENDS'
UNION ALL SELECT source_class_id, 'interface', target_class_name, NULL FROM cr WHERE relationship_type = 'IMPLEMENTS'
UNION ALL SELECT p.class_id, 'child', c.name, c.id FROM cr JOIN p ON p.name = cr.target_class_name JOIN classes c ON c.id = cr.source_class_id WHERE relationship_type = 'EXTENDS'""",
    "subclasses": f"WITH {_CR} SELECT cr.target_class_name AS parent_name, c.id AS class_id, c.name AS class_name, f.file_path, cr.relationship_type FROM cr JOIN classes c ON c.id = cr.source_class_id JOIN files f ON f.id = c.file_id",
    "class_methods_range": """WITH m AS (SELECT c.id AS class_id, f.id AS function_id, starts_with(f.name, c.name || '.') AS by_name, f.start_line >= c.start_line AND f.end_line <= c.end_line AS inside FROM classes c JOIN functions f ON f.file_id = c.file_id)
SELECT class_id, function_id FROM m WHERE by_name OR (inside AND class_id NOT IN (SELECT class_id FROM m WHERE by_name))""",
    "enclosing_function": """SELECT r.id AS rel_id, r.context_line AS line, arg_max(f.id, (f.start_line, f.id)) AS function_id FROM function_relationships r JOIN functions s ON s.id = r.source_function_id JOIN functions f ON f.file_id = s.file_id
WHERE r.context_line >= f.start_line AND r.context_line <= f.end_line GROUP BY 1, 2""",
}
