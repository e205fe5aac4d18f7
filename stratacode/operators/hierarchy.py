"""Hierarchies of unknown depth from parent-child links, with cycles (problem 2).

Nodes are spread over fragments of bounded size. Within a fragment every chain of parents is contracted to the points
where it leaves the fragment; the nodes at which other fragments enter form a smaller quotient graph, which is solved
in the same way by other fragments; its answers then expand the fragments' own rows. Cycles are found first, by the
same contraction: a cycle either lies within a fragment or is one of the quotient graph. Where a quotient does not
shrink, joins that double the length of every chain (for paths) or trim and colour the graph (for cycles) take over,
so that no task ever holds more than a fragment.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut, drop_cut, is_empty, table

FRAGMENT_ROWS = 20_000
CLOSURE_ROWS = 4_000  # a fragment's pairs may be quadratic in its rows
_SHRINK = 0.7


def _fragment(group: Column, node: Column, subs: Column, level: int, bins: int) -> Column:
    """Small groups stay whole, large ones are spread over ``subs`` parts; parts are packed into ``bins`` fragments."""
    sub = F.pmod(F.xxhash64(node, F.lit(level)), F.coalesce(subs, F.lit(1)))
    return F.pmod(F.xxhash64(group, sub, F.lit(level)), F.lit(bins)).cast("int")


def _spread(edges: DataFrame, level: int, fragment_rows: int) -> tuple[DataFrame, int]:
    """``edges`` with the fragment of child and parent (null if the parent is null)."""
    sizes = edges.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-2 * total // fragment_rows))
    subs = F.ceil(F.col("n") / fragment_rows)
    big = sizes.where(F.col("n") > fragment_rows).select("grp", subs.alias("subs"))
    out = edges.join(big, "grp", "left")
    at = lambda c: _fragment(F.col("grp"), F.col(c), F.col("subs"), level, bins)
    return out.withColumn("frag", at("child")).withColumn("up_frag", F.when(F.col("parent").isNotNull(), at("parent"))).drop("subs"), total


# --- cycles ----------------------------------------------------------------------------------------------------------


def _strong(nodes: list[int], up: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components that hold a cycle (Tarjan, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, out = set(), [], []
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(up.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(up.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    if len(comp) > 1 or v in up.get(v, ()):
                        out.append(comp)
    return out


def _reach(starts, links: dict[int, list[int]]) -> set[int]:
    seen, todo = set(starts), list(starts)
    while todo:
        for w in links.get(todo.pop(), ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def _local(pdf: pd.DataFrame) -> tuple[dict, dict, dict, set]:
    """Links within the fragment (up and down), links that leave it, and nodes that others enter."""
    up, down, leave, entries = defaultdict(list), defaultdict(list), defaultdict(list), set()
    for child, parent, frag, up_frag, here in pdf[["child", "parent", "frag", "up_frag", "here"]].itertuples(index=False):
        if frag == up_frag:
            up[child].append(parent)
            down[parent].append(child)
        elif here == frag:
            leave[child].append(parent)
        else:
            entries.add(parent)
    return up, down, leave, entries


def _contract_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotient links: from each node that others enter to the nodes outside that it reaches by one step out."""
    up, _, leave, entries = _local(pdf)
    grp = pdf["grp"].iloc[0]
    group_of = dict(zip(pdf["parent"], pdf["grp"], strict=True)) | dict(zip(pdf["child"], pdf["grp"], strict=True))
    rows = {(u, w) for u in entries for v in _reach([u], up) for w in leave.get(v, ())}
    return pd.DataFrame([(group_of.get(u, grp), u, w) for u, w in rows], columns=["grp", "child", "parent"])


def _expand_cycles(pdf: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """Members of cycles in a fragment, given the quotient's: those between an entry and an exit of one cycle."""
    if not len(pdf):
        return pd.DataFrame([], columns=["node", "label"])
    up, down, leave, _ = _local(pdf)
    label = dict(zip(labels["node"], labels["label"], strict=True))
    inn, out, got = defaultdict(set), defaultdict(set), {}
    for node in set(up) | set(down) | set(leave) | set(pdf.loc[pdf["here"] == pdf["up_frag"], "parent"]):
        if node in label:
            inn[label[node]].add(node)
        for w in leave.get(node, ()):
            if w in label:
                out[label[w]].add(node)
    for lab in inn.keys() & out.keys():
        for v in _reach(inn[lab], up) & _reach(out[lab], down):
            got[v] = lab
    for comp in _strong(sorted(set(up) | set(down)), up):
        if comp[0] not in got:
            got |= dict.fromkeys(comp, min(comp))
    return pd.DataFrame(list(got.items()), columns=["node", "label"])


def _cycles_by_joins(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes on cycles, by trimming and colouring; for graphs that do not contract."""
    spark = edges.sparkSession
    done = spark.createDataFrame([], "node long, label long")
    left = cut(edges.select("child", "parent").distinct())
    while True:
        size = left.count()
        if not size:
            return done
        kept = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        kept = cut(kept.select("child", "parent"))
        if kept.count() < size:
            drop_cut(left)
            left = kept
            continue
        nodes = kept.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        colour = last = cut(nodes.withColumn("colour", F.col("node")))
        while True:  # the least node that each node reaches
            seen = kept.join(colour.select(F.col("node").alias("parent"), "colour"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("colour").alias("other"))
            new = cut(colour.join(seen, "node", "left").select("node", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("moved")))
            drop_cut(last)
            colour, last = new.select("node", "colour"), new
            if is_empty(new.where("moved")):
                break
        same = kept.join(colour.withColumnsRenamed({"node": "child", "colour": "c1"}), "child").join(colour.withColumnsRenamed({"node": "parent", "colour": "c2"}), "parent").where("c1 = c2")
        same = cut(same.select("child", "parent", F.col("c1").alias("colour")))
        inside = cut(colour.where("node = colour"))
        while True:  # those of its colour that the least node reaches
            grown = inside.withColumnRenamed("node", "child").join(same, ["child", "colour"]).select(F.col("parent").alias("node"), "colour")
            new = cut(inside.union(grown).distinct())
            done_growing = new.count() == inside.count()
            drop_cut(inside)
            inside = new
            if done_growing:
                break
        back = same.select("parent", "child", "colour").where("parent = colour").select("colour").union(inside.groupBy("colour").count().where("count > 1").select("colour")).distinct()
        done = cut(done.union(inside.join(back, "colour", "left_semi").select("node", F.col("colour").alias("label"))))
        gone = inside.select(F.col("node").alias("child"))
        left = cut(kept.join(gone, "child", "left_anti").join(gone.withColumnRenamed("child", "parent"), "parent", "left_anti").select("child", "parent"))


def cycle_members(edges: DataFrame, fragment_rows: int = FRAGMENT_ROWS, level: int = 0) -> DataFrame:
    """(node, label): the nodes of ``edges(grp, child, parent)`` that reach themselves; equal labels, one cycle."""
    spread, total = _spread(edges.where("parent is not null").select("grp", "child", "parent").distinct(), level, fragment_rows)
    spread = cut(spread)
    both = spread.withColumn("here", F.col("frag")).union(spread.where("frag <> up_frag").withColumn("here", F.col("up_frag")))
    quotient = cut(both.groupBy("here").applyInPandas(_contract_cycles, "grp long, child long, parent long"))
    n = quotient.count()
    if n == 0:
        labels = edges.sparkSession.createDataFrame([], "node long, label long")
    elif n <= _SHRINK * total and level < 12:
        labels = cycle_members(quotient, fragment_rows, level + 1)
    else:
        labels = _cycles_by_joins(quotient)
    sent = spread.where("frag <> up_frag").join(labels.withColumnRenamed("node", "parent"), "parent")
    sent = sent.select(F.explode(F.array("frag", "up_frag")).alias("here"), F.col("parent").alias("node"), "label").distinct()
    found = both.groupBy("here").cogroup(sent.groupBy("here")).applyInPandas(_expand_cycles, "node long, label long")
    return cut(found.distinct())


# --- paths -----------------------------------------------------------------------------------------------------------


def _contract_paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """All ways from each child up to where they end or leave the fragment: (grp, child, parent or null, path)."""
    own = defaultdict(list)
    group = dict(zip(pdf["child"], pdf["grp"], strict=True))
    for child, parent, path, inside in zip(pdf["child"], pdf["parent"], pdf["path"], pdf["frag"] == pdf["up_frag"], strict=True):
        own[child].append((None if pd.isna(parent) else int(parent), path, bool(inside)))
    rows: dict[int, list] = {}
    for start in own:
        todo = [start]
        while todo:
            v = todo[-1]
            if v in rows:
                todo.pop()
                continue
            wait = [p for p, _, inside in own[v] if inside and p in own and p not in rows]
            if wait:
                todo += wait
                continue
            got = {}
            for p, path, inside in own[v]:
                for q, above in rows[p] if inside and p in own else [(p, "")]:
                    got[q, above + path] = None
            rows[v] = list(got)
            todo.pop()
    flat = [(group[v], v, p, path) for v, r in rows.items() for p, path in r]
    out = pd.DataFrame(flat, columns=["grp", "child", "parent", "path"])
    out["parent"] = out["parent"].astype("Int64")
    return out


def _solve_paths(edges: DataFrame, fragment_rows: int, level: int = 0) -> DataFrame:
    """(grp, child, path): every way from the top to a child. ``edges(grp, child, parent, path)``: ``path`` is what
    follows the parent's own path, or the whole path if the parent is null. There must be no cycle."""
    spread, total = _spread(edges, level, fragment_rows)
    rows = cut(spread.groupBy("frag").applyInPandas(_contract_paths, "grp long, child long, parent long, path string"))
    done, wait = rows.where("parent is null").select("grp", "child", "path"), rows.where("parent is not null")
    exits = wait.select(F.col("parent").alias("child")).distinct()
    rest = cut(rows.join(exits, "child", "left_semi").select("grp", "child", "parent", "path"))
    n = rest.count()
    if n == 0:
        return done
    if n <= _SHRINK * total and level < 12:
        full = _solve_paths(rest, fragment_rows, level + 1)
    else:
        full = _double(rest)
    above = full.select(F.col("child").alias("parent"), F.col("path").alias("above"))
    return done.union(wait.join(above, "parent").select("grp", "child", F.concat("above", "path").alias("path")))


def _double(rows: DataFrame) -> DataFrame:
    """The same by joins: each round doubles the length of every unfinished way."""
    while not is_empty(rows.where("parent is not null")):
        step = rows.select(F.col("child").alias("parent"), F.col("parent").alias("next"), F.col("path").alias("above"))
        longer = rows.where("parent is not null").join(step, "parent").select("grp", "child", F.col("next").alias("parent"), F.concat("above", "path").alias("path"))
        rows = cut(rows.where("parent is null").select("grp", "child", "parent", "path").union(longer).distinct())
    return rows.select("grp", "child", "path")


def hierarchy_paths(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(node, path, root, depth, on_cycle) for every node of ``links(grp, child, parent)`` with a parent.

    One row per distinct way from a node without parents down to the node, ids joined by ``/``; depth counts the links
    and root is the first id. A node on a cycle has one row, ``cycle:`` and the cycle's least id, depth 0; a way below a
    cycle starts with that text, and its root is that id.

    Links with a null end are ignored, repeated ones count once, a node that is its own parent is a cycle. An empty
    input gives no rows.
    """
    edges = cut(links.select(F.coalesce("grp", F.lit(-1)).cast("long").alias("grp"), F.col("child").cast("long"), F.col("parent").cast("long")).where("child is not null and parent is not null").distinct())
    found = cycle_members(edges, fragment_rows)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    ring = cut(found.join(least, "label").select("node", "least"))
    heads = edges.select(F.col("child").alias("parent")).distinct().withColumn("has", F.lit(True))
    below = edges.join(ring.select(F.col("node").alias("child")), "child", "left_anti").join(heads, "parent", "left").join(ring.withColumnRenamed("node", "parent"), "parent", "left")
    tail = F.concat(F.lit("/"), F.col("child").cast("string"))
    top = F.when(F.col("least").isNotNull(), F.concat(F.lit("cycle:"), F.col("least").cast("string"), tail)).when(F.col("has").isNull(), F.concat(F.col("parent").cast("string"), tail))
    rows = below.select("grp", "child", F.when(top.isNull(), F.col("parent")).alias("parent"), F.coalesce(top, tail).alias("path")).distinct()
    paths = _solve_paths(cut(rows), fragment_rows).select(F.col("child").alias("node"), "path", F.lit(False).alias("on_cycle"))
    rings = ring.select("node", F.concat(F.lit("cycle:"), F.col("least").cast("string")).alias("path"), F.lit(True).alias("on_cycle"))
    out = paths.distinct().union(rings)
    first = F.regexp_extract("path", r"^(?:cycle:)?(\d+|-\d+)", 1).cast("long")
    return out.select("node", "path", first.alias("root"), (F.size(F.split("path", "/")) - 1).alias("depth"), "on_cycle")


# --- reachability ----------------------------------------------------------------------------------------------------


def _close_fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    """(grp, node, ancestor, depth, out): what each node reaches within the fragment, and the nodes outside one step further."""
    own = defaultdict(list)
    group = dict(zip(pdf["child"], pdf["grp"], strict=True))
    for child, parent, depth, inside in zip(pdf["child"], pdf["parent"], pdf["depth"], pdf["frag"] == pdf["up_frag"], strict=True):
        own[child].append((parent, depth, inside))
    rows: dict[int, dict] = {}
    for start in own:
        todo = [start]
        while todo:
            v = todo[-1]
            if v in rows:
                todo.pop()
                continue
            wait = [p for p, _, inside in own[v] if inside and p in own and p not in rows]
            if wait:
                todo += wait
                continue
            got: dict[tuple[int, bool], int] = {}
            for p, depth, inside in own[v]:
                for key, d in [((p, not inside), depth), *(((q, out), depth + d) for (q, out), d in (rows[p].items() if inside and p in own else ()))]:
                    got[key] = min(d, got.get(key, d))
            rows[v] = got
            todo.pop()
    return pd.DataFrame([(group[v], v, q, d, out) for v, r in rows.items() for (q, out), d in r.items()], columns=["grp", "node", "ancestor", "depth", "out"])


def _closure(edges: DataFrame, fragment_rows: int, level: int = 0) -> DataFrame:
    """(grp, node, ancestor, depth): all pairs of ``edges(grp, child, parent, depth)``, acyclic, at their least depth.

    Fragments are closed by themselves; the nodes that others enter and what they reach outside form the quotient, whose
    own closure joins the fragments' pairs. Only pairs are kept, never ways, so diamonds cost what their pairs cost.
    """
    least = lambda df: df.groupBy("grp", "node", "ancestor").agg(F.min("depth").alias("depth"))
    spread, total = _spread(edges, level, fragment_rows)
    rows = cut(spread.groupBy("frag").applyInPandas(_close_fragment, "grp long, node long, ancestor long, depth long, out boolean"))
    within, away = rows.where("not out").drop("out"), rows.where("out").drop("out")
    entries = away.select(F.col("ancestor").alias("node")).distinct()
    rest = cut(away.join(entries, "node", "left_semi").select("grp", F.col("node").alias("child"), F.col("ancestor").alias("parent"), "depth"))
    n = rest.count()
    if n == 0:
        far = rest.select("grp", F.col("child").alias("node"), F.col("parent").alias("ancestor"), "depth")
    elif n <= _SHRINK * total and level < 12:
        far = _closure(rest, fragment_rows, level + 1)
    else:
        far = _double_pairs(rest)
    step = lambda a, b: a.withColumnsRenamed({"ancestor": "mid", "depth": "d1"}).join(b.select(F.col("node").alias("mid"), "ancestor", F.col("depth").alias("d2")), "mid").select("grp", "node", "ancestor", (F.col("d1") + F.col("d2")).alias("depth"))
    outside = cut(least(away.unionByName(step(away, far))))
    return cut(least(within.unionByName(outside).unionByName(step(outside, within))))


def _double_pairs(edges: DataFrame) -> DataFrame:
    """The same by joins, for graphs that do not contract: each round doubles the length of the ways that pairs stand for."""
    pairs = cut(edges.select("grp", F.col("child").alias("node"), F.col("parent").alias("ancestor"), "depth"))
    while True:
        on = pairs.select(F.col("node").alias("mid"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = pairs.withColumnRenamed("ancestor", "mid").join(on, "mid").select("grp", "node", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        new = cut(pairs.unionByName(longer).groupBy("grp", "node", "ancestor").agg(F.min("depth").alias("depth")))
        same = new.agg(F.count(F.lit(1)), F.sum("depth")).first() == pairs.agg(F.count(F.lit(1)), F.sum("depth")).first()
        drop_cut(pairs)
        pairs = new
        if same:
            return pairs


def ancestors(links: DataFrame, fragment_rows: int = CLOSURE_ROWS) -> DataFrame:
    """(node, ancestor, depth), distinct: all that each node of ``links(grp, child, parent)`` reaches, at the least number of links.

    A cycle counts as one node: its members are ancestors of each other and of themselves at depth 0, and equally far
    from all else. Links with a null end are ignored, repeated ones count once; an empty input gives no rows.
    """
    edges = cut(links.select(F.coalesce("grp", F.lit(-1)).cast("long").alias("grp"), F.col("child").cast("long"), F.col("parent").cast("long")).where("child is not null and parent is not null").distinct())
    found = cycle_members(edges, fragment_rows)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    ring = cut(found.join(least, "label").select("node", "least"))
    as_one = edges
    for c in ("child", "parent"):
        as_one = as_one.join(ring.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("least", c)).drop("least")
    as_one = cut(as_one.where("child <> parent").groupBy("child", "parent").agg(F.min("grp").alias("grp")).withColumn("depth", F.lit(1).cast("long")))
    pairs = _closure(as_one, fragment_rows).select("node", "ancestor", "depth")
    members = ring.withColumnRenamed("node", "member")
    for c in ("ancestor", "node"):
        pairs = pairs.join(members.withColumnRenamed("least", c), c, "left").withColumn(c, F.coalesce("member", c)).drop("member")
    inner = ring.select("node", "least").join(ring.select(F.col("node").alias("ancestor"), "least"), "least").select("node", "ancestor", F.lit(0).cast("long").alias("depth"))
    return pairs.select("node", "ancestor", "depth").union(inner)


def descendants(links: DataFrame, fragment_rows: int = CLOSURE_ROWS) -> DataFrame:
    """(ancestor, descendant), distinct: all classes below each class. Members of a cycle are below each other and themselves."""
    return ancestors(links, fragment_rows).select("ancestor", F.col("node").alias("descendant"))


# --- classes ---------------------------------------------------------------------------------------------------------


def plain_name(name: Column) -> Column:
    """A listed name without blanks around it, type arguments and qualifiers."""
    bare = F.regexp_replace(name, r"(?s)[<\[].*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)^.*(?:\.|::)", ""), r"^\s+|\s+$", "")


def class_links(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(grp, child, parent): each listed base or interface that is a class of the child's project, by least id.

    Null lists, null and blank names, and classes whose file or project is missing have no links.
    """
    placed = classes.select("id", "name", "file_id", "base_classes", "interfaces").join(files.select(F.col("id").alias("file_id"), "project_id").where("project_id is not null").distinct(), "file_id")
    empty = F.array().cast("array<struct<name:string,line:int>>")
    listed = F.concat(F.coalesce("base_classes", empty), F.coalesce("interfaces", empty))
    child = placed.select("project_id", F.col("id").alias("child"), F.explode(F.transform(listed, lambda x: x["name"])).alias("listed"))
    child = child.select("project_id", "child", plain_name(F.col("listed")).alias("name")).where("name is not null and name <> ''").distinct()
    known = placed.where("name is not null").groupBy("project_id", "name").agg(F.min("id").alias("parent"))
    return child.join(known, ["project_id", "name"]).select(F.col("project_id").alias("grp"), "child", "parent").distinct()


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_links(table(spark, sf_dir, "classes"), table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_paths(_links(spark, sf_dir)).select(F.col("node").alias("class_id"), F.col("path").alias("class_path"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of each class with a parent."""
    got = hierarchy_paths(_links(spark, sf_dir))
    return got.select(F.col("node").alias("class_id"), F.col("path").alias("class_path"), F.col("root").alias("root_id"), "depth", "on_cycle")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each class."""
    got = descendants(_links(spark, sf_dir))
    return got.select(F.col("ancestor").alias("class_id"), F.col("descendant").alias("descendant_id"))


_SQL_LINKS = r"""
placed AS (SELECT DISTINCT c.id, c.name, c.base_classes, c.interfaces, f.project_id FROM classes c JOIN files f ON c.file_id = f.id WHERE f.project_id IS NOT NULL),
listed AS (SELECT project_id, id AS child, unnest(list_concat(coalesce(base_classes, []), coalesce(interfaces, []))).name AS nm FROM placed),
plain AS (SELECT DISTINCT project_id, child, trim(regexp_replace(regexp_replace(nm, '(?s)[<\[].*', ''), '(?s)^.*(\.|::)', '')) AS name FROM listed WHERE nm IS NOT NULL),
known AS (SELECT project_id, name, min(id) AS parent FROM placed WHERE name IS NOT NULL GROUP BY 1, 2),
e AS (SELECT DISTINCT p.child, k.parent FROM plain p JOIN known k ON p.project_id = k.project_id AND p.name = k.name WHERE p.name <> ''),
r(a, b) AS (SELECT child, parent FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON r.b = e.child),
ring AS (SELECT x.a AS node, min(x.b) AS least FROM r x JOIN r y ON x.b = y.a AND y.b = x.a WHERE x.a IN (SELECT a FROM r WHERE a = b) GROUP BY 1)
"""
_SQL_PATHS = (
    "WITH RECURSIVE "
    + _SQL_LINKS
    + """,
w(node, path) AS (
  SELECT e.child, CASE WHEN g.least IS NOT NULL THEN 'cycle:' || g.least ELSE e.parent::VARCHAR END || '/' || e.child
  FROM e LEFT JOIN ring g ON g.node = e.parent
  WHERE e.child NOT IN (SELECT node FROM ring) AND (g.least IS NOT NULL OR e.parent NOT IN (SELECT child FROM e))
  UNION
  SELECT e.child, w.path || '/' || e.child FROM w JOIN e ON e.parent = w.node WHERE e.child NOT IN (SELECT node FROM ring)),
paths AS (SELECT node, path, FALSE AS on_cycle FROM w UNION SELECT node, 'cycle:' || least, TRUE FROM ring)
"""
)
ORACLE_SQL = {
    "p2_found": _SQL_PATHS + "SELECT node AS class_id, path AS class_path FROM paths",
    "p2_hierarchy": _SQL_PATHS + "SELECT node AS class_id, path AS class_path, CAST(split_part(replace(path, 'cycle:', ''), '/', 1) AS BIGINT) AS root_id, CAST(len(path) - len(replace(path, '/', '')) AS INTEGER) AS depth, on_cycle FROM paths",
    "p2_descendants": "WITH RECURSIVE " + _SQL_LINKS + "SELECT DISTINCT b AS class_id, a AS descendant_id FROM r",
}
QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}
