"""Directed triangles: closed walks of three edges, divided by three and cut down.

Three counts of repeated edges are kept apart: ``multiset`` counts every
combination of edge rows; ``replicated`` lets the closing edge count once;
``set`` lets the middle edge count once as well. Self loops count in all of
them; ``simple=True`` drops repeats and loops first (an extension).

Equal edges are merged into one row with their number ``n``. A closed walk of
vertices that are not all one has three rotations, of which exactly one starts
at its lowest vertex by (degree, id) and does not end there. Only that one is
looked for, from its start: an edge up to ``y`` and an edge down from ``z`` meet
at the lowest vertex, so a popular vertex is never in the middle, and there are
at most edges ** 1.5 such pairs, however uneven the degrees. They then meet the
edge from ``y`` to ``z``. What the three rotations count follows from the
numbers of the three edges:

    multiset 3 n1 n2 n3    replicated n1 n2 + n2 n3 + n3 n1    set n1 + n2 + n3

A loop is a walk with one rotation and counts n ** 3, n ** 2 or n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import below, tagged
from tessera.plans.loop import remove, stored

#: Strategy to join hint; ``auto`` leaves the choice to the optimizer.
HINTS = {"auto": None, "merge": "merge", "broadcast": "broadcast", "shuffle_hash": "shuffle_hash"}
#: Edges that are broadcast at most, counted first; beyond them the join is a shuffle.
MOST_BROADCAST = 2_000_000


def _few(edges: DataFrame, most: int) -> bool:
    return edges.limit(most + 1).count() <= most


def _hinted(df: DataFrame, strategy: str) -> DataFrame:
    return df.hint(HINTS[strategy]) if HINTS[strategy] else df


def two_paths(edges: DataFrame, max_id: int | None = None, strategy: str = "auto", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``start, mid, end`` of each pair of edges that meet."""
    e = below(edges, max_id)
    if strategy == "broadcast" and not _few(e, most_broadcast):
        strategy = "auto"
    first = e.select(F.col("follower").alias("start"), F.col("followed").alias("mid"))
    second = e.select(F.col("follower").alias("mid"), F.col("followed").alias("end"))
    return first.join(_hinted(second, strategy), "mid").select("start", "mid", "end")


def middles(edges: DataFrame) -> DataFrame:
    """``mid, starts, ends, n, total`` of each vertex in the middle of a two-path.

    ``starts`` has an element for each edge in, ``ends`` each id that an edge out
    leads to once; ``n`` edges lead out, and ``total`` is the sum of their ids. A
    vertex's two lists are one row.
    """
    t = tagged(edges).where("id IS NOT NULL").select("id", (F.col("tag") == "TO").alias("into"), "other").repartition("id")
    into, out = F.when(F.col("into"), F.col("other")), F.when(~F.col("into"), F.col("other"))
    lists = t.groupBy("id").agg(
        F.collect_list(into).alias("starts"), F.count_if("into").alias("i"), F.collect_list(out).alias("ends"), F.count_if(~F.col("into")).alias("n"), F.sum(out.cast("long")).alias("total")
    )
    unknown = F.array_repeat(F.lit(None).cast("int"), (F.col("i") - F.size("starts")).cast("int"))  # a gathered list leaves nulls out
    return lists.where("i > 0 AND n > 0").select(F.col("id").alias("mid"), F.concat("starts", unknown).alias("starts"), F.array_sort(F.array_distinct("ends")).alias("ends"), "n", "total")


def two_path_sums(edges: DataFrame, folder: str, round_paths: int = 64_000_000, round_edges: int = 6, task_paths: int = 2_000_000, most_gathered: int = 4_000_000, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``start, paths, ends, digest``: of all two-paths of a start their number, that of their distinct ends, and the sum of mid * end.

    The join meets each edge with the whole list of its middle's ends, so that no
    row for each path is shuffled. Starts are dealt to as many rounds as keep a
    round's lists at ``round_edges`` ids an edge (or ``round_paths``), as disk holds
    the lists of one round only. A start whose lists have over ``most_gathered`` ids
    (a list counts for eight more) is not gathered: its ends are told apart as rows.
    Both numbers decide the work and not the result. Files stand in ``folder``.
    """
    spark = edges.sparkSession
    lists = stored(middles(edges), f"{folder}/middles")
    size = F.size("ends").cast("long")
    loads = lists.select(F.explode("starts").alias("start"), size.alias("ids")).groupBy("start").agg(F.sum("ids").alias("ids"), (F.sum("ids") + 8 * F.count(F.lit(1))).alias("load"), F.count(F.lit(1)).alias("edges"))
    heavy = loads.where(F.col("load") > most_gathered).select("start")
    whole = loads.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.count_if(F.col("load") > most_gathered).alias("many"))
    ids, n, many = stored(whole, f"{folder}/loads").first()
    if many:
        heavy = stored(heavy, f"{folder}/heavy")
        heavy = heavy.hint("broadcast") if many <= most_broadcast else heavy
    rounds = max(1, -(-ids // max(round_paths, round_edges * n)))
    tasks = max(1, -(-ids // (rounds * task_paths)))
    for i in range(rounds):
        met = lists.select(F.explode("starts").alias("start"), "n", (F.col("mid").cast("long") * F.col("total")).alias("product"), "ends").where(F.pmod(F.xxhash64("start"), F.lit(rounds)) == i)
        sums = (F.sum("n").alias("paths"), F.sum("product").alias("digest"))
        light = met.join(heavy, "start", "left_anti") if many else met
        gathered = light.repartition(tasks, "start").groupBy("start").agg(*sums, F.collect_list("ends").alias("lists"))
        out = gathered.select("start", "paths", F.size(F.array_distinct(F.flatten("lists"))).cast("long").alias("ends"), "digest")
        if many:
            rest = met.join(heavy, "start", "left_semi")
            ends = rest.select("start", F.explode("ends").alias("end")).distinct().groupBy("start").agg(F.count("end").alias("ends"))
            out = out.unionByName(rest.groupBy("start").agg(*sums).join(ends, "start", "left").select("start", "paths", F.coalesce("ends", F.lit(0)).cast("long").alias("ends"), "digest"))
        found = stored(out, f"{folder}/sums")
    for used in ("middles", "loads", "heavy"):
        remove(spark, f"{folder}/{used}")
    return found


def merged(edges: DataFrame, simple: bool = False) -> DataFrame:
    """``follower, followed, n``: each edge once, with its number."""
    e = edges.groupBy("follower", "followed").agg(F.count(F.lit(1)).alias("n"))
    return e.where("follower <> followed").withColumn("n", F.lit(1).cast("long")) if simple else e


def ranked(e: DataFrame) -> DataFrame:
    """Edges with the (degree, id) of both ends, ``low`` and ``high`` of the two; those no closed walk can use are gone."""
    ends = e.select(F.inline(F.array(F.struct(F.col("follower").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("followed").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    degree = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o > 0 AND i > 0").select("id", (F.col("o") + F.col("i")).alias("d"))
    out = e.join(degree.select(F.col("id").alias("follower"), F.col("d").alias("df")), "follower").join(degree.select(F.col("id").alias("followed"), F.col("d").alias("dt")), "followed")
    return out.select("follower", "followed", "n", F.struct(F.col("df").alias("d"), F.col("follower").alias("id")).alias("f"), F.struct(F.col("dt").alias("d"), F.col("followed").alias("id")).alias("t"))


#: What the three rotations of a walk count, and what a loop counts.
WEIGHTS = {"multiset": ("3 * n1 * n2 * n3", "n * n * n"), "replicated": ("n1 * n2 + n2 * n3 + n3 * n1", "n * n"), "set": ("n1 + n2 + n3", "n")}


def triangles(edges: DataFrame, max_id: int | None = None, mode: str = "multiset", strategy: str = "auto", simple: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row, ``triangles``."""
    if strategy == "broadcast" and not _few(below(edges, max_id), most_broadcast):
        strategy = "auto"
    e = merged(below(edges, max_id), simple)
    r = ranked(e)
    up = r.where("f <= t").select(F.col("follower").alias("x"), F.col("followed").alias("y"), F.col("n").alias("n1"))
    down = r.where("t < f").select(F.col("followed").alias("x"), F.col("follower").alias("z"), F.col("n").alias("n3"))
    pairs = up.join(_hinted(down, strategy), "x").select("y", "z", "n1", "n3")
    between = e.select(F.col("follower").alias("y"), F.col("followed").alias("z"), F.col("n").alias("n2"))
    walk, loop = WEIGHTS[mode]
    counted = pairs.join(_hinted(between, strategy), ["y", "z"]).select(F.expr(walk).alias("w")).unionByName(e.where("follower = followed").select(F.expr(loop).alias("w")))
    return counted.agg(F.expr("coalesce(sum(w), 0L) div 3").alias("triangles"))


def triangles_sql(edges: DataFrame, max_id: int | None = None, broadcast: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The same count of the multiset form as one SQL text over a view of the edges."""
    name = "tessera_triangle_edges"
    merged(below(edges, max_id)).createOrReplaceTempView(name)
    few = broadcast and _few(below(edges, max_id), most_broadcast)
    hint = "/*+ BROADCAST(e) */" if few else ""
    return edges.sparkSession.sql(f"""
        WITH ends AS (SELECT follower AS id, 1 AS o, 0 AS i FROM {name} UNION ALL SELECT followed, 0, 1 FROM {name}),
        degrees AS (SELECT id, sum(o) + sum(i) AS d FROM ends GROUP BY id HAVING sum(o) > 0 AND sum(i) > 0),
        ranked AS (
          SELECT follower, followed, n, a.d < b.d OR (a.d = b.d AND follower <= followed) AS up
          FROM {name} JOIN degrees a ON a.id = follower JOIN degrees b ON b.id = followed),
        pairs AS (
          SELECT u.followed AS y, w.follower AS z, u.n * w.n AS product
          FROM ranked u JOIN ranked w ON u.follower = w.followed WHERE u.up AND NOT w.up),
        walks AS (
          SELECT {hint} 3 * e.n * product AS w FROM pairs JOIN {name} e ON y = e.follower AND z = e.followed
          UNION ALL SELECT n * n * n FROM {name} WHERE follower = followed)
        SELECT coalesce(sum(w), 0L) div 3 AS triangles FROM walks""")
