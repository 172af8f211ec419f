import pytest
from pyspark.sql import functions as F

from tessera.operators import bfs, counts, graph, kmeans, pagerank, triangles
from tessera.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


FOLLOWERS = {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0}


@pytest.mark.parametrize("how", ["reduce", "fold", "aggregate", "group", "double"])
def test_follower_count_forms_agree(mini_edges, mini_nodes, how):
    assert {r.id: int(r.cnt) for r in counts.follower_count(mini_edges, mini_nodes, how).collect()} == FOLLOWERS


def test_follower_rows_count_the_node_row(mini_edges, mini_nodes):
    assert {r.id: r.cnt for r in counts.follower_rows(mini_edges, mini_nodes).collect()} == {k: v + 1 for k, v in FOLLOWERS.items()}


def test_followed_only_ids_are_kept_and_repeats_count_twice(spark):
    e = spark.createDataFrame([(1, 5), (1, 5)], "follower int, followed int")
    n = spark.createDataFrame([(1,)], "id int")
    assert rows(counts.follower_count(e, n)) == [(1, 0), (5, 2)]


def test_follower_count_of_unknown_form_raises(mini_edges, mini_nodes):
    with pytest.raises(ValueError):
        counts.follower_count(mini_edges, mini_nodes, "other")


def test_histogram_and_loglog(mini_edges, mini_nodes):
    c = counts.follower_count(mini_edges, mini_nodes)
    assert rows(counts.histogram(c)) == [(0, 2), (1, 6), (2, 1)]
    assert rows(counts.loglog(c)) == [(0.0, 0.693147181), (0.693147181, 1.791759469), (1.098612289, 0.0)]


def test_two_paths(mini_edges):
    assert graph.two_path_cardinality(mini_edges).first().cardinality == 9
    assert triangles.two_paths(mini_edges).count() == 9


@pytest.mark.parametrize("mode", ["multiset", "replicated", "set"])
@pytest.mark.parametrize("strategy", ["auto", "merge", "broadcast", "shuffle_hash"])
def test_triangles_agree_on_a_simple_graph(mini_edges, mode, strategy):
    assert triangles.triangles(mini_edges, mode=mode, strategy=strategy).first().triangles == 2


def test_triangle_modes_differ_on_repeats(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (4, 4)], "follower int, followed int")
    got = {m: triangles.triangles(e, mode=m).first().triangles for m in ("multiset", "replicated", "set")}
    # seven closed walks, one of them the loop; 6 where the closing edge counts once; 5 where the middle one does too
    assert got == {"multiset": 2, "replicated": 2, "set": 1}
    assert triangles.triangles(e, simple=True).first().triangles == 1
    assert triangles.triangles_sql(e).first().triangles == got["multiset"]
    assert triangles.triangles_sql(e, broadcast=True).first().triangles == got["multiset"]


def test_triangle_cut_off_is_strict(mini_edges):
    assert triangles.triangles(mini_edges, max_id=5).first().triangles == 1
    assert triangles.triangles_sql(mini_edges, max_id=5).first().triangles == 1


@pytest.mark.parametrize(("strategy", "node"), [("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_strategies_reach_the_plan(mini_edges, strategy, node):
    assert node in files.explain_text(triangles.triangles(mini_edges, strategy=strategy))


def test_adjacency_round_trip(spark, mini_edges, mini_nodes, tmp_path):
    adj = graph.adjacency(mini_edges, mini_nodes)
    files.write_lines(adj, str(tmp_path / "adj"), files.adjacency_line())
    lines = spark.read.text(str(tmp_path / "adj"))
    assert "2-(3:4)" in {r.value for r in lines.collect()} and "9-()" in {r.value for r in lines.collect()}
    assert {r.id: r.adj for r in files.parse_adjacency(lines).collect()} == {r.id: r.adj for r in adj.collect()}
    assert {r.id: r.adj for r in files.parse_adjacency(lines, with_self=True).collect()}[2] == [2, 3, 4]


def test_followed_only_ids_have_no_adjacency_row(spark):
    e = spark.createDataFrame([(1, 5), (1, 5)], "follower int, followed int")
    n = spark.createDataFrame([(1,)], "id int")
    assert [(r.id, r.adj) for r in graph.adjacency(e, n).collect()] == [(1, [5, 5])]
    assert [(r.id, r.adj) for r in graph.adjacency(e, n, "set").collect()] == [(1, [5])]


def test_csv_readers(spark, mini_edges, mini_nodes, tmp_path):
    files.write_csv(mini_edges, str(tmp_path / "e"), single_file=True)
    files.write_csv(mini_nodes, str(tmp_path / "n"), single_file=True, shuffle=False)
    assert rows(files.read_edges(spark, str(tmp_path / "e"))) == rows(mini_edges) == rows(files.read_edges_text(spark, str(tmp_path / "e")))
    assert rows(files.read_nodes(spark, str(tmp_path / "n"))) == rows(mini_nodes)
    (tmp_path / "bad").write_text("1,x\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_edges(spark, str(tmp_path / "bad")).collect()


def test_bfs_single_source(mini_edges, mini_nodes):
    found = bfs.search(mini_edges, [1])
    assert {r.id: r.dist for r in found.reached.collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    assert (found.passes, found.eccentricity) == (4, 3)
    far = {r.id: r.dist for r in bfs.distances(mini_edges, mini_nodes, [1]).collect()}
    assert far[6] == 2147483647 and len(far) == 9


def test_bfs_two_sources(mini_edges, mini_nodes):
    found = bfs.search(mini_edges, [2, 6])
    by = {(r.source, r.id): r.dist for r in found.reached.collect()}
    assert by == {(2, 1): 2, (2, 2): 0, (2, 3): 1, (2, 4): 1, (2, 5): 2, (6, 6): 0, (6, 7): 1, (6, 8): 2}
    assert found.passes == 3
    wide = bfs.wide(bfs.distances(mini_edges, mini_nodes, [2, 6]), [2, 6])
    assert {r.id: (r.d1, r.d2) for r in wide.collect()}[1] == (2, 2147483647)


def test_bfs_cap_and_expand(mini_edges, mini_nodes):
    assert bfs.search(mini_edges, [1], max_passes=2).updates == [1, 2]
    once = bfs.expand(bfs.start(mini_nodes, [1]), mini_edges)
    assert {r.id: r.dist for r in once.collect() if r.dist is not None} == {1: 0, 2: 1}
    with pytest.raises(ValueError):
        bfs.search(mini_edges, [])


def test_state_json_round_trip(spark, mini_edges, mini_nodes, tmp_path):
    states = bfs.states(mini_edges, graph.adjacency(mini_edges, mini_nodes), bfs.distances(mini_edges, mini_nodes, [1, 2]))
    files.write_lines(states, str(tmp_path / "s"), files.state_line())
    back = files.parse_state(spark.read.text(str(tmp_path / "s")))
    key = lambda r: (r.id, sorted(r.sourcesDistance.items()), r.isVertex, r.adjacencyList)
    assert sorted(map(key, back.collect())) == sorted(map(key, states.collect()))


def test_pagerank_golden(spark):
    ranked = pagerank.run(graph.chain_graph(spark, 100), 10)
    top = pagerank.top(ranked.ranks, 100)
    got = [(r.v, r.pr) for r in top.collect()]
    assert [v for v, _ in got] == [*range(11, 101), *range(111, 121)]
    exact = {r.v: r.pr for r in ranked.ranks.where("v IN (11, 100, 120)").collect()}
    assert all(abs(x - 1.1046221254112046e-4) <= 1e-15 for x in exact.values())
    assert all(abs(s - 1) < 1e-9 for s in ranked.sums)


def test_pagerank_of_a_general_graph_splits_and_keeps_the_sum(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "src int, dst int")
    ranked = pagerank.run(links, 6)
    assert all(abs(s - 1) < 1e-12 for s in ranked.sums)
    assert abs(pagerank.run(links, 1).deltas[0] - 0.25) < 1e-12


def test_chain_graph_edges(spark):
    assert rows(graph.chain_graph(spark, 2)) == [(1, 2), (2, 0), (3, 4), (4, 0)]
    assert rows(graph.chain_graph(spark, 1)) == [(1, 0)]
    with pytest.raises(ValueError):
        graph.chain_graph(spark, 0)


def test_kmeans(spark):
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2, 50, 51, 52, 100])], "id int, x double")
    r = kmeans.run(points, kmeans.starts("spread", 2, 100))
    assert len(r.trace) == 2 * r.passes and r.totals[-1] == r.totals[-2]
    assert all(a >= b for a, b in zip(r.totals[1:], r.totals[2:], strict=False))
    tied = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert kmeans.assign(tied, [(1, 4.0), (2, 6.0)]).first().cluster == 1
    kept = kmeans.run(points, [(1, 10.0), (2, 5000.0)], max_passes=1)
    assert kept.centroids[1] == (2, 5000.0)
    moved = kmeans.run(points, [(1, 10.0), (2, 5000.0)], max_passes=1, reseed=lambda k, c: 7.0)
    assert moved.centroids[1] == (2, 7.0)
    with pytest.raises(ValueError):
        kmeans.starts("other", 2, 10)


def test_nested_pairs_and_tags(mini_edges, mini_nodes):
    assert graph.nested_pairs(mini_edges, mini_nodes).select("_1.follower", "_2.id").count() == 8
    tagged = files.read_tagged((mini_edges.select(F.col("followed").alias("id")), "EDGE"), (mini_nodes, "NODE"))
    assert {r.tag: r["count"] for r in tagged.groupBy("tag").count().collect()} == {"EDGE": 8, "NODE": 9}


def test_two_paths_whole_leaves_no_id_out(spark, monkeypatch):
    from tessera.plans import catalog

    pairs = [(1, 2), (1, 2), (2, 3), (3, 3), (299, 300), (300, 301), (301, 15_000), (15_000, 1)]
    monkeypatch.setattr(catalog, "_edges", lambda s, d: spark.createDataFrame(pairs, "follower int, followed int"))
    want = sorted((a, d) for a, b in pairs for c, d in pairs if b == c)
    assert rows(catalog.queries()["two_paths_whole"](spark, "")) == want


def brute_path_sums(pairs):
    out = {}
    for a, b in pairs:
        for c, d in pairs:
            if b == c and b is not None:
                out.setdefault(a, []).append((b, d))
    sums = lambda found: [b * d for b, d in found if d is not None]
    return {a: (len(x), len({d for _, d in x} - {None}), sum(sums(x)) if sums(x) else None) for a, x in out.items()}


@pytest.mark.parametrize("limits", [{}, {"round_paths": 1, "round_edges": 1, "task_paths": 50}, {"most_gathered": 60}, {"round_paths": 1, "round_edges": 2, "most_gathered": 0, "most_broadcast": 0}])
def test_two_path_sums_of_repeats_loops_and_nulls(spark, tmp_path, limits):
    import random

    rng = random.Random(5)
    pairs = [(rng.randint(1, 15), rng.randint(-3, 15)) for _ in range(120)] + [(3, 3)] * 3 + [(None, 3), (None, 4), (None, None), (3, None), (3, None), (50, 51), (51, None), (60, 61)] + [(i, 7) for i in range(20, 40)]
    e = spark.createDataFrame(pairs, "follower int, followed int")
    found = triangles.two_path_sums(e, str(tmp_path), **limits)
    assert found.columns == ["start", "paths", "ends", "digest"]
    assert {r.start: (r.paths, r.ends, r.digest) for r in found.collect()} == brute_path_sums(pairs)
    assert found.count() == len(brute_path_sums(pairs)) and [p.name for p in tmp_path.iterdir()] == ["sums"]
    assert triangles.two_path_sums(e.limit(0), str(tmp_path / "none"), **limits).count() == 0


def test_two_paths_shuffles_no_row_for_each_path(spark, monkeypatch):
    """A vertex with 300 edges in and 300 out: 90,000 paths, of which none is a row of a shuffle."""
    from tessera.plans import catalog

    pairs = [(i, 1000) for i in range(300)] + [(1000, i + 2000) for i in range(300)]
    monkeypatch.setattr(catalog, "_edges", lambda s, d: spark.createDataFrame(pairs, "follower int, followed int"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    want = [(i, 300, 300, sum(1000 * (j + 2000) for j in range(300))) for i in range(300)]
    assert rows(catalog.queries()["two_paths"](spark, "")) == want
    assert 0 < sum(n for k, n in shuffled().items() if k not in before) < 5000


def test_registered_searches_end_by_themselves(spark, monkeypatch):
    """A path of more vertices than any fixed bound would reach, in the queries and in their SQL."""
    import duckdb

    from tessera.plans import catalog

    n = 17
    pairs = [(i, i + 1) for i in range(1, n)] + [(n, 1)]
    edges = spark.createDataFrame(pairs, "follower int, followed int")
    monkeypatch.setattr(catalog, "_edges", lambda s, d: edges)
    monkeypatch.setattr(catalog, "_nodes", lambda s, d: spark.createDataFrame([(i,) for i in range(1, n + 1)], "id int"))
    q = catalog.queries()
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT range AS p_partkey FROM range(1, 18)")
    con.execute("CREATE TABLE customer AS SELECT range AS c FROM range(100)")
    con.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, range AS o_custkey FROM range(1, 18)")
    con.execute("CREATE TABLE lineitem AS SELECT range AS l_orderkey, range % 17 + 1 AS l_partkey FROM range(1, 18)")
    sql = lambda name: sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert rows(q["bfs_single_source"](spark, "")) == [(i, i - 1) for i in range(1, n + 1)] == sql("bfs_single_source")
    assert q["bfs_diameter"](spark, "").first().eccentricity == n - 1 == sql("bfs_diameter")[0][0]
    assert rows(q["bfs_trace"](spark, "")) == [*((i, 1) for i in range(1, n)), (n, 0)] == sql("bfs_trace")


def brute_triangles(pairs):
    from collections import Counter

    n, out = Counter(pairs), dict.fromkeys(("multiset", "replicated", "set"), 0)
    for a, b in n:
        for c, d in n:
            if b == c and (d, a) in n:
                out["multiset"] += n[a, b] * n[c, d] * n[d, a]
                out["replicated"] += n[a, b] * n[c, d]
                out["set"] += n[a, b]
    return {k: v // 3 for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_of_random_multigraphs(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = [(rng.randint(1, 12), rng.randint(1, 12)) for _ in range(90)] + [(20, i) for i in range(1, 13)] + [(i, 20) for i in range(1, 8)] + [(3, 3)] * 2
    e = spark.createDataFrame(pairs, "follower int, followed int")
    want = brute_triangles(pairs)
    assert {m: triangles.triangles(e, mode=m).first().triangles for m in want} == want
    assert triangles.triangles(e, most_broadcast=3, strategy="broadcast").first().triangles == want["multiset"]
    assert triangles.triangles_sql(e).first().triangles == want["multiset"]
    assert triangles.triangles(e, simple=True).first().triangles == brute_triangles({(a, b) for a, b in pairs if a != b})["multiset"]


def test_a_hub_is_never_in_the_middle(spark):
    """A vertex with 400 edges in and 400 out, which would make 160,000 two-paths: no pair of edges meets there."""
    pairs = [(i, 1000) for i in range(400)] + [(1000, i) for i in range(400)] + [(i, i + 1) for i in range(399)]
    e = spark.createDataFrame(pairs, "follower int, followed int")
    r = triangles.ranked(triangles.merged(e))
    up, down = r.where("f <= t"), r.where("t < f")
    assert up.alias("u").join(down.alias("w"), F.col("u.follower") == F.col("w.followed")).count() < 2000
    assert triangles.triangles(e).first().triangles == 399


@pytest.mark.parametrize(("most", "hinted"), [(7, False), (8, True)])
def test_broadcast_is_checked(spark, mini_edges, most, hinted):
    for df in (triangles.triangles(mini_edges, strategy="broadcast", most_broadcast=most), triangles.two_paths(mini_edges, strategy="broadcast", most_broadcast=most), triangles.triangles_sql(mini_edges, broadcast=True, most_broadcast=most)):
        assert ("strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()) == hinted


def test_state_files_of_every_pass(spark, mini_edges, mini_nodes, tmp_path):
    first = bfs.first_states(mini_edges, mini_nodes, graph.adjacency(mini_edges, mini_nodes), [1, 2])
    last, updates = bfs.run_states(first, str(tmp_path / "out"))
    got = {r.id: r.sourcesDistance for r in last.collect()}
    want = {r.id: {"1": r.d1, "2": r.d2} for r in bfs.wide(bfs.distances(mini_edges, mini_nodes, [1, 2]), [1, 2]).collect()}
    assert got == want and updates[-1] == 0 and all(updates[:-1])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"out-{i}" for i in range(len(updates) + 1)]
    again, more = bfs.run_states(files.parse_state(spark.read.text(str(tmp_path / "out-1"))), str(tmp_path / "again"))
    assert {r.id: r.sourcesDistance for r in again.collect()} == want and more == updates[1:]
    assert bfs.run_states(first, str(tmp_path / "capped"), max_passes=1)[1] == updates[:1]


def test_kmeans_from_files_of_every_pass(spark, tmp_path):
    (tmp_path / "counts.csv").write_text("1,0\n2,1.0\n3,50\n4,52\n5,100\n")
    points = files.read_points(spark, str(tmp_path / "counts.csv"))
    start = kmeans.starts("spread", 2, 100)
    r = kmeans.run(points, start, out=str(tmp_path / "out"))
    assert r.centroids == kmeans.run(points, start).centroids == kmeans.read_pass(spark, str(tmp_path / f"out-{r.passes}"))
    assert sorted(p.name for p in tmp_path.glob("out-*")) == [f"out-{i}" for i in range(1, r.passes + 1)]
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="(?s).*"):
        files.read_points(spark, str(tmp_path / "bad.csv")).collect()


def test_random_starts_and_seeded_reseeding(spark):
    import random

    points = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    for kind in ("spread", "clumped"):
        got = kmeans.starts(kind, 4, 92, rng=random.Random(1))
        assert got == kmeans.starts(kind, 4, 92, rng=random.Random(1)) and all(0 <= c < 92 for _, c in got)
    spread = [c for _, c in kmeans.starts("spread", 4, 92, rng=random.Random(1))]
    assert all(23 * i <= c < 23 * (i + 1) for i, c in enumerate(spread))
    r = kmeans.run(points, [(1, 5.0), (2, 9000.0)], max_passes=1, reseed=kmeans.seeded(3, highest=50.0))
    assert 0 <= r.centroids[1][1] < 50 and r.centroids == kmeans.run(points, [(1, 5.0), (2, 9000.0)], max_passes=1, reseed=kmeans.seeded(3, highest=50.0)).centroids


def test_histogram_sorted_output_and_chart(spark, mini_edges, mini_nodes, tmp_path):
    from tessera.operators import counts

    found = counts.histogram(counts.follower_count(mini_edges, mini_nodes))
    files.write_csv(found, str(tmp_path / "h"), single_file=True)
    back = files.read_histogram(spark, str(tmp_path / "h"))
    assert sorted((int(r.followers), r.users) for r in back.collect()) == sorted(map(tuple, found.collect()))
    files.write_sorted(mini_edges, str(tmp_path / "s"), "followed", "follower")
    lines = [x for p in sorted((tmp_path / "s").glob("part-*.csv")) for x in p.read_text().splitlines()]
    assert lines == [f"{a},{b}" for a, b in sorted(map(tuple, mini_edges.collect()), key=lambda r: (r[1], r[0]))]
    points = spark.createDataFrame([(float(i), float(i % 7)) for i in range(5000)], "x double, y double")
    for df, most in ((points, 1200), (points.limit(0), 0), (points.limit(1), 1)):
        files.write_chart(df, str(tmp_path / "c"))
        svg = next((tmp_path / "c").glob("part-*")).read_text()
        assert svg.startswith("<svg") and len(svg.split('points="')[1].split('"')[0].split()) <= most


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as cli
    from tessera.plans import catalog

    assert cli.main([]) == 2 and "usage" in capsys.readouterr().err
    assert cli.main(["nothing", "in", "out"]) == 2 and "unknown query" in capsys.readouterr().err
    monkeypatch.setattr(catalog, "_nodes", lambda s, d: s.createDataFrame([(1,), (2,)], "id int"))
    monkeypatch.setattr(catalog, "queries", lambda: {"scan_nodes": catalog._nodes})
    assert cli.main(["scan_nodes", "in", str(tmp_path / "o")]) == 0
    assert sorted(r.id for r in spark.read.option("header", "true").csv(str(tmp_path / "o")).collect()) == ["1", "2"]
