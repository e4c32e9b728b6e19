"""Operators against plain versions on random inputs, many cases in one table with the case as the repository."""

import json
import os
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sourceloom import sources, streaming
from sourceloom.operators import changes, clustering, components, forests, grouping, measures, resolution, source_text, views
from sourceloom.sources.facts import ingest_facts
from sourceloom.sources.store import GraphStore

NODE = "repo string, id string, name string, file string, class_name string, language string, line int"
EDGE = "repo string, source string, target string"


def partition(rows, case="repo", node="id", cluster="cluster_id"):
    out = {}
    for r in rows:
        out.setdefault(r[case], {}).setdefault(r[cluster], set()).add(r[node])
    return {k: {frozenset(s) for s in v.values()} for k, v in out.items()}


def unite(ids, pairs, most=10**9):
    """Disjoint sets after at most ``most`` successful merges."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b and most > 0:
            root[max(a, b)] = min(a, b)
            most -= 1
    sets = {}
    for i in ids:
        sets.setdefault(find(i), set()).add(i)
    return {frozenset(s) for s in sets.values()}


@pytest.mark.parametrize("level", [0.3, 0.666])
def test_connectivity_equals_greedy(spark, level):
    r = random.Random(1)
    nodes, edges, scores, want = [], [], [], {}
    for case in range(40):
        n, repo = r.randrange(1, 12), f"r{case}"
        ids = [f"i{k:02}" for k in range(n)]
        files = {i: r.choice(["f", "g", None]) for i in ids}
        score = {i: r.choice([0.0, 0.25, 0.5, 0.75]) for i in ids}
        own = sorted({(r.choice(ids), r.choice(ids)) for _ in range(r.randrange(0, 2 * n))})
        nodes += [(repo, i, i, files[i], None, None, 1) for i in ids]
        edges += [(repo, a, b) for a, b in own] + [(repo, "::MAIN::0", ids[0]), (repo, ids[0], "unknown")]
        scores += [(repo, i, score[i]) for i in ids]
        weight = lambda e: (score[e[0]] + score[e[1]]) - (0.05 if files[e[0]] and files[e[0]] == files[e[1]] else 0.0)  # noqa: B023, E731
        want[repo] = unite(ids, sorted((e for e in own if e[0] != e[1]), key=lambda e: (weight(e), e)), int(((0.999 - level) / 0.998) * max(0, n - 1)))  # noqa: B023
    got = clustering.cluster_by_connectivity(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(scores, "repo string, id string, score double"), level)
    assert partition(got.collect()) == want


def random_weights(r, n, dense):
    """Edges of some repositories with few different weights, and the merges of a greedy loop over them."""
    rows, merges = [], {}
    for case in range(6):
        ids = [f"i{k:03}" for k in range(n)]
        own = {(r.choice(ids), r.choice(ids)): r.choice([0.5, 1.0, 2.0, 3.5]) for _ in range(dense * n)}
        rows += [(f"r{case}", a, b, w, 0) for (a, b), w in own.items()]
        done, taken = {i: i for i in ids}, []
        for w, a, b in sorted((w, a, b) for (a, b), w in own.items() if a != b):
            if done[a] != done[b]:
                taken.append((a, b, w))
                old, new = max(done[a], done[b]), min(done[a], done[b])
                done = {i: new if c == old else c for i, c in done.items()}
        merges[f"r{case}"] = taken
    return rows, merges


@pytest.mark.parametrize(("packet", "n", "dense"), [(1 << 19, 40, 3), (64, 60, 1), (9, 50, 2), (25, 40, 8)])
def test_forest_tree_and_all_levels(spark, packet, n, dense):
    """A small packet forces thinning, contraction and halving; the forest, and the clusters of every number of merges, equal the greedy loop's."""
    rows, merges = random_weights(random.Random(packet), n, dense)
    weighted = spark.createDataFrame(rows, "repo string, source string, target string, weight double, ord long").repartition(5)
    forest = forests.minimum_spanning_forest(weighted, packet).collect()
    assert sorted((x.repo, x.source, x.target, x.weight) for x in forest) == sorted((repo, *e) for repo, own in merges.items() for e in own)
    tree = forests.merge_tree(spark.createDataFrame(forest, weighted.schema), packet)
    asked = [(repo, float(k), f"i{i:03}", k) for repo in merges for k in (0, 1, 2, 5, n // 2, n - 2, n) for i in range(n)]
    cuts = forests.level_cuts(spark.createDataFrame(asked, "repo string, level double, id string, k long"), tree).collect()
    assert len(cuts) == len(asked)
    got = {}
    for x in cuts:
        got.setdefault((x.repo, x.level), {}).setdefault(x.cluster_id, set()).add(x.id)
    for (repo, k), sets in got.items():
        assert {frozenset(s) for s in sets.values()} == unite([f"i{i:03}" for i in range(n)], [e[:2] for e in merges[repo][: int(k)]])
        assert all(c == min(s) for c, s in sets.items())


def test_levels_from_one_tree_equal_single_runs(spark):
    r = random.Random(8)
    ids = [f"i{k:02}" for k in range(50)]
    nodes = spark.createDataFrame([(repo, i, i, None, None, None, 1) for repo in "xy" for i in ids] + [("x", "::MAIN::0", "MAIN", None, None, None, 0)], NODE)
    edges = spark.createDataFrame(list({(repo, r.choice(ids), r.choice(ids)) for repo in "xy" for _ in range(90)}), EDGE)
    scores = spark.createDataFrame([(repo, i, r.random()) for repo in "xy" for i in ids], "repo string, id string, score double")
    tree = forests.merge_tree(forests.minimum_spanning_forest(clustering.edge_weights(nodes, edges, scores)))
    levels = [0.0, 0.1, 0.5, 0.9, 1.0]
    every = clustering.cluster_levels(nodes, tree, levels).collect()
    for level in levels:
        one = {(x.repo, x.id, x.cluster_id) for x in clustering.cluster_by_connectivity(nodes, edges, scores, level).collect()}
        assert {(x.repo, x.id, x.cluster_id) for x in every if x.level == level} == one and len(one) == 100


@pytest.mark.parametrize("mode", ["file", "class"])
def test_structure_equals_greedy(spark, mode):
    r = random.Random(2)
    nodes, want, labels = [], {}, {}
    for case in range(60):
        repo, rows = f"r{case}", []
        for k in range(r.randrange(1, 10)):
            file = "/".join([r.choice(["", "a"]), *(r.choice("bc") for _ in range(r.randrange(0, 4))), r.choice("xyz") + ".py"])
            rows.append((repo, f"i{k:02}", f"n{k}", r.choice([file, file, None]), r.choice([None, "K", "L"]), "python", 1))
        nodes += rows
        key = lambda x: (x[3] or "") + "::" + x[4] if mode == "class" and x[4] else x[1] if mode == "class" or not x[3] else x[3]
        groups = {}
        for x in rows:
            groups.setdefault(key(x), []).append(x[1])
        names = sorted(groups, key=lambda g: min(groups[g]))  # noqa: B023
        parts = {g: re.split(r"[/\\]", g.split("::")[0]) for g in names}
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(parts[a], parts[b])) if x != y), min(len(parts[a]), len(parts[b])))  # noqa: B023, E731
        pairs = sorted(((a, b) for k, a in enumerate(names) for b in names[k + 1 :]), key=lambda p: -common(*p))
        place = {g: k for k, g in enumerate(names)}
        sets = unite(range(len(names)), [(place[a], place[b]) for a, b in pairs], int(((0.999 - 0.4) / 0.998) * max(0, len(names) - 1)))
        want[repo] = {frozenset(i for g in s for i in groups[names[g]]) for s in sets}
        labels[repo] = len(want[repo])
    assignment, named = clustering.cluster_by_structure(spark.createDataFrame(nodes, NODE), mode, 0.4)
    assert partition(assignment.collect()) == want
    assert {r.repo: r["count"] for r in named.groupBy("repo").count().collect()} == labels


def test_structural_labels_and_project_name(spark):
    row = lambda k, f: ("r", f"i{k}", f"n{k}", f, None, None, 1)
    nodes = spark.createDataFrame([row(0, "/a/b/c.ts"), row(1, "/a/b/d.ts"), row(2, "/x/y.ts")], NODE)
    assignment, labels = clustering.cluster_by_structure(nodes, "file", 0.3)
    assert {r.label for r in labels.collect()} == {"b", "y.ts"}
    assert partition(assignment.collect())["r"] == {frozenset({"i0", "i1"}), frozenset({"i2"})}
    named = clustering.project_name(spark.createDataFrame([row(0, "/home/me/app/a.py"), row(1, "/home/me/app/b.py")], NODE))
    assert [r.name for r in named.collect()] == ["app"]
    assert [r.name for r in clustering.project_name(nodes).collect()] == ["Project"]


def test_detail_view_at_each_level(spark):
    nodes = spark.createDataFrame([("r", k, k, f, None, "python", 1) for k, f in (("a", "f"), ("b", "f"), ("c", "g"), ("library::m::x", None))], NODE)
    nodes = nodes.withColumn("is_library", F.col("id").startswith("library")).withColumn("library_name", F.when(F.col("is_library"), F.lit("m")))
    edges = spark.createDataFrame([("r", "::MAIN::0", "a"), ("r", "a", "b"), ("r", "b", "c"), ("r", "c", "library::m::x")], EDGE).withColumn("is_library", F.col("target").startswith("library"))
    for level, mode, n, links in ((0.0, "connectivity", 1, 0), (0.5, "connectivity", 2, 1), (0.5, "file", 2, 1)):
        shown, lines = clustering.detail_view(nodes, edges, level, mode)
        got = shown.collect()
        assert sum(not r.is_library for r in got) == n, (level, mode)
        assert {r.label for r in got if r.is_library} == {"m (1)"}
        assert lines.where("not is_library").count() == links
        assert lines.where("is_library").count() == 1


def test_detail_view_makes_its_graph_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    nodes = spark.createDataFrame([("r", k, k, "f", None, "python", 1) for k in "abc"], NODE).withColumn("is_library", F.lit(False)).withColumn("library_name", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("r", "::MAIN::0", "a"), ("r", "a", "b"), ("r", "b", "c")], EDGE).withColumn("is_library", F.lit(False))
    shown, lines = clustering.detail_view(nodes, edges.mapInArrow(counted, edges.schema), 1.0)
    assert (shown.count(), lines.count(), made.value) == (3, 2, 3)


def test_members_of_clusters_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    nodes = spark.createDataFrame([("r", k, k.upper(), k, None, "python", 1) for k in "abc"], NODE)
    edges = spark.createDataFrame([("r", "::MAIN::0", "a"), ("r", "a", "b"), ("r", "b", "c")], EDGE)
    scores = spark.createDataFrame([("r", "a", 0.1), ("r", "b", 0.7)], "repo string, id string, score double")
    assignment = spark.createDataFrame([("r", "a", "a"), ("r", "b", "a"), ("r", "c", "c")], "repo string, id string, cluster_id string")
    shown = clustering.cluster_nodes(assignment.mapInArrow(counted, assignment.schema), nodes, edges, scores, 0.5)
    got = {(r.id, r.label, r.n, r.is_cluster, r.is_entry, r.file) for r in shown.collect()}
    assert got == {("a", "B +1", 2, True, False, None), ("c", "C", 1, False, False, "c")}
    assert (shown.count(), made.value) == (2, 3)


def test_depth_of_a_long_chain_and_loops(spark):
    n = 20
    nodes = spark.createDataFrame([("r", f"i{k}") for k in range(n + 2)], "repo string, id string")
    edges = spark.createDataFrame([("r", f"i{k}", f"i{k + 1}") for k in range(n)] + [("r", f"i{n}", "i3"), ("r", "::MAIN::0", "i0"), ("r", "i5", "nowhere")], EDGE)
    got = {r.id: r.depth for r in measures.bfs_depth(nodes, edges).collect()}
    assert got == {**{f"i{k}": k for k in range(n + 1)}, f"i{n + 1}": n + 1}
    empty = measures.bfs_depth(nodes, edges.where("source = 'none'"))
    assert {(r.depth, r.max_depth) for r in empty.collect()} == {(2, 1)}


def test_depth_of_random_graphs_equals_a_plain_walk(spark):
    r = random.Random(12)
    nodes, edges, want = [], [], {}
    for case in range(60):
        n, repo = r.randrange(2, 40), f"r{case}"
        out = {k: {r.randrange(n) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))} for k in range(n)}
        starts = {r.randrange(n) for _ in range(r.choice([0, 1, 2]))}
        nodes += [(repo, f"i{k}") for k in range(n)]
        edges += [(repo, f"i{a}", f"i{b}") for a, bs in out.items() for b in bs] + [(repo, "::MAIN::0", f"i{k}") for k in starts] + [(repo, "i0", "nowhere"), (repo, "nowhere", "i1")]
        depth, front = dict.fromkeys(starts, 0), list(starts)
        while front:
            front = [b for a in front for b in out[a] if b not in depth and not depth.update({b: depth[a] + 1})]
        most = max(1, *depth.values(), 1)
        want |= {(repo, f"i{k}"): (depth.get(k, most + 1), most) for k in range(n)}
    got = measures.bfs_depth(spark.createDataFrame(nodes, "repo string, id string"), spark.createDataFrame(edges, EDGE))
    assert {(x.repo, x.id): (x.depth, x.max_depth) for x in got.collect()} == want


def test_depth_of_repeated_calls_and_strange_ends_moves_few_rows(spark, monkeypatch):
    from sourceloom.plans.durable import Workspace

    tables, keep = [], Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df: tables.append(df.count()) or keep(self, df))
    n = 64
    nodes = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("i"), "id").alias("id"))
    chain = spark.range(n - 1).select(F.lit("r").alias("repo"), F.concat(F.lit("i"), "id").alias("source"), F.concat(F.lit("i"), F.col("id") + 1).alias("target"))
    strange = spark.createDataFrame([("r", "::MAIN::0", "i0"), ("r", "nobody", "i5"), ("r", "i5", "nobody"), ("r", "i7", "i7")], EDGE)
    edges = chain.unionByName(chain).unionByName(strange)
    tables.append(edges.count())
    got = measures.bfs_depth(nodes, edges, kept=True)
    assert {x.id: x.depth for x in got.collect()} == {f"i{k}": k for k in range(n)}
    # ids, entry, anchors' rows not settled before (64, 63, 62, 60, 56, 48, 32), the entry's layer and an empty one, no links, depths
    assert sum(tables[1:]) == 64 + 1 + 385 + 1 + 64


def test_depth_of_ten_thousand_in_few_rounds(spark, monkeypatch):
    from sourceloom.plans.durable import Workspace

    tables, keep = [], Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df: tables.append(1) or keep(self, df))
    n = 10_000
    nodes = spark.range(n + 3).select(F.lit("r").alias("repo"), F.concat(F.lit("i"), "id").alias("id"))
    chain = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("i"), "id").alias("source"), F.concat(F.lit("i"), F.col("id") + 1).alias("target"))
    more = spark.createDataFrame([("r", "::MAIN::0", "i0"), ("r", f"i{n + 1}", f"i{n + 2}"), ("r", f"i{n + 2}", f"i{n + 1}")], EDGE)
    got = measures.bfs_depth(nodes, chain.unionByName(more))
    assert got.where(F.col("id") == F.concat(F.lit("i"), "depth")).count() == n + 2  # the first node of the circle has the number of its depth
    assert {x.depth for x in got.where(f"id in ('i{n + 1}', 'i{n + 2}')").collect()} == {n + 1}
    assert len(tables) < 40


def test_components_of_a_long_path(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(7, 7), (None, 3), (9001, 9002)], "a long, b long"))
    got = {r.node: r.component for r in components.star_components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 9001: 9001, 9002: 9001}


@pytest.mark.parametrize("packet", [1 << 19, 12])
def test_component_labels_equal_plain_sets(spark, packet):
    rows, _ = random_weights(random.Random(1), 30, 1)
    rows += [("tiny", "b", "a", 1.0, 0), ("tiny", "c", "c", 1.0, 0)]
    edges = spark.createDataFrame([r[:3] for r in rows], EDGE).repartition(4)
    got = forests.component_labels(edges, packet).collect()
    assert len({(x.repo, x.id) for x in got}) == len(got)
    for repo in {r[0] for r in rows}:
        ids = {i for r in rows if r[0] == repo and r[1] != r[2] for i in r[1:3]}
        assert {x.id: x.cluster_id for x in got if x.repo == repo} == {i: min(s) for s in unite(sorted(ids), [r[1:3] for r in rows if r[0] == repo and r[1] != r[2]]) for i in s} if ids else True


@pytest.mark.parametrize("repo", ["'shop'", "concat('r', id & 31)"])
def test_components_of_edges_that_have_no_nulls(spark, repo):
    # A task holds several packets, so stars, which may have nulls by their type, meet edges that may not.
    edges = spark.range(0, 60000, 1, 1).selectExpr(f"{repo} as repo", "concat('a', id & 255) as source", "concat('b', id & 511) as target")
    rows = edges.distinct().collect()
    want = {}
    for r in {r.repo for r in rows}:
        pairs = [(x.source, x.target) for x in rows if x.repo == r]
        want[r] = unite({i for p in pairs for i in p}, pairs)
    got = forests.component_labels(edges, 2000 if "id" in repo else 5000).collect()
    assert partition(got) == want
    assert all(r.cluster_id == min(s) for r in got for s in want[r.repo] if r.id in s)


def test_hunks_equal_nested_loops(spark):
    r = random.Random(4)
    nodes, hunks = [], []
    for case in range(80):
        for f in "fg":
            lines = sorted(r.randrange(1, 900) for _ in range(r.randrange(0, 8)))
            nodes += [(f"r{case}", f"{f}{k}", f, line) for k, line in enumerate(lines)]
            for _ in range(r.randrange(0, 6)):
                start = r.randrange(1, 900)
                hunks.append((f"r{case}", f, start, start + r.choice([0, 1, 30, 600]), r.random() < 0.4))
    want = {}
    for repo, i, f, line in nodes:
        after = sorted(x[3] for x in nodes if x[0] == repo and x[2] == f and (x[3], x[1]) > (line, i))
        end = after[0] - 1 if after else 10**9
        met = [h for h in hunks if h[:2] == (repo, f) and h[2] <= end and h[3] >= line]
        want[repo, i] = None if not met else "added" if any(h[4] and h[2] <= line <= h[3] for h in met) else "modified"
    ranges = changes.node_ranges(spark.createDataFrame(nodes, "repo string, id string, file string, line int"))
    got = changes.hunk_status(ranges, spark.createDataFrame(hunks, "repo string, file string, start int, end int, is_new boolean"))
    assert {(x.repo, x.id): x.status for x in got.collect()} == want


def test_extents_equal_line_loops(spark):
    r = random.Random(5)
    files, python, braces = [], {}, {}
    for case in range(60):
        lines = [r.choice(["", " ", "  "]) * r.randrange(3) + r.choice(["def f", "x", "", "{", "}", "{ }", "} {"]) for _ in range(r.randrange(1, 12))]
        files.append(("r", f"f{case}", "\n".join(lines)))
        for k, line in enumerate(lines):
            if not line.strip().startswith("def f"):
                continue
            indent = len(line) - len(line.lstrip())
            later = [j for j in range(k + 1, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent]
            python[f"f{case}:{k + 1}"] = later[0] if later else len(lines)
            depth, seen, end = 0, False, len(lines)
            for j in range(k, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                seen = seen or "{" in lines[j]
                if seen and depth == 0:
                    end = j + 1
                    break
                if not seen and j == k + 1:
                    end = k + 1
                    break
            braces[f"f{case}:{k + 1}"] = end
    lines = source_text.source_lines(spark.createDataFrame(files, "repo string, file string, text string"))
    starts = lines.where(F.trim("text").startswith("def f")).select("repo", F.concat_ws(":", "file", F.col("line").cast("string")).alias("id"), "file", "line")
    assert {x.id: x.end for x in source_text.extents_by_indentation(starts, lines).collect()} == python
    assert {x.id: x.end for x in source_text.extents_by_braces(starts, lines).collect()} == braces


def test_corpus_scan_and_graph_documents(spark, tmp_path):
    for path, text in (("a b/x.py", "é = 1"), ("a b/y.py", ""), ("a b/__init__.py", "init"), ("src[1]/_k.ts", "k"), ("src[1]/{x}.tsx", "x"), ("out/z.py", "1"), ("__pycache__/c.py", "1"), ("__pycache__/d.ts", "2"), (".git/e.js", "1"), ("f.d.ts", "1"), ("a%20b.mjs", "m"), ("n.txt", "1")):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_bytes(text.encode() + (b"\xff" if path == "a%20b.mjs" else b""))
    got = sources.scan_corpus(spark, str(tmp_path / "src"), "r").collect()
    assert {x.path for x in got if x.reason} == {"a%20b.mjs"}
    few = spark.read.format("source_corpus").option("repo", "r").option("folders", 1).load(str(tmp_path / "src"))
    assert few.rdd.getNumPartitions() == 1 and sorted(map(tuple, few.collect())) == sorted(map(tuple, got))
    assert {(x.path, x.language, x.text) for x in got} == {("a b/x.py", "python", "é = 1"), ("a b/y.py", "python", ""), ("a b/__init__.py", "python", "init"), ("src[1]/_k.ts", "typescript", "k"), ("src[1]/{x}.tsx", "typescript", "x"), ("__pycache__/d.ts", "typescript", "2"), ("a%20b.mjs", "javascript", "m")}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "a", "file": "", "line": 1}], "edges": [{"source": "a", "target": "b", "isLibraryEdge": True}]}))
    (tmp_path / "g" / "bad.json").write_text("{")
    nodes, edges, files = sources.read_graph_json(spark, str(tmp_path / "g"), "r")
    assert [(x.id, x.file, x.is_library) for x in nodes.collect()] == [("a", None, False)]
    assert edges.where("is_library").count() == 1 and files.count() == 0
    sources.write_graph(nodes, edges, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w" / "nodes")).count() == 1


def test_layouts_round_trip(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"version":1}')
    (tmp_path / "a.json").write_text('{"version":1,"name":"N","description":"d"}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("{}")
    got = sources.read_layouts(spark, str(tmp_path)).collect()
    assert [(x.file, x.name, x.description) for x in got] == [("a.json", "N", "d"), ("b.json", "b", "")]
    rows = [("my/plan", "2024-01-02", "new", '{"repel":1.5,"on":true,"s":["a"]}'), ("my_plan", "2024-01-01", "old", None), ("other é", "t", None, None)]
    layouts = spark.createDataFrame(rows, "name string, saved_at string, description string, settings string").repartition(3)
    places = spark.createDataFrame([("my/plan", "i", 1.0, 2.0), ("my/plan", "j", None, 2.0), ("my_plan", "k", 1.0, 1.0)], "name string, id string, x double, y double")
    folder = str(tmp_path / "out")
    for _ in range(2):  # saved again: still one document a layout
        sources.write_layouts(layouts, places, folder)
        assert sorted(os.listdir(folder)) == ["my_plan.json", "other _.json"]
        back = sources.read_layouts(spark, folder).collect()
        assert [(x.name, x.saved_at, x.description) for x in back] == [("my/plan", "2024-01-02", "new"), ("other é", "t", "")]
        assert json.loads(back[0].settings) == {"repel": 1.5, "on": True, "s": ["a"]} and back[1].settings is None
        assert {k: (v.x, v.y) for k, v in back[0].node_positions.items()} == {"i": (1.0, 2.0)} and back[1].node_positions == {}
    sources.write_layouts(layouts.where("name = 'my_plan'"), places, folder)
    assert [x.name for x in sources.read_layouts(spark, folder).collect()] == ["my_plan", "other é"]
    bad = spark.createDataFrame([("a.json", "{}"), ("../b.json", "{}")], "file string, text string")
    with pytest.raises(Exception, match="not a place below"):
        sources.write_documents(bad, folder)
    assert sorted(os.listdir(folder)) == ["my_plan.json", "other _.json"]
    sources.write_documents(bad.limit(1), folder, "overwrite")
    assert os.listdir(folder) == ["a.json"]


def test_feeds_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02}", "k", f"e{s}") for s in (0, 1, 2, 10, 11)] + [("2024-01-01 01:00:00", "z", "end")]
    events = spark.createDataFrame(rows, "ts string, id string, status string").select(F.to_timestamp("ts").alias("ts"), "id", "status", F.lit("r").alias("repo"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    fired = run(lambda s: streaming.debounce(s, "id", "2 seconds", late="0 seconds"), "append", "fired")
    assert {(x.id, str(x.fire_at)[-8:], x.n) for x in fired} == {("k", "00:00:04", 3), ("k", "00:00:13", 2)}
    assert {(x.id, x.status) for x in run(streaming.latest_status, "update", "latest")} == {("k", "e11"), ("z", "end")}
    assert {x.id: str(x.ts)[-8:] for x in run(streaming.first_seen, "update", "first")} == {"k": "00:00:00", "z": "01:00:00"}
    edges = run(lambda s: streaming.stream_edges(s.withColumn("source", F.col("id")).withColumn("target", F.lit("t"))), "append", "edges")
    assert sorted(x.source for x in edges) == ["k", "z"]


def test_changed_files_replace_their_facts(spark, tmp_path):
    facts = "repo string, file string, name string"
    spark.createDataFrame([("r", "a", "old"), ("r", "b", "kept")], facts).write.parquet(str(tmp_path / "0"))
    state = {"n": 0}

    def write(df):
        df.write.parquet(str(tmp_path / str(state["n"] + 1)))
        state["n"] += 1

    extract = lambda files: files.select("repo", "file", F.explode(F.split("text", " ")).alias("name")).where("name <> ''")
    apply = streaming.on_change(extract, lambda: spark.read.parquet(str(tmp_path / str(state["n"]))), write)
    saved = spark.createDataFrame([("r", "a", "x", 1), ("r", "a", "new two", 2), ("r", "c", "", 1)], "repo string, file string, text string, ts int")
    saved.coalesce(1).write.parquet(str(tmp_path / "saves"))
    stream = spark.readStream.schema(saved.schema).parquet(str(tmp_path / "saves"))
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(x.file, x.name) for x in spark.read.parquet(str(tmp_path / "1")).collect()} == {("a", "new"), ("a", "two"), ("b", "kept")}


def test_comments_of_any_length_and_lines(spark):
    long = "/** " + "word " * 200_000 + "*/\nfunction big(x) {}\n"
    many = "/**\n * one\n *   two \n *\n * @tag no\n */\nexport function lines<T>() {}\n/** @only tag */\nfunction lines() {}\n" + " " * 300 + "/** star * in / it */ function star() {}"
    declared = spark.createDataFrame([("p", 0, "a", "/** @x */ function big() {}"), ("p", 1, "b", long), ("p", 1, "c", many)], "package string, rank int, file string, text string")
    wanted = spark.createDataFrame([("p", n) for n in ("big", "lines", "star", "none")], "package string, name string")
    got = {r.name: r.doc for r in resolution.doc_comments(wanted, declared).collect()}
    assert got == {"big": ("word " * 200_000).strip(), "lines": "one\ntwo", "star": "star * in / it", "none": ""}


def test_bindings_in_the_order_of_the_text(spark):
    cases = {
        "var a = require('zeta')\nvar a = require('beta')": {"a": "beta"},
        "var a = require('beta')\nvar a = require('zeta')": {"a": "zeta"},
        "const a = require('x'), b = require('y')": {"a": "x", "b": "y"},
        "const k = 1, { c, d: e, f = 2 } = require( \"z\" ).part, g = require('./rel')\nfoo(a, h = require('no'))": {"c": "z", "e": "z", "f": "z"},
        "import D, { x as y, type T } from 'm'\nimport * as ns from 'n'\nimport type { U } from 'u'\nimport E, * as all from 'e'\nimport 'side'\nimport r from '../r'": {"D": "m", "y": "m", "T": "m", "ns": "n", "U": "u", "E": "e", "all": "e"},
        "import {\n  a,\n  b as c,\n} from 'many'\nlet q = require('q')": {"a": "many", "c": "many", "q": "q"},
    }
    files = spark.createDataFrame([("r", str(k), text) for k, text in enumerate(cases)], "repo string, file string, text string")
    got = {}
    for r in source_text.scan_js_imports(files).collect():
        got.setdefault(r.file, {})[r.local] = r.module
    assert got == {str(k): want for k, want in enumerate(cases.values())}


def test_diff_paths_with_blanks_and_line_ends(spark):
    text = "+++ b/a b.py\t\n@@ -1 +2,3 @@\n+++ b/c.py\r\n@@ -1,0 +5 @@\r\n"
    got = changes.parse_diff(spark.createDataFrame([("r", "/w", False, text)], "repo string, root string, staged boolean, text string")).collect()
    assert {(x.file, x.start, x.end, x.is_new) for x in got} == {("/w/a b.py", 2, 4, False), ("/w/c.py", 5, 5, True)}


def test_stored_graph_joins_without_moving_it(spark, tmp_path):
    r = random.Random(3)
    ids = [f"i{k}" for k in range(60)]
    nodes = spark.createDataFrame([(repo, i) for repo in "xy" for i in ids], "repo string, id string").withColumn("file", F.lit("f"))
    edges = spark.createDataFrame(list({(repo, r.choice(ids), r.choice(ids)) for repo in "xy" for _ in range(200)}) + [("x", "::MAIN::0", "i1")], EDGE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        GraphStore(spark, str(tmp_path / "g"), "stored", 4).save(nodes, edges)
        for name in ("nodes", "calls_out", "calls_in", "files"):
            spark.sql(f"DROP TABLE stored_{name}")
        store = GraphStore(spark, str(tmp_path / "g"), "again", 4).open()
        degrees = store.degrees()
        assert "Exchange" not in degrees._jdf.queryExecution().executedPlan().toString()
        assert {(x.repo, x.id): x.degree for x in degrees.collect()} == {(x.repo, x.id): x.degree for x in measures.degrees(nodes, edges).collect()}
        rendered = store.table("nodes").select("repo", "id", F.substring("id", 1, 2).alias("rendered"))
        got = store.quotient(rendered)
        want = grouping.quotient_edges(edges, rendered)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        half = store.table("calls_out").join(rendered.withColumnRenamed("id", "source"), ["repo", "source"])
        assert "Exchange" not in half._jdf.queryExecution().executedPlan().toString()
        front = store.callees(nodes.where("id = 'i3'"))
        assert sorted(map(tuple, front.collect())) == sorted(map(tuple, edges.where("source = 'i3'").collect()))
        assert front._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") <= 2
        for name in ("nodes", "calls_out", "calls_in", "files"):
            spark.sql(f"DROP TABLE again_{name}")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_degrees_without_edges(spark):
    r = random.Random(7)
    definitions = [("r", lang, f"{lang}{k}", f"n{r.randrange(8)}") for lang in ("python", "javascript") for k in range(30)]
    calls = [("r", lang, r.choice(definitions)[2], *r.choice([("bare", None), ("attr", "self"), ("attr", "x")]), f"n{r.randrange(9)}") for lang in ("python", "javascript") for _ in range(120)]
    d = spark.createDataFrame(definitions, "repo string, language string, id string, name string")
    c = spark.createDataFrame(calls, "repo string, language string, caller_id string, kind string, obj string, name string")
    edges = [(x.source, x.target) for x in resolution.resolve_calls(d, c).collect()]
    got = {x.id: (x.in_degree, x.out_degree, x.degree) for x in resolution.factored_degrees(d, c).collect()}
    assert got == {i: (sum(b == i for _, b in edges), sum(a == i for a, _ in edges), sum((a == i) + (b == i) for a, b in edges)) for *_, i, _ in definitions}
    n = 10_000
    many = spark.range(n).select(F.lit("r").alias("repo"), F.lit("python").alias("language"), F.concat(F.lit("d"), "id").alias("id"), F.lit("run").alias("name"))
    callers = many.select("repo", "language", F.col("id").alias("caller_id"), F.lit("bare").alias("kind"), F.lit(None).cast("string").alias("obj"), "name")
    assert resolution.factored_degrees(many, callers).select("in_degree", "out_degree").distinct().collect() == [(n - 1, n - 1)]


def test_folder_tables_equal_predicates(spark):
    r = random.Random(10)
    path = lambda k: "".join(r.choice("ab") + r.choice("/\\\\/") for _ in range(k))
    files = [r.choice(["", "/"]) + path(r.randrange(0, 5)) + "f.py" for _ in range(200)] + [None, ""]
    view = spark.createDataFrame([("r", f"i{k}", f, f"l{k}", k % 11 == 0, 1) for k, f in enumerate(files)], "repo string, id string, file string, label string, is_library boolean, line int")
    folders = sorted({r.choice(["", "/"]) + path(r.randrange(0, 3)).rstrip("/\\") for _ in range(6)} | {"(root)"})
    table = spark.createDataFrame([("r", f) for f in folders], "repo string, folder string")
    ids = lambda df: sorted(x.id for x in df.collect())
    got = ids(views.visible_nodes(view, view, hidden=table))
    assert got == ids(views.visible_nodes(view, view, hidden_folders=tuple(folders))) and 0 < len(got) < 202
    assert ids(views.visible_nodes(view, view, shown=table.where(F.col("folder") == folders[-1]))) == ids(views.visible_nodes(view, view, only_folder=folders[-1]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = spark.range(10_000).select(F.lit("r").alias("repo"), F.concat(F.lit("/far/"), "id").alias("folder")).unionByName(table)
        shown = views.visible_nodes(view, view, hidden=many)
        assert ids(shown) == got and "Broadcast" not in shown._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quarantine_loses_no_record(spark):
    definition = lambda **x: json.dumps({"repo": "r", "language": "python", "id": "a", "name": "f", "file": "x.py", "line": 1} | x)
    texts = [definition(), definition(), definition(line=3), definition(id="b"), definition(id="b", name="g"), definition(id=""), definition(name=None), definition(line="three"), definition(line=-1), "{broken", "[]", "", None, definition(repo=None)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    watch = Observation()
    taken, rejected = ingest_facts(rows, "definitions", watch)
    assert {(x.id, x.name, x.line) for x in taken.collect()} == {("a", "f", 3), ("b", "g", 1)}
    assert watch.get == {"taken": 2, "files": 1}
    lost = rejected.collect()
    assert len(lost) == len(texts) - 2
    want = {"repeated id": 3, "no id": 1, "no name": 1, "no record of this kind": 5, "line below 0": 1, "no repo": 1}
    assert {k: sum(x.reason == k for x in lost) for k in want} == want
    calls = spark.createDataFrame([(json.dumps({"repo": "r", "language": "python", "caller_id": "c", "kind": k, "obj": o, "name": "f"}),) for k, o in (("bare", None), ("attr", "x"), ("attr", None), ("other", "x"), (None, None))], "text string")
    taken, rejected = ingest_facts(calls, "calls")
    assert taken.count() == 2 and sorted(x.reason for x in rejected.collect()) == ["neither bare nor attr", "neither bare nor attr", "no object"]
    imports = spark.createDataFrame([('{"repo":"r","language":"python","file":"f","local":"x","module":"m","ord":1}',), ('{"repo":"r","language":"python","file":"f","local":"","module":"m"}',)], "text string")
    taken, rejected = ingest_facts(imports, "imports")
    assert taken.count() == 1 and [x.reason for x in rejected.collect()] == ["no local name"]


def test_small_components_of_a_large_repository_need_no_halving(spark):
    """A repository of many packets whose components are small is parted into them, each merged and cut by a task; the levels are a greedy loop's."""
    n = 120
    own = [(f"i{k:03}{j}", f"i{k:03}{j + 1}", float((k * 7 + j * 5) % 11)) for k in range(n) for j in range(4)]
    weighted = spark.createDataFrame([("r", a, b, w, 0) for a, b, w in own], "repo string, source string, target string, weight double, ord long").repartition(3)
    nodes = spark.createDataFrame([("r", f"i{k:03}{j}") for k in range(n) for j in range(5)] + [("r", "single")], "repo string, id string")
    tree = forests.merge_tree(forests.minimum_spanning_forest(weighted, 40), 40)
    got = clustering.cluster_levels(nodes, tree, [0.3, 0.7]).collect()
    assert all(x.part for x in tree.collect()) and len(got) == 2 * (5 * n + 1)
    for level in (0.3, 0.7):
        budget = int(((0.999 - level) / 0.998) * 5 * n)
        want = unite([x.id for x in nodes.collect()], [e[:2] for e in sorted(own, key=lambda e: (e[2], e[:2]))][:budget])
        sets = {}
        for x in got:
            if x.level == level:
                sets.setdefault(x.cluster_id, set()).add(x.id)
        assert {frozenset(s) for s in sets.values()} == want and all(c == min(s) for c, s in sets.items())


def test_forest_is_parted_before_edges_are_weighed(spark):
    """Parts come from the bare edges of a repository of many packets, with the entry node and unknown ends left out, and whole trees of them with the edges; the forest is the one of the weighed edges."""
    r = random.Random(12)
    own = [(repo, f"i{k:02}{r.randrange(6)}", f"i{k:02}{r.randrange(6)}") for repo, n in (("wide", 40), ("small", 3)) for k in range(n) for _ in range(9)]
    nodes = spark.createDataFrame([(repo, f"i{k:02}{j}", f"i{k:02}{j}", r.choice(["f", None]), None, None, 1) for repo in ("wide", "small") for k in range(40) for j in range(6)], NODE)
    edges = spark.createDataFrame([*own, *(("wide", "::MAIN::0", f"i{k:02}0") for k in range(40)), ("wide", "i010", "unknown")], EDGE)
    scores = spark.createDataFrame([(repo, f"i{k:02}{j}", r.choice([0.0, 0.5, 1.0])) for repo in ("wide", "small") for k in range(40) for j in range(6)], "repo string, id string, score double")
    got = clustering.spanning_forest(nodes, edges, scores, 40).collect()
    want = forests.minimum_spanning_forest(clustering.edge_weights(nodes, edges, scores)).collect()
    assert sorted(x[:5] for x in got) == sorted(tuple(x) for x in want)
    parts = {}
    for x in got:
        parts.setdefault((x.repo, x.source[:3]), set()).add(x.part)
    assert all(parts[k] == {""} if k[0] == "small" else "" not in parts[k] for k in parts) and len(set().union(*parts.values())) >= 40


@pytest.mark.parametrize("packet", [1 << 20, 20])
def test_contraction_equals_stars(spark, packet):
    n = 300
    path = spark.range(n).selectExpr("struct('r' AS repo, concat('i', id) AS id) AS a", "struct('r' AS repo, concat('i', id + 1) AS id) AS b")
    hub = spark.range(n).selectExpr("struct('s' AS repo, 'hub' AS id) AS a", "struct('s' AS repo, concat('i', id) AS id) AS b")
    got = sorted(map(str, components.contracted_components(path.unionByName(hub), packet).collect()))
    assert got == sorted(map(str, components.star_components(path.unionByName(hub)).collect()))


def test_a_hunk_of_very_many_lines_is_not_dealt_out_by_lines(spark, capsys):
    ranges = spark.createDataFrame([("r", "a", "f", 1, 4), ("r", "b", "f", 5, None)], "repo string, id string, file string, start int, end int")
    hunks = spark.createDataFrame([("r", "f", 3, 2000000000, True)], "repo string, file string, start int, end int, is_new boolean")
    found = changes.hunk_status(ranges, hunks)
    found.explain()
    assert "sequence(" not in capsys.readouterr().out
    assert {x.id: x.status for x in found.collect()} == {"a": "modified", "b": "added"}


def test_extents_deal_their_lines_out_once(spark, capsys):
    lines = spark.createDataFrame([("r", "f", 1, "x"), ("r", "f", 2, "y {"), ("r", "f", 3, "}")], "repo string, file string, line int, text string")
    definitions = spark.createDataFrame([("r", "d", "f", 2), ("r", "lost", "f", 9)], "repo string, id string, file string, line int")
    for extents in (source_text.extents_by_braces, source_text.extents_by_indentation):
        found = extents(definitions, lines)
        found.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
        assert [(x.id, x.start, x.end) for x in found.collect()] == [("d", 2, 3 if extents is source_text.extents_by_braces else 2)]


def test_imports_are_found_without_a_shuffle(spark, capsys):
    found = source_text.scan_js_imports(spark.createDataFrame([("r", "f", "const a = require('x')\nimport a, { b as c } from 'y'\n"), ("r", "g", "")], "repo string, file string, text string"))
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted(map(tuple, found.collect())) == [("r", "f", "a", "y"), ("r", "f", "c", "y")]


def test_documents_are_moved_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver's commit moves no file, a scan's driver lists a bounded number of names, and a folder of any number of files is read by few tasks."""
    from sourceloom.sources import files

    folder = str(tmp_path / "out")
    rows = spark.range(9000).select(F.concat(F.lit("a/b "), F.col("id").cast("string"), F.lit(".json")).alias("file"), F.col("id").cast("string").alias("text")).repartition(1)
    writer = files.DocumentWriter({"path": folder, "job": "j"}, False)
    monkeypatch.setattr(files, "_place", None)  # of the driver only
    writer.commit([files.Staged(["0-0-0"]), None])
    assert os.listdir(folder) == ["_staging-j"] and (tmp_path / "out" / "_staging-j" / "_written").read_text() == "0-0-0"
    writer.abort([])
    monkeypatch.undo()
    sources.write_documents(rows, folder)
    assert os.listdir(folder) == ["a"]
    back = files.read_documents(spark, f"{folder}/a", ".json")
    assert back.rdd.getNumPartitions() == 4 and sorted((x.file, x.text) for x in back.collect()) == sorted((f"b {k}.json", str(k)) for k in range(9000))
    assert files.read_documents(spark, f"{folder}/a", "7.json").count() == 900
    for k in range(3):
        for j in range(40):
            (tmp_path / "src" / f"d{k}" / "e").mkdir(parents=True, exist_ok=True)
            (tmp_path / "src" / f"d{k}" / f"{j}.py").write_text("1")
    listed = []
    reader = files.CorpusReader({"path": str(tmp_path / "src"), "folders": "5"})
    real = reader._listed
    monkeypatch.setattr(reader, "_listed", lambda store, path: listed.append(path) or real(store, path))
    parts = reader.partitions()
    assert len(listed) == 3 and len({x.path for x in parts}) == len(parts)  # the last of the three folders is left to its task
    assert sum(x.num_rows for p in parts for x in files.CorpusReader({"path": str(tmp_path / "src")}).read(p)) == 120


def test_blame_is_read_within_its_row(spark, capsys):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    text = "\n".join(("author-time 1", f"{a} 1 1 2\r", "author-time 7", "author-time 5", "\tauthor-time 99", f"{b} 4 2", f"{a} 2 3", "\tx", f"{a} 2 99999999999", f"{b} 4 4 1", "author-time -3", f"{c} 1 2", f"{b} 9 4", "author-time x", f"{b} 9 5 ", f"{b} 9 6"))
    found = changes.parse_blame(spark.createDataFrame([("r", "f", text), ("r", "g", None), ("r", "h", ""), ("q", "f", f"{b} 1 1\nauthor-time 4")], "repo string, file string, text string"))
    assert sorted((x.repo, x.file, x.line or 0, x.sha, x.author_time) for x in found.collect()) == [("q", "f", 1, b, 4), ("r", "f", 0, a, 7), ("r", "f", 1, a, 7), ("r", "f", 3, a, 7), ("r", "f", 4, b, -3), ("r", "f", 6, b, -3)]
    found.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_calls_are_dealt_out_before_they_are_compared(spark):
    definitions = spark.createDataFrame([("r", "python", "a", "f"), ("r", "python", "b", "g")], "repo string, language string, id string, name string")
    calls = spark.createDataFrame([("r", "python", "a", "bare", None, "g")] * 3 + [("r", "python", "b", "bare", None, "f")], "repo string, language string, caller_id string, kind string, obj string, name string")
    for rows in (resolution.resolve_calls(definitions, calls), resolution.factored_degrees(definitions, calls)):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "REPARTITION_BY_NUM" in plan or "RepartitionByExpression" in plan
    assert {(x.source, x.target) for x in resolution.resolve_calls(definitions, calls).collect()} == {("a", "b"), ("b", "a")}
    assert {(x.id, x.in_degree, x.out_degree) for x in resolution.factored_degrees(definitions, calls).collect()} == {("a", 1, 1), ("b", 1, 1)}
