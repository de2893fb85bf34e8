"""Corrections of segments against recursions over small made-up trees."""

import math

import numpy as np
import pytest

from canopia.operators import branching

LAYERS = "tree_id long, node long, up long, segment long, layer int, x double, y double, z double, top double"


def forest(seed, trees=3, most=9):
    """Segments as chains of layers that begin on a layer of an earlier one."""
    r, rows = np.random.default_rng(seed), []
    for tree in range(1, trees + 1):
        nodes, segments = [], []
        for s in range(int(r.integers(1, most))):
            n, up, at, base = int(r.integers(1, 16)), None, np.zeros(3), 0
            if s:
                chain = segments[int(r.integers(0, len(segments)))]
                up = chain[int(r.integers(0, len(chain)))]
                at, base = up[3], up[2] + 1
            step, chain = r.normal(size=3) * 0.3, []
            for k in range(n):
                at = at + step + r.normal(size=3) * 0.1
                node = [tree * 1000 + len(nodes), None if up is None else up[0], base + k, at, tree * 1000 + (chain[0][0] - tree * 1000 if chain else len(nodes))]
                nodes.append(node)
                chain.append(node)
                up = node
            segments.append(chain)
        rows += [(tree, n[0], n[1], n[4], n[2], *map(float, n[3]), float(n[3][2] + 0.05)) for n in nodes]
    return rows


def recursion(rows, stem_only, tail):
    out = {}
    for tree in {x[0] for x in rows}:
        node = {x[1]: x for x in rows if x[0] == tree}
        kids, last, top = {}, {}, {}
        for x in node.values():
            kids.setdefault(x[2], []).append(x[1])
            last[x[3]] = max(last.get(x[3], (-1, 0)), (x[4], x[1]))
            top[x[3]] = max(top.get(x[3], -math.inf), x[8])
        todo = [(kids[None][0], True, False)]
        while todo:
            head, stem, stays = todo.pop()
            inside, stack = [], [head]
            while stack:
                inside.append(stack.pop())
                stack += kids.get(inside[-1], [])
            ends = [last[s][1] for s in {node[k][3] for k in inside}]
            own = node[head][3]
            if stem:
                tip = min(ends, key=lambda k: (-top[node[k][3]], node[k][3]))
            elif stays:
                tip = last[own][1]
            else:
                tip = min(ends, key=lambda k: (-math.dist(node[k][5:8], node[head][5:8]) ** 2, node[k][3]))
            path = [tip]
            while path[-1] != head:
                path.append(node[path[-1]][2])
            rest = [k for k in inside if node[k][3] == own and k not in path]
            if len(rest) <= tail:
                path += rest
            out |= {(tree, k): head for k in path}
            todo += [(k, False, stem_only or node[k][3] == own) for p in path for k in kids.get(p, []) if k not in path]
    return out


@pytest.mark.parametrize("seed,stem_only,tail", [(1, False, 5), (2, False, 5), (3, False, 0), (4, True, 5)])
def test_lengthened_segments_are_the_recursion(spark, seed, stem_only, tail):
    rows = forest(seed)
    got = branching.lengthen(spark.createDataFrame(rows, LAYERS), stem_only, tail).collect()
    want = recursion(rows, stem_only, tail)
    assert {(x.tree_id, x.node): x.segment for x in got} == want
    up = {(x[0], x[1]): x[2] for x in rows}
    assert all(x.parent_segment == want.get((x.tree_id, up[x.tree_id, x.segment])) for x in got)


def test_small_children_go(spark):
    """A stem of 30 layers, four sets around each; beside it a child inside its width, one that stands out, one small with a small child, one small with a wide child."""
    shape = "tree_id long, centre long, layer int, segment long, parent_segment long, x double, y double, z double"
    rows, k = [], 0

    def add(layer, segment, parent, x, y, z):
        nonlocal k
        rows.append((1, k, layer, segment, parent, float(x), float(y), float(z)))
        k += 1

    for h in range(30):
        for a in range(4):
            add(h, 1, None, 0.1 * math.cos(a * math.pi / 2), 0.1 * math.sin(a * math.pi / 2), h * 0.1)
    for h in range(4):
        add(13 + h, 2, 1, 0.11, 0.0, 1.3 + 0.1 * h)  # stands out by 1 cm
        add(13 + h, 3, 1, 0.1 + 0.1 * h, 0.0, 1.3)  # by 30 cm
        add(16 + h, 4, 1, 0.0, 0.115, 1.6 + 0.1 * h)  # by 1.5 cm, with a child by 1.5 cm
        add(19 + h, 5, 1, 0.0, -0.11, 1.9 + 0.1 * h)  # by 1 cm, with a child by 40 cm
    for h in range(3):
        add(18 + h, 6, 4, 0.0, 0.115, 1.9 + 0.1 * h)
        add(21 + h, 7, 5, 0.0, -0.11 - 0.13 * h, 2.1)
    left = {r.segment for r in branching.remove_small(spark.createDataFrame(rows, shape)).collect()}
    assert left == {1, 3, 5, 7}
    assert branching.remove_small(spark.createDataFrame([], shape)).collect() == []
    assert branching.lengthen(spark.createDataFrame([], LAYERS)).collect() == []
