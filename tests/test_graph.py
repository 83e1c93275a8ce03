import itertools

from spanloom.operators import graph


def closure(nodes, needs):
    reach = {(a, b) for a in nodes for b in needs.get(a, ())}
    for k, a, b in itertools.product(nodes, repeat=3):
        if (a, k) in reach and (k, b) in reach:
            reach.add((a, b))
    for k, a, b in itertools.product(nodes, repeat=3):
        if (a, k) in reach and (k, b) in reach:
            reach.add((a, b))
    return reach


def test_every_graph_of_three_nodes():
    nodes = "abc"
    pairs = [(a, b) for a in nodes for b in nodes]
    for mask in range(2 ** len(pairs)):
        needs: dict[str, set[str]] = {}
        for i, (a, b) in enumerate(pairs):
            if mask >> i & 1:
                needs.setdefault(a, set()).add(b)
        reach = closure(nodes, needs)
        order, cycles = graph.order(nodes, needs, lambda n: n)
        assert sorted(order) == list(nodes)
        together = {(a, b) for a in nodes for b in nodes if a == b or (a, b) in reach and (b, a) in reach}
        for a, b in itertools.permutations(nodes, 2):
            if (a, b) in reach and (b, a) not in reach:
                assert order.index(b) < order.index(a)
        for cycle in cycles:
            assert len(cycle) > 1 and all((a, b) in together for a in cycle for b in cycle)
            at = [order.index(n) for n in cycle]
            assert max(at) - min(at) + 1 == len(cycle)


def test_priorities_come_from_a_live_heap():
    rank = dict(a=9, b=1, c=8, d=0, e=4, f=3)
    order, cycles = graph.order("abcdef", {"b": {"c"}, "c": {"b"}, "d": {"b"}}, rank.get)
    assert order.index("b") + 1 == order.index("c") and order.index("d") > order.index("c") and cycles == [("b", "c")]
    assert order[-1] == "a"


def test_permutations_give_one_order():
    needs = {"a": {"b", "c"}, "b": {"d"}, "c": {"d"}, "d": set()}
    results = {tuple(graph.order(p, {k: set(needs[k]) for k in p}, lambda n: n)[0]) for p in itertools.permutations("abcd")}
    assert results == {("d", "b", "c", "a")}


def test_long_chains_and_rings_need_no_recursion():
    n = 3000
    names = [f"m_{i:05d}" for i in range(n)]
    chain = {a: {b} for a, b in zip(names, names[1:])}
    assert graph.order(names, chain, lambda x: x)[0] == names[::-1]
    ring = {**chain, names[-1]: {names[0]}}
    order, cycles = graph.order(names, ring, lambda x: x)
    assert order == names and cycles == [tuple(names)]


def test_order_of_many_scopes(spark):
    nodes = spark.createDataFrame([(s, n, [n]) for s in (1, 2) for n in "abc"], "snapshot_id long, node string, key array<string>")
    edges = spark.createDataFrame([(1, "a", "c"), (2, "a", "b"), (2, "b", "a"), (2, "c", "x"), (2, None, "a")], "snapshot_id long, node string, needs string")
    rows = {(r.snapshot_id, r.node): r for r in graph.order_nodes(nodes, edges).collect()}
    assert rows[1, "c"].number < rows[1, "a"].number
    assert rows[2, "a"].in_cycle and rows[2, "b"].component == "a" and not rows[2, "c"].in_cycle and (2, "x") in rows
    assert graph.order_nodes(nodes.limit(0), edges.limit(0)).count() == 0
