"""Rounds of linking: what they move, and what is left for the next one."""

import re

from lendscope.llm import components, superminhash


def test_a_star_step_does_not_shuffle_whole_links(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (3, 2)], "u long, v long")
    plan = components._star(links, True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(u#\d+L, v#\d+L", plan)


def test_repeated_links_leave_one_star(spark):
    links = spark.createDataFrame([(3, 2), (2, 3), (3, 2), (2, 1), (4, 4)], "u long, v long")
    got = components.components(links).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_a_round_leaves_buckets_of_several_components(spark):
    now = spark.createDataFrame([(b, i, i, 9, 1) for b, i in ((1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3))],
                                "bucket long, root long, node long, size long, n long")
    chosen = spark.createDataFrame([(1, 1, 1, 9)], "bucket long, pivot long, pivot_root long, pivot_size long")
    links = spark.createDataFrame([(2, 1), (4, 1)], "u long, v long")
    got = superminhash._live(now, chosen, links).select("bucket", "node", "root", "size", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, 9, 2), (1, 3, 3, 9, 1), (1, 4, 1, 9, 2)]
