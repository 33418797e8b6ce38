"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from pairbayes.plans import (embed_queries, extra_queries, io_queries, learner_queries, match_queries, metric_queries,
                                 misc_queries, name_queries, pixel_queries, prep_queries)

    q = {}
    q.update(learner_queries.QUERIES)
    q.update(prep_queries.QUERIES)
    q.update(match_queries.QUERIES)
    q.update(embed_queries.QUERIES)
    q.update(metric_queries.QUERIES)
    q.update(io_queries.QUERIES)
    q.update(pixel_queries.QUERIES)
    q.update(misc_queries.QUERIES)
    q.update(extra_queries.QUERIES)
    q.update(name_queries.QUERIES)
    return q


def all_oracles() -> dict:
    from pairbayes.plans import (embed_queries, extra_queries, io_queries, match_queries, metric_queries, misc_queries,
                                 name_queries, oracles, pixel_queries, prep_queries)

    o = {}
    o.update(oracles.learner_oracles())
    o.update(prep_queries.oracles())
    o.update(match_queries.oracles())
    o.update(embed_queries.oracles())
    o.update(metric_queries.oracles())
    o.update(io_queries.oracles(oracles.learner_oracles()))
    o.update(pixel_queries.oracles())
    o.update(misc_queries.oracles())
    o.update(extra_queries.oracles())
    o.update(name_queries.oracles())
    return o
