"""Named queries over the supplied tables, with their SQL counterparts."""

from grantscope.plans import catalog, core, more, repository  # noqa: F401  (they register their queries)

#: The flagship: who can reach process execution, and by which path of delegation.
FLAGSHIP = "authority_query"


def all_queries():
    return catalog.QUERIES


def all_oracles():
    return catalog.ORACLES
