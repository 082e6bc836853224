"""Registry of the engine's own queries: name -> callable, and name -> oracle SQL."""

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, oracle=None):
    """Decorator: file a (spark, sf_dir) query under `name`, with its SQL when there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep
