"""Multi-operator jobs and the registered query catalogue."""


def load_catalog():
    """All registered queries by name."""
    from larkseek.plans import catalog
    return catalog.QUERIES
