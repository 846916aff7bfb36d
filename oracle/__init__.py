"""Plain SQL twins of the registered queries, for checking results with another engine."""


def load_oracles() -> dict[str, str]:
    from oracle import base, changes, search, tables  # noqa: F401
    return base.ORACLES
