"""Where the queries of a module and their SQL are kept."""

from __future__ import annotations

from garimpo.queries.values import ACCENTED, BARE


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        """Decorator: registers the function under its name, with SQL that gives the same rows."""

        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def sql_bare(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{BARE}')"


def sql_norm(x: str) -> str:
    return f"lower(trim(regexp_replace({sql_bare(x)}, '[^a-zA-Z0-9]+', ' ', 'g')))"


def sql_match(x: str) -> str:
    return f"lower({sql_bare(x)})"


def sql_compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"
