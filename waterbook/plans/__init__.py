"""Report plans: ``f(tables, params) -> DataFrame`` with typed columns."""
